"""Component, footprint, coverage and growth queries on the lattice mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, longs, out
from meshspark.catalog.frames import MIDLINE
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import ADJ, FACES, FACIAL, FRAMES, GEOM, cols6, r6, u
from meshspark.functions.vectors import Vec
from meshspark.operators import frames as fr, graph, mesh, patches as pt
from meshspark.session import cut_lineage

SIZE = 6.0  # footprint edge on the unit lattice


def _mesh(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    return g, mesh.face_adjacency(g)


@query("label_components", f"""WITH RECURSIVE {FACES}, {ADJ},
l AS (SELECT a.arch_id, a.a, a.b FROM adj a JOIN faces x ON x.fid=a.a JOIN faces y ON y.fid=a.b WHERE x.label=y.label),
e AS (SELECT a AS p, b AS q FROM l UNION SELECT b, a FROM l),
reach AS (SELECT fid AS v, fid AS r FROM faces UNION SELECT reach.v, e.q FROM reach JOIN e ON e.p=reach.r)
SELECT f.arch_id, f.label, min_r AS comp, count(*) AS n FROM faces f JOIN (SELECT v, min(r) AS min_r FROM reach GROUP BY v) m ON m.v=f.fid GROUP BY ALL""")
def label_components(spark, sf):
    f = fixtures.lattice_faces(spark, sf).withColumn("grp", F.concat_ws("/", "arch_id", "label"))
    comp = graph.set_components(f.select("arch_id", "grp", "fid", "label"), mesh.face_adjacency(f), "grp")
    return comp.groupBy("arch_id", "label", "comp").agg(F.count("*").alias("n"))


COVER = f"""ext AS (SELECT arch_id, fid, label, nz AS occ FROM geom),
seeds AS (SELECT arch_id, fid, occ FROM ext WHERE label<>0 QUALIFY row_number() OVER (PARTITION BY arch_id ORDER BY occ DESC, fid)=1),
op AS (SELECT e.* FROM ext e WHERE occ>=0.55),
ed AS (SELECT a.a AS p, a.b AS q FROM adj a WHERE a.a IN (SELECT fid FROM op) AND a.b IN (SELECT fid FROM op)),
e2 AS MATERIALIZED (SELECT p, q FROM ed UNION SELECT q, p FROM ed),
reach AS (SELECT arch_id, fid FROM seeds WHERE occ>=0.55 UNION SELECT reach.arch_id, e2.q FROM reach JOIN e2 ON e2.p=reach.fid)"""


@query("coverage_fill", f"WITH RECURSIVE {GEOM}, {ADJ}, {COVER} SELECT arch_id, fid FROM reach")
def coverage_fill(spark, sf):
    g, adj = _mesh(spark, sf)
    ext = g.select("arch_id", "fid", "label", F.col("nz").alias("occ"), F.lit(0.55).alias("threshold"))
    return graph.grow_coverage(ext, adj).select("arch_id", "fid")


@query("coverage_share", f"""WITH RECURSIVE {GEOM}, {ADJ}, {COVER} SELECT g.arch_id, count(r.fid) AS n_faces, {r6('count(r.fid)/count(*)')} AS face_share,
{r6('coalesce(sum(g.area) FILTER (r.fid IS NOT NULL),0)/sum(g.area)')} AS area_share FROM geom g LEFT JOIN reach r ON r.fid=g.fid GROUP BY g.arch_id""")
def coverage_share(spark, sf):
    from meshspark.operators.metrics import coverage_share as share
    g, adj = _mesh(spark, sf)
    ext = g.select("arch_id", "fid", "label", F.col("nz").alias("occ"), F.lit(0.55).alias("threshold"))
    got = graph.grow_coverage(ext, adj).select("arch_id", "fid")
    return out(share(g.select("arch_id", "fid", "area"), got, ["arch_id"]), ["arch_id", "n_faces"], ["face_share", "area_share"])


def boxes_sql(src: str, fp: str, axis: str, sign: str, w: str, h: str, s: str, align: str) -> str:
    """Oriented boxes of frames in ``src`` (o*, t*, and the viewing axis columns ``axis``)."""
    wx, wy, wz = (f"({sign}{axis}{a})" for a in "xyz")
    return f"""SELECT *, by0*wz-bz0*wy AS tx1, bz0*wx-bx0*wz AS ty1, bx0*wy-by0*wx AS tz1 FROM (
  SELECT *, cx0/l AS bx0, cy0/l AS by0, cz0/l AS bz0 FROM (SELECT *, sqrt(cx0*cx0+cy0*cy0+cz0*cz0) AS l FROM (
  SELECT *, wy*tz-wz*ty AS cx0, wz*tx-wx*tz AS cy0, wx*ty-wy*tx AS cz0 FROM (
  SELECT *, {fp} AS fp, {wx} AS wx, {wy} AS wy, {wz} AS wz, {w}/2.0 AS hu, {h}/2.0 AS hv, {s}/2.0 AS hw, {align} AS align FROM {src}))))"""


REL = "(g.mx-b.ox)*{0}+(g.my-b.oy)*{1}+(g.mz-b.oz)*{2}"
HITS = f"""hit AS MATERIALIZED (SELECT b.fp, g.arch_id, g.fid, (g.mx-b.ox)*(g.mx-b.ox)+(g.my-b.oy)*(g.my-b.oy)+(g.mz-b.oz)*(g.mz-b.oz) AS d2
  FROM geom g JOIN boxes b ON b.arch_id=g.arch_id WHERE abs({REL.format('tx1','ty1','tz1')})<=hu AND abs({REL.format('bx0','by0','bz0')})<=hv
  AND abs({REL.format('wx','wy','wz')})<=hw AND g.nx*wx+g.ny*wy+g.nz*wz>=align),
he AS (SELECT h.fp, a.a AS p, a.b AS q FROM adj a JOIN hit h ON h.fid=a.a JOIN hit k ON k.fid=a.b AND k.fp=h.fp),
he2 AS MATERIALIZED (SELECT fp, p, q FROM he UNION SELECT fp, q, p FROM he),
reach AS (SELECT fp, fid AS v, fid AS r FROM hit UNION SELECT reach.fp, reach.v, he2.q FROM reach JOIN he2 ON he2.fp=reach.fp AND he2.p=reach.r),
comp AS MATERIALIZED (SELECT fp, v AS fid, min(r) AS comp FROM reach GROUP BY ALL),
sized AS MATERIALIZED (SELECT h.*, c.comp, count(*) OVER (PARTITION BY h.fp, c.comp) AS sz FROM hit h JOIN comp c ON c.fp=h.fp AND c.fid=h.fid),
chosen AS (SELECT fp, comp FROM sized QUALIFY row_number() OVER (PARTITION BY fp ORDER BY CASE WHEN sz>=5 THEN 0 ELSE 1 END, d2, fid)=1),
foot AS MATERIALIZED (SELECT s.fp, s.arch_id, s.fid FROM sized s JOIN chosen c ON c.fp=s.fp AND c.comp=s.comp)"""


@query("footprint_components", f"""WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, boxes AS MATERIALIZED ({boxes_sql('facial', "arch_id||'/'||label", 'n', '', str(SIZE), str(SIZE), '16.0', '0.6')}), {HITS} SELECT fp, arch_id, fid FROM foot""")
def footprint_components(spark, sf):
    g, adj = _mesh(spark, sf)
    t = fr.tangent_axes(fr.tooth_frames(g)).withColumn("fp", F.concat_ws("/", "arch_id", "label"))
    t = t.withColumnsRenamed({f"n{a}": f"w{a}" for a in "xyz"})
    boxes = fr.view_boxes(t.drop("label"), "w", SIZE, SIZE, 16.0, F.lit(0.6))
    # equal distances differ in the last bits of the origin's mean, which follow the order of its sum: rounded, the face id decides as it should
    return pt.footprints(boxes, g, adj, digits=pt.TIE_DIGITS)


DRAWS = f"""teeth AS MATERIALIZED (SELECT DISTINCT arch_id, label FROM faces WHERE label BETWEEN 1 AND 16),
patch AS MATERIALIZED (SELECT arch_id, 0 AS epoch, arch_id||':0' AS patch_id, label AS seed_label, {u('s/side','arch_id','0')}<0.5 AS low_side_first, {u('s/end','arch_id','0')}<0.5 AS from_low_end,
  CAST(0.2 AS DOUBLE)+CAST(0.6000000000000001 AS DOUBLE)*{u('s/occ','arch_id','0')} AS min_align FROM teeth WHERE label IN (7,8,9,10)
  QUALIFY row_number() OVER (PARTITION BY arch_id ORDER BY {u('s/tooth','arch_id','0','label')}, label)=1),
sorder AS MATERIALIZED (SELECT p.*, t.label AS tooth, row_number() OVER (PARTITION BY p.patch_id ORDER BY CASE WHEN t.label=p.seed_label THEN 0 WHEN (t.label<p.seed_label)=p.low_side_first THEN 1 ELSE 2 END, abs(t.label-p.seed_label))-1 AS step
  FROM patch p JOIN teeth t ON t.arch_id=p.arch_id),
eorder AS MATERIALIZED (SELECT p.*, t.label AS tooth, row_number() OVER (PARTITION BY p.patch_id ORDER BY CASE WHEN p.from_low_end THEN t.label ELSE -t.label END)-1 AS step FROM patch p JOIN teeth t ON t.arch_id=p.arch_id)"""


def _draws(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    present = pt.present_labels(f)
    return pt.draw_patches(present, "s"), present


@query("visit_order", f"""WITH {FACES}, {DRAWS} SELECT s.patch_id, s.tooth, s.step AS seed_step, e.step AS end_step FROM sorder s JOIN eorder e ON e.patch_id=s.patch_id AND e.tooth=s.tooth""")
def visit_order(spark, sf):
    p, present = _draws(spark, sf)
    s = pt.seed_order(p, present).select("patch_id", "tooth", F.col("step").alias("seed_step"))
    e = pt.end_order(p, present).select("patch_id", "tooth", F.col("step").alias("end_step"))
    return s.join(e, ["patch_id", "tooth"])


@query("occlusality_draw", f"WITH {FACES}, {DRAWS} SELECT patch_id, arch_id, epoch, seed_label, low_side_first, from_low_end, {cols6('min_align')} FROM patch")
def occlusality_draw(spark, sf):
    p, _ = _draws(spark, sf)
    return out(p, ["patch_id", "arch_id", "epoch", "seed_label", "low_side_first", "from_low_end"], ["min_align"])


SWEEP = f"""nt AS (SELECT arch_id, count(*) AS n FROM teeth GROUP BY arch_id),
visits AS (SELECT patch_id, s.arch_id, min_align, step AS stage, 'occlusal' AS phase, tooth FROM sorder s
  UNION ALL SELECT patch_id, e.arch_id, min_align, step+n, 'facial', tooth FROM eorder e JOIN nt ON nt.arch_id=e.arch_id
  UNION ALL SELECT patch_id, e.arch_id, min_align, step+2*n, 'lingual', tooth FROM eorder e JOIN nt ON nt.arch_id=e.arch_id),
viewed AS MATERIALIZED (SELECT v.patch_id, v.arch_id, v.stage, v.phase, v.tooth, v.min_align, ox, oy, oz, tx, ty, tz,
  CASE phase WHEN 'occlusal' THEN nx WHEN 'facial' THEN fx ELSE -fx END AS ax, CASE phase WHEN 'occlusal' THEN ny WHEN 'facial' THEN fy ELSE -fy END AS ay,
  CASE phase WHEN 'occlusal' THEN nz WHEN 'facial' THEN fz ELSE -fz END AS az FROM visits v JOIN facial f ON f.arch_id=v.arch_id AND f.label=v.tooth),
boxes AS MATERIALIZED ({boxes_sql('viewed', "patch_id||'/'||stage", 'a', '', str(SIZE), str(SIZE), '16.0', 'min_align')}), {HITS.replace('END, d2, fid)', f'END, round(d2, {pt.TIE_DIGITS}), fid)')},
stages AS MATERIALIZED (SELECT v.patch_id, f.arch_id, f.fid, v.stage, v.phase, v.tooth FROM foot f JOIN viewed v ON v.patch_id||'/'||v.stage=f.fp
  QUALIFY row_number() OVER (PARTITION BY v.patch_id, f.fid ORDER BY v.stage)=1)"""


def _sweep(spark, sf):
    g, adj = _mesh(spark, sf)
    p, present = _draws(spark, sf)
    visits = cut_lineage(pt.sweep_visits(p, present))
    return pt.sweep_stages(visits, g, adj, SIZE, SIZE), g, adj, visits


@query("sweep_stages", f"WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, {DRAWS}, {SWEEP} SELECT patch_id, arch_id, fid, stage, phase, tooth FROM stages")
def sweep_stages(spark, sf):
    return _sweep(spark, sf)[0]


@query("phase_increments", f"""WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, {DRAWS}, {SWEEP}, per AS (SELECT patch_id, phase, count(*) AS n, sum(g.area) AS area_mm2 FROM stages s JOIN geom g ON g.fid=s.fid GROUP BY ALL)
SELECT patch_id, phase, n, {cols6('area_mm2')}, {r6('n/(sum(n) OVER (PARTITION BY patch_id))')} AS share FROM per""")
def phase_increments(spark, sf):
    s, g, *_ = _sweep(spark, sf)
    return out(pt.phase_increments(s, g), ["patch_id", "phase", "n"], ["area_mm2", "share"])


@query("stage_growth", f"""WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, {DRAWS}, {SWEEP}, per AS (SELECT v.patch_id, v.stage, count(s.fid) AS new_faces, coalesce(sum(g.area), 0) AS new_area FROM visits v LEFT JOIN stages s ON s.patch_id=v.patch_id AND s.stage=v.stage LEFT JOIN geom g ON g.fid=s.fid GROUP BY ALL)
SELECT patch_id, stage, new_faces, CAST(sum(new_faces) OVER w AS BIGINT) AS n_faces, {r6('sum(new_area) OVER w')} AS area_mm2 FROM per WINDOW w AS (PARTITION BY patch_id ORDER BY stage)""")
def stage_growth(spark, sf):
    s, g, _, visits = _sweep(spark, sf)
    return out(pt.stage_growth(s, g, visits), ["patch_id", "stage", "new_faces", "n_faces"], ["area_mm2"])


@query("stage_draw", f"""WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, {DRAWS}, {SWEEP}, pick AS (SELECT patch_id, CAST(floor(pow({u('s/stage', 'patch_id')}, 2.5)*(count(DISTINCT stage)-1)) AS BIGINT) AS picked FROM visits GROUP BY patch_id)
SELECT s.patch_id, s.arch_id, s.fid, s.stage FROM stages s JOIN pick p ON p.patch_id=s.patch_id WHERE s.stage<=p.picked""")
def stage_draw(spark, sf):
    s, _, _, visits = _sweep(spark, sf)
    return pt.sample_stage(s, visits, "s").select("patch_id", "arch_id", "fid", "stage")


@query("midline_stages", f"""WITH RECURSIVE {GEOM}, {ADJ}, {FRAMES}, {MIDLINE}, grown AS (SELECT m.*, s.stage, 2.0+(s.stage*6.0)/7.0 AS size FROM midline m, (SELECT unnest(generate_series(0,7)) AS stage) s),
boxes AS MATERIALIZED ({boxes_sql('grown', "arch_id||'/'||stage", 'n', '', 'size', 'size', '16.0', '0.6')}), {HITS}
SELECT CAST(f.arch_id AS VARCHAR) AS patch_id, f.arch_id, f.fid, CAST(min(g.stage) AS BIGINT) AS stage FROM foot f JOIN grown g ON g.arch_id||'/'||g.stage=f.fp GROUP BY ALL""")
def midline_stages(spark, sf):
    g, adj = _mesh(spark, sf)
    return pt.midline_stages(fr.tooth_frames(g), g, adj, 2.0, 8.0)


_DIL = """dil AS MATERIALIZED (SELECT DISTINCT arch_id, tooth, fid FROM (SELECT arch_id, label AS tooth, fid FROM geom WHERE label BETWEEN 1 AND 16
  UNION ALL SELECT a.arch_id, t.label, a.fid FROM geom a JOIN geom t ON t.arch_id=a.arch_id AND t.label BETWEEN 1 AND 16
  AND (a.mx-t.mx)*(a.mx-t.mx)+(a.my-t.my)*(a.my-t.my)+(a.mz-t.mz)*(a.mz-t.mz)<=2.25))"""


@query("whole_tooth_stages", f"""WITH {GEOM}, {DRAWS}, {_DIL} SELECT s.patch_id, d.arch_id, d.fid, min(s.step) AS stage FROM sorder s JOIN dil d ON d.arch_id=s.arch_id AND d.tooth=s.tooth GROUP BY ALL""")
def whole_tooth_stages(spark, sf):
    g, _ = _mesh(spark, sf)
    p, _ = _draws(spark, sf)
    return pt.whole_tooth_stages(p, g)


@query("margin_dilation", f"""WITH {GEOM}, mem AS (SELECT * FROM geom WHERE label=8) SELECT DISTINCT a.arch_id, a.fid FROM geom a JOIN mem t ON t.arch_id=a.arch_id
WHERE (a.mx-t.mx)*(a.mx-t.mx)+(a.my-t.my)*(a.my-t.my)+(a.mz-t.mz)*(a.mz-t.mz)<=2.25""")
def margin_dilation(spark, sf):
    g, _ = _mesh(spark, sf)
    return pt.dilate_set(g.filter("label = 8"), g, 1.5)


@query("mode_mix", f"""WITH {FACES}, {DRAWS}, e AS (SELECT unnest(generate_series(0,9)) AS epoch), t AS (SELECT arch_id, count(*) FILTER (label IN (8,9))=2 AS pair89 FROM teeth GROUP BY arch_id)
SELECT t.arch_id||':'||e.epoch AS patch_id, CASE WHEN {u('s/mode', "t.arch_id||':'||e.epoch")}<0.3 AND pair89 THEN 'midline' ELSE 'sweep' END AS mode FROM t, e WHERE t.arch_id IN (SELECT arch_id FROM patch)""")
def mode_mix(spark, sf):
    present = pt.present_labels(fixtures.lattice_faces(spark, sf))
    return pt.choose_mode(pt.draw_patches(present, "s", epochs=10), present, "s", midline_prob=0.3).select("patch_id", "mode")


@query("relaxing_coverage")
def relaxing_coverage(spark, sf):
    s, g, adj, _ = _sweep(spark, sf)
    return pt.relaxing_coverage(s, g, adj, (0.0, 0.0, 1.0), 6, 0.9, 0.3)
