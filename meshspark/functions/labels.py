"""Tooth label schemes: one 17-row (or 33-row) dimension table, always small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: 17-class palette, label 0..16
TOOTH_RGB = [
    (204, 204, 204), (7, 118, 7), (144, 239, 144), (221, 130, 101), (217, 101, 79), (111, 184, 210),
    (177, 122, 100), (241, 215, 145), (129, 175, 129), (128, 175, 169), (242, 215, 185), (176, 122, 140),
    (112, 184, 250), (218, 101, 119), (222, 130, 141), (145, 239, 184), (8, 118, 47),
]
# fixed values: coarse class names and palette
COARSE_NAMES = ["gum", "incisor", "canine", "premolar", "molar"]
COARSE_RGB = [(255, 192, 203), (70, 130, 180), (255, 140, 0), (60, 179, 113), (147, 112, 219)]
GUM_DISPLAY_RGB = (255, 192, 203)

# fixed values: tooth labels and the order of the sweeps
TOOTH_LABELS = list(range(1, 17))
INCISORS = [7, 8, 9, 10]
LEFT_SWEEP = [8, 7, 6, 5, 4, 3, 2, 1]
RIGHT_SWEEP = [9, 10, 11, 12, 13, 14, 15, 16]


def _position(label: int) -> int:
    """Tooth position counted from the midline, 1 (central incisor) to 8 (third molar)."""
    return 9 - label if label <= 8 else label - 8


def coarse_of(label: int) -> int:
    if label == 0:
        return 0
    p = _position(label)
    return 1 if p <= 2 else 2 if p == 3 else 3 if p <= 5 else 4


def fdi_of(label: int, arch: str) -> int:
    if label == 0:
        return 0
    quadrant = (1 if label <= 8 else 2) if arch == "upper" else (3 if label <= 8 else 4)
    return quadrant * 10 + _position(label)


def universal_of(label: int, arch: str) -> int:
    """Numbering 1..32: the upper jaw runs with the label; quadrant 3 is 24..17 and quadrant 4 is 25..32."""
    if label == 0:
        return 0
    if arch == "upper":
        return label
    return 25 - _position(label) if label <= 8 else 24 + _position(label)


def dim_tooth(spark: SparkSession) -> DataFrame:
    rows = []
    for arch in ("upper", "lower"):
        for label in range(17):
            r, g, b = TOOTH_RGB[label]
            rows.append((arch, label, fdi_of(label, arch), universal_of(label, arch), coarse_of(label),
                         COARSE_NAMES[coarse_of(label)], r, g, b))
    return spark.createDataFrame(
        rows, "arch string, label bigint, fdi bigint, universal bigint, coarse bigint, coarse_name string, "
              "r bigint, g bigint, b bigint")


def with_label_from_fdi(df: DataFrame, fdi: str = "fdi", out: str = "label") -> DataFrame:
    """FDI code -> label of either jaw; an unknown code raises an error."""
    dim = dim_tooth(df.sparkSession).select(F.col("fdi").alias(fdi), F.col("label").alias("_lab")).distinct()
    known = F.when(F.col("_lab").isNotNull(), F.col("_lab")).otherwise(
        F.raise_error(F.concat(F.lit("unknown tooth code "), F.col(fdi).cast("string"))).cast("bigint"))
    return df.join(F.broadcast(dim), fdi, "left").withColumn(out, known).drop("_lab")


def label_to_coarse(label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(coarse_of(i)).cast("bigint") for i in range(17)]), label.cast("int") + 1)


def label_to_universal(label: Column, arch: str) -> Column:
    if arch not in ("upper", "lower"):
        raise ValueError(f"arch must be 'upper' or 'lower', not {arch!r}")
    return F.element_at(F.array(*[F.lit(universal_of(i, arch)).cast("bigint") for i in range(17)]),
                        label.cast("int") + 1)


def label_to_rgb(label: Column, gum_display: bool = False, coarse: bool = False) -> Column:
    """Struct (r, g, b); ``gum_display`` repaints gum pink for display."""
    palette = list(COARSE_RGB if coarse else TOOTH_RGB)
    if gum_display:
        palette[0] = GUM_DISPLAY_RGB
    entries = [F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(c, "rgb")]) for c in palette]
    return F.element_at(F.array(*entries), label.cast("int") + 1)


def with_label_from_rgb(df: DataFrame, out: str = "label") -> DataFrame:
    """Exact palette match on r, g, b (alpha ignored); no match gives 0."""
    dim = dim_tooth(df.sparkSession).filter("arch = 'upper'").select("r", "g", "b", F.col("label").alias("_lab"))
    return df.join(F.broadcast(dim), ["r", "g", "b"], "left") \
        .withColumn(out, F.coalesce("_lab", F.lit(0).cast("bigint"))).drop("_lab")


def label_text(label: Column, arch: str | None = None) -> Column:
    """'#<universal>' when the jaw is known, else the coarse class name."""
    if arch:
        return F.concat(F.lit("#"), label_to_universal(label, arch).cast("string"))
    return F.element_at(F.array(*[F.lit(n) for n in COARSE_NAMES]), label.cast("int") + 1)


def histogram_text(label: str, n: str) -> Column:
    """Aggregate: 'label:n, ...' in label order (17 entries at most)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(label), F.col(n))))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p[label].cast("string"), F.lit(":"), p[n].cast("string"))), ", ")
