"""Benchmark decontamination by latent semantic retrieval.

Passages of 64 words are TF-IDF vectors over the terms of the corpus, hashed to a fixed number of columns. A randomised SVD of all
passages, computed as sums over Spark tasks, gives a latent space of fixed rank that knows nothing of the benchmark. Every window of
every text is compared with every benchmark piece in that space; windows near a piece are candidates, and a candidate is a leak
if its answer words are there and enough of the item's words are there in order. Order is asked for inside sentences and clauses
only: each one is aligned on its own, so they may come in any order. Items of two to four words are looked for as exact phrases.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meshspark.llm.shared import buffer_of, keep, ngram_hashes, partitions, query, ragged, read, sliced, unused, word_hashes, words_of

PASSAGE, MARGIN = 64, 16
UNIT, STEP, FINE = 4, 8, 24
PIECE, OVERLAP = 48, 80
MIN_WORDS, MIN_PHRASE = 5, 2
CLAUSE, SPREAD = 6, 4
PIECES_PER_BLOCK = 16_384
PIECES_AT_ONCE = 1024
COLUMNS = 1 << 15
RANK, TOP, OVERSAMPLE = 48, 8, 8
MIN_COSINE = 0.5
MIN_COMMON = 0.6
MIN_ANSWER = 0.5
ROWS_SENT = 2048
PASSAGES_AT_ONCE = 2048
STRIP = 1 << 15
_CLAUSE_END = re.compile("[.!?;:,\n]")
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def term_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case terms (letters, digits and all that is not ASCII) of every row: hashes and row offsets."""
    data, offsets = buffer_of(pc.utf8_lower(column))
    starts, ends, row = words_of(data, offsets, _BREAK)
    return word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def column_of(h: np.ndarray) -> np.ndarray:
    """Column of every term; 0 is kept for the places behind the end of a text."""
    return (h % np.uint64(COLUMNS - 1) + np.uint64(1)).astype(np.uint16)


@dataclass
class Queries:
    """A block of benchmark pieces: item ids, term hashes and clauses of each, the sorted terms, answer terms and latent vectors."""
    items: list = field(default_factory=list)
    pieces: list[np.ndarray] = field(default_factory=list)
    clauses: list[list[np.ndarray]] = field(default_factory=list)
    phrases: dict = field(default_factory=dict)
    terms: np.ndarray | None = None
    answers: np.ndarray | None = None
    n_answers: np.ndarray | None = None
    latent: np.ndarray | None = None
    basis: np.ndarray | None = None

    def closed(self) -> Queries:
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.pieces]))
        return self

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of every hash among the terms, -1 outside."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)


def _blocks(benchmark: DataFrame):
    """Blocks of at most ``PIECES_PER_BLOCK`` benchmark pieces and phrases, streamed to the driver; a long item goes on in the next block."""
    q, held = Queries(), 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        h, _ = term_hashes(pa.array([r.text]))
        if len(h) < MIN_PHRASE:
            continue
        if len(h) < MIN_WORDS:
            q.phrases.setdefault(tuple(h.tolist()), set()).add(r.item_id)
            cuts = [None]
        else:
            ends = _clause_ends(r.text)
            cuts = np.array_split(np.arange(len(h)), max(1, round(len(h) / PIECE)))
        for own in cuts:
            if own is not None:
                q.items.append(r.item_id)
                q.pieces.append(h[own])
                q.clauses.append(_clauses(h[own], ends - own[0]))
            held += 1
            if held == PIECES_PER_BLOCK:
                yield q.closed()
                q, held = Queries(), 0
    if held:
        yield q.closed()


def _clause_ends(text: str) -> np.ndarray:
    """In words, where the sentences and clauses of a text end."""
    _, at = term_hashes(pa.array(_CLAUSE_END.split(text)))
    return np.unique(at[1:])


def _clauses(part: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A piece cut at clause ends into parts of at least ``CLAUSE`` words and less than twice as many."""
    cuts = [0]
    for e in [*ends[(ends > 0) & (ends < len(part))].tolist(), len(part)]:
        if e - cuts[-1] >= CLAUSE and (len(part) - e >= CLAUSE or e == len(part)):
            n = max(1, (e - cuts[-1]) // CLAUSE)
            cuts += [cuts[-1] + (e - cuts[-1]) * k // n for k in range(1, n)] + [e]
    if cuts[-1] < len(part):
        cuts.append(len(part))
    return [part[a:b] for a, b in zip(cuts, cuts[1:])]


def _survey(sent, codes: bool):
    """Per task: in how many disjoint passages each benchmark term (from 0) and column (below -1) occurs; -1 counts the passages.

    With ``codes``, also the columns of all passages, 64 each, in a row per slice, so that the corpus is cut into words once only.
    """
    def run(batches):
        own = sent.value
        v = len(own.terms)
        total, by_column, passages = np.zeros(v, np.int64), np.zeros(COLUMNS, np.int64), 0
        for b in sliced(batches):
            h, at = term_hashes(b.column("text"))
            n = np.diff(at)
            blocks = -(-n // PASSAGE)
            slot = ragged(n, (np.cumsum(blocks) - blocks) * PASSAGE)
            passages += int(blocks.sum())
            c = own.places(h)
            hit = c >= 0
            if hit.any():
                total += np.bincount(np.unique(slot[hit] // PASSAGE * v + c[hit]) % v, minlength=v)
            if codes and len(h):
                grid = np.zeros((int(blocks.sum()), PASSAGE), np.uint16)
                grid.reshape(-1)[slot] = column_of(h)
                by = np.sort(grid, axis=1)
                new = np.ones(by.shape, bool)
                new[:, 1:] = by[:, 1:] != by[:, :-1]
                by_column += np.bincount(by[new], minlength=COLUMNS)
                yield _rows(pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([grid.tobytes()], pa.binary()))
        seen, columns = np.flatnonzero(total), np.flatnonzero(by_column)
        key = np.concatenate([seen, [-1], -2 - columns])
        yield _rows(pa.array(key), pa.array(np.concatenate([total[seen], [passages], by_column[columns]])), pa.nulls(len(key), pa.binary()))
    return run


def _rows(term, n, codes):
    return pa.RecordBatch.from_arrays([term, n, codes], names=["term", "n", "codes"])


def _counted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = table.filter("n is not null").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    return x.term.to_numpy(np.int64), x.n.to_numpy(np.int64)


def _choose_answers(q: Queries, term: np.ndarray, n: np.ndarray) -> None:
    """Answer terms of each piece: the rarest third of its distinct terms, two at least."""
    df = np.zeros(len(q.terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    chosen = []
    for h in q.pieces:
        c = np.unique(q.places(h))
        c = c[np.lexsort((c, df[c]))]
        chosen.append(c[:max(2, math.ceil(len(c) / 3))])
    q.n_answers = np.array([len(a) for a in chosen], np.int64)
    q.answers = np.full((len(chosen), max(q.n_answers, default=0)), -1, np.int64)
    for i, a in enumerate(chosen):
        q.answers[i, :len(a)] = a


def _idf(term: np.ndarray, n: np.ndarray) -> np.ndarray:
    df = np.zeros(COLUMNS)
    df[-2 - term[term < -1]] = n[term < -1]
    idf = np.log((n[term == -1].sum() + 2.0) / (df + 1.0))
    idf[0] = 0.0
    return idf


def _projected(batches, m: np.ndarray, idf: np.ndarray):
    """Of some passages at a time: their columns, their TF-IDF vectors (of sum 1) times ``m``, and what makes the sum 1."""
    for b in batches:
        for raw in b.column("codes"):
            grid = np.frombuffer(raw.as_buffer(), np.uint16).reshape(-1, PASSAGE)
            for at in range(0, len(grid), PASSAGES_AT_ONCE):
                own = grid[at:at + PASSAGES_AT_ONCE]
                size = 1.0 / np.maximum(idf[own].sum(axis=1), 1e-9)
                out = np.empty((len(own), m.shape[1]), np.float32)
                for k in range(0, len(own), 128):
                    out[k:k + 128] = m[own[k:k + 128]].sum(axis=1)
                yield own, out * size[:, None].astype(np.float32), size


def _blocks_of_rows(x: np.ndarray, rows: int):
    for at in range(0, len(x), rows):
        part = np.ascontiguousarray(x[at:at + rows], np.float64)
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], names=["at", "rows"])


def _range_rows(basis, weights):
    """Per task, the rows of A'A times the basis but for the factor idf, for the passages of the task."""
    def run(batches):
        m, idf = basis.value, weights.value
        out = np.zeros(m.shape[::-1])
        for own, y, size in _projected(batches, m, idf):
            flat = own.reshape(-1).astype(np.intp)
            y = np.ascontiguousarray((y * size[:, None]).T)
            for j in range(len(out)):
                out[j] += np.bincount(flat, weights=np.repeat(y[j], PASSAGE), minlength=COLUMNS)
        yield from _blocks_of_rows(out.T, ROWS_SENT)
    return run


def _square_rows(basis, weights):
    """Per task, (A basis)'(A basis) for the passages of the task."""
    def run(batches):
        m = basis.value
        out = np.zeros((m.shape[1], m.shape[1]))
        for _, y, _ in _projected(batches, m, weights.value):
            out += y.T @ y
        yield from _blocks_of_rows(out, 8)
    return run


def _added(batches):
    """Running sums by block of rows: a partition holds only the blocks dealt to it."""
    held = {}
    for b in batches:
        for at, rows in zip(*[b.column(x).to_pylist() for x in ("at", "rows")]):
            x = np.frombuffer(rows)
            held[at] = x + held[at] if at in held else x
    for at, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.tobytes()], pa.binary())], names=["at", "rows"])


def _summed(codes: DataFrame, step, shape: tuple, rows: int) -> np.ndarray:
    """Sum over all tasks of a matrix of fixed shape, added up by blocks of rows on the executors."""
    kind = "at bigint, rows binary"
    parts = codes.mapInArrow(step, kind).repartition(min(partitions(codes.sparkSession), -(-shape[0] // rows)), "at").mapInArrow(_added, kind)
    out = np.zeros(shape)
    for r in parts.toPandas().itertuples():
        x = np.frombuffer(r.rows).reshape(-1, shape[1])
        out[r.at:r.at + len(x)] = x
    return out


def _decompose(codes: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """Randomised SVD of all passages: a random range with a power step, then the eigenvectors of the small projected matrix.

    The first directions, ``TOP`` or an eighth of those that there are, tell languages and sources apart and are left out; the next
    ``RANK`` are divided by their singular values. Returns the direction of every column in that space times its idf: the latent vector
    of a text is the sum over its terms. A column without a part in the space has a random direction, so that its terms count all the same.
    """
    sc, width = codes.sparkSession.sparkContext, TOP + RANK + OVERSAMPLE
    weights = sc.broadcast(idf)

    def scaled(x):
        return sc.broadcast((idf[:, None] * x).astype(np.float32))

    random = np.random.default_rng(seed).standard_normal((COLUMNS, width))
    base, _ = np.linalg.qr(idf[:, None] * _summed(codes, _range_rows(scaled(random), weights), (COLUMNS, width), ROWS_SENT))
    small = _summed(codes, _square_rows(scaled(base), weights), (width, width), 8)
    squares, vectors = np.linalg.eigh((small + small.T) / 2)
    squares, vectors = squares[::-1], vectors[:, ::-1]
    there = int((squares > 1e-10 * max(squares[0], 1e-30)).sum())
    own = slice(min(TOP, there // 8), min(TOP, there // 8) + min(RANK, there))
    place = np.zeros((COLUMNS, RANK))
    part = base @ (vectors[:, own][:, squares[own] > 1e-10 * squares[0]])
    place[:, :part.shape[1]] = part / np.sqrt(squares[own][:part.shape[1]])
    empty = ~(np.abs(part) > 1e-9).any(axis=1)
    place[empty] = np.random.default_rng(seed + 1).standard_normal((int(empty.sum()), RANK))
    return idf[:, None].astype(np.float32) * _units(place)


def _units(z: np.ndarray) -> np.ndarray:
    n = np.sqrt((z * z).sum(axis=-1, keepdims=True))
    return (z / np.where(n > 0, n, 1.0)).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = v & where.get(x, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def common_words(piece: np.ndarray, clauses: list[np.ndarray], words: np.ndarray) -> int:
    """Words of a piece found in order: in all of it, or clause by clause, each inside the best stretch of its length plus ``SPREAD``."""
    whole = common_subsequence(piece.tolist(), words.tolist())
    if len(clauses) < 2:
        return whole
    total = 0
    for c in clauses:
        reach, spots = len(c) + SPREAD, np.flatnonzero(np.isin(words, c))
        total += max((common_subsequence(c.tolist(), words[s:s + reach].tolist()) for s in spots), default=0)
    return max(whole, total)


def _strips(at: np.ndarray):
    """Texts cut into stretches of ``STRIP`` words, gathered to about as many: row, first word, end of its own words, end with overlap."""
    held, size = [], 0
    for row in np.flatnonzero(np.diff(at)):
        for low in range(int(at[row]), int(at[row + 1]), STRIP):
            own = min(low + STRIP, int(at[row + 1]))
            held.append((row, low, own, min(own + OVERLAP, int(at[row + 1]))))
            size += own - low
            if size >= STRIP:
                yield np.array(held)
                held, size = [], 0
    if held:
        yield np.array(held)


def _near(own: Queries, h: np.ndarray, at: np.ndarray, holding: np.ndarray, min_cosine: float):
    """Windows near a piece in the latent space, in rows that hold its answer terms: row, first word, end, piece, cosine, some at a time.

    A piece meets windows of its own length, rounded up to ``STEP`` words, which start every ``STEP`` words or, up to ``FINE``, every ``UNIT``.
    """
    kind = np.array([-(-len(p) // STEP) * STEP for p in own.pieces])
    for s in _strips(at):
        row, low, own_end, end = s.T
        size = len(own.pieces)
        has = np.zeros((row[-1] - row[0] + 1) * size, bool)
        has[holding[slice(*np.searchsorted(holding, [row[0] * size, (row[-1] + 1) * size]))] - row[0] * size] = True
        has = has.reshape(-1, size)
        n, units = end - low, -(-(end - low) // UNIT)
        first = np.cumsum(units) - units
        codes = np.zeros(int(units.sum()) * UNIT, np.uint16)
        codes[ragged(n, first * UNIT)] = column_of(h[ragged(n, low)])
        z = np.zeros((len(codes) // UNIT + 1, own.basis.shape[1]))
        np.cumsum(own.basis[codes].reshape(-1, UNIT, z.shape[1]).sum(axis=1), axis=0, out=z[1:])
        for k in np.unique(kind):
            width, step = k // UNIT, 1 if k <= FINE else STEP // UNIT
            last = np.where(end == at[row + 1], step * -(-np.maximum(units - width, 0) // step), units)
            many = np.minimum(-(-(own_end - low) // (UNIT * step)), last // step + 1)
            seg = np.repeat(np.arange(len(s)), many)
            start = ragged(many, np.zeros(len(s), np.int64)) * step
            stop = np.minimum(start + width, units[seg])
            u = _units(z[first[seg] + stop] - z[first[seg] + start])
            begin, until = low[seg] + start * UNIT, np.minimum(low[seg] + stop * UNIT, end[seg])
            of = np.flatnonzero(kind == k)
            for i in range(0, len(of), PIECES_AT_ONCE):
                part = of[i:i + PIECES_AT_ONCE]
                cosine = u @ own.latent[part].T
                near = cosine >= min_cosine
                near &= has[:, part][row[seg] - row[0]]
                w, p = np.nonzero(near)
                yield row[seg[w]], begin[w], until[w], part[p], cosine[w, p]


def _holding(own: Queries, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sorted row * pieces + piece of all rows that hold enough answer terms of a piece, from the terms' places."""
    piece, slot = np.nonzero(own.answers >= 0)
    term = own.answers[piece, slot]
    order = np.argsort(term, kind="stable")
    term, piece = term[order], piece[order]
    first = np.searchsorted(term, np.arange(len(own.terms) + 1))
    pair = np.unique(row * len(own.terms) + place)
    row, place = np.divmod(pair, len(own.terms))
    width = first[place + 1] - first[place]
    key, n = np.unique(np.repeat(row, width) * len(own.pieces) + piece[ragged(width, first[place])], return_counts=True)
    return key[n >= np.ceil(MIN_ANSWER * own.n_answers[key % len(own.pieces)])]


def _answered(own: Queries, key: np.ndarray, low: np.ndarray, high: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates, those with enough of their piece's answer terms between two words of the text, and their numbers of terms found."""
    total = own.n_answers[piece]
    need = np.ceil(MIN_ANSWER * total).astype(np.int64)
    live, found = np.arange(len(piece)), np.zeros(len(piece), np.int64)
    for j in range(own.answers.shape[1]):
        t = own.answers[piece[live], j]
        k = np.searchsorted(key, t << 40 | low[live])
        found[live] += (t >= 0) & (k < len(key)) & (key[np.minimum(k, len(key) - 1)] < (t << 40 | high[live]))
        live = live[found[live] + np.maximum(total[live] - j - 1, 0) >= need[live]]
        if not len(live):
            break
    return live, found


def _phrases(own: Queries, h: np.ndarray, at: np.ndarray):
    """Exact phrases: (row, first word, item), the first place of each in a row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in sorted({len(p) for p in own.phrases}):
        those = [p for p in own.phrases if len(p) == n]
        words = np.array(those, np.uint64)
        g = np.array([ngram_hashes(w, np.zeros(n, np.int64), n)[0][0] for w in words])
        order = np.argsort(g)
        have, first = ngram_hashes(h, row, n)
        k = np.minimum(np.searchsorted(g[order], have), len(g) - 1)
        hit = np.flatnonzero(g[order][k] == have)
        which, first = order[k[hit]], first[hit]
        same = np.all([h[first + i] == words[which, i] for i in range(n)], axis=0)
        which, first = which[same], first[same]
        _, once = np.unique(row[first] * len(those) + which, return_index=True)
        for i in once:
            for item in sorted(own.phrases[those[which[i]]]):
                yield row[first[i]], first[i], item


def _matches(sent, item_type, min_cosine):
    """Candidates by cosine in the latent space, then answer terms, then word order."""
    def run(batches):
        own = sent.value
        rare = np.zeros(len(own.terms), bool)
        rare[own.answers[own.answers >= 0]] = True
        for b in sliced(batches):
            h, at = term_hashes(b.column("text"))
            best = {}
            c = own.places(h)
            spots = np.flatnonzero((c >= 0) & rare[np.maximum(c, 0)]) if len(rare) else np.zeros(0, np.int64)
            key = np.sort(c[spots] << 40 | spots)
            holding = _holding(own, c[spots], np.searchsorted(at, spots, side="right") - 1) if len(spots) else spots
            for row, begin, until, piece, cosine in _near(own, h, at, holding, min_cosine) if len(spots) else ():
                low, high = np.maximum(begin - MARGIN, at[row]), np.minimum(until + MARGIN, at[row + 1])
                live, found = _answered(own, key, low, high, piece)
                for i in live:
                    p = piece[i]
                    common = common_words(own.pieces[p], own.clauses[p], h[low[i]:high[i]]) / len(own.pieces[p])
                    if common >= MIN_COMMON:
                        hit = (-common, -float(cosine[i]), int(begin[i] - at[row[i]]), found[i] / own.n_answers[p])
                        k = int(row[i]), own.items[p]
                        best[k] = min(best.get(k, hit), hit)
            for row, first, item in _phrases(own, h, at):
                best[int(row), item] = -1.0, -1.0, int(first - at[row]), 1.0
            if best:
                rows, items = zip(*best)
                common, cosine, start, answer = zip(*best.values())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows)), pa.array(items, item_type), pa.array(start, pa.int64()),
                     pa.array(-np.array(cosine)), pa.array(-np.array(common)), pa.array(np.array(answer, np.float64))],
                    names=["doc_id", "item_id", "start", "cosine", "common", "answer"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, start, cosine, common, answer): each document and item of which it holds a leak, with its best passage.

    docs: (doc_id, text), benchmark: (item_id, text); other columns are ignored. start counts words; common is the share of an
    item's words in the longest common subsequence of all of it or of its clauses one by one, answer that of its rarest third. Long items
    are searched in pieces of about 48 words and count by their best piece; items of two to four words are searched as exact phrases.
    Null texts hold nothing; items of one word, without words or null are not searched (``unsearched`` lists them); equal rows give one
    result; an empty table on either side gives an empty one. All of every text is read: long ones go through in stretches that
    overlap. What is broadcast is bounded: the basis by its columns and rank, the benchmark by blocks of 16,384 pieces.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, start bigint, cosine double, common double, answer double"
    d = docs.select("doc_id", "text")
    found, basis = spark.createDataFrame([], schema), None
    for q in _blocks(benchmark):
        survey = d.select("text").mapInArrow(_survey(sc.broadcast(q), basis is None), "term bigint, n bigint, codes binary")
        if basis is None:
            survey = keep(survey, "columns")
            term, n = _counted(survey)
            basis = _decompose(survey.filter("codes is not null").select("codes"), _idf(term, n))
        else:
            term, n = _counted(survey)
        _choose_answers(q, term, n)
        q.basis = basis
        q.latent = np.array([_units(basis[column_of(h)].sum(axis=0)) for h in q.pieces], np.float32).reshape(-1, RANK)
        found = found.unionByName(keep(d.mapInArrow(_matches(sc.broadcast(q), to_arrow_type(item), min_cosine), schema), "leaks"))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("common"), F.desc("cosine"), "start")
    return found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def unsearched(benchmark: DataFrame) -> DataFrame:
    """The rows of the benchmark that ``find_leaks`` does not search: texts of less than two words, null included."""
    def short(batches):
        for b in batches:
            _, at = term_hashes(b.column("text"))
            yield b.filter(pa.array(np.diff(at) < MIN_PHRASE))
    return benchmark.mapInArrow(short, benchmark.schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak, in the columns of ``docs``; rows that share an id, null included, go together.

    Null, empty and very long texts, repeated rows and empty tables as in ``find_leaks``; columns of any name come back as they were.
    """
    name = unused(docs.columns, "_bad")
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


@query("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
