"""SentencePiece encoding of merge-type models by backtracking, and decoding.

Two neighbouring characters that occur together inside no piece are never merged, so a normalised text falls into segments
at such places, and each distinct segment of a block is encoded once. Inside a segment an Aho-Corasick pass gives the longest
piece at every position. A piece may follow another only if merging their joined text anew gives the same two
pieces; if no piece fits, the last one is taken back and its start is marked as failed, so no position is tried twice.
The result equals the one of merging by score, because every merge across a border of two pieces would also happen in the pair alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from meshspark.llm.shared import distinct_words, query, ragged, read, sliced

BLOCK_BYTES = 2 << 20
KNOWN_SEGMENTS = 1 << 18
KNOWN_PAIRS = 1 << 18


class Encoder:
    """Pieces of one model file, its automaton and the pairs checked so far.

    For models with byte pieces, without unused pieces (both checked) and without user-defined symbols.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        self.byte_ids = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        self.ids = {m.id_to_piece(i): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.rank = {p: -m.get_score(i) for p, i in self.ids.items()}
        if any(m.is_unused(i) for i in self.ids.values()) or not self.byte_ids:
            raise ValueError(f"{path}: needs byte pieces for unknown characters and no unused pieces")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefix: dict[str, str | None] = {}
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        number = {c: i + 1 for i, c in enumerate(letters)}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.together[number[a], number[b]] = True

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the best score first, the leftmost of equal ones; characters without a piece stay alone."""
        parts, rank, never = list(text), self.rank.get, float("inf")
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether merging the joined text of two neighbours gives the same two pieces again."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        known = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece with which this one begins; a single character always counts."""
        if piece not in self.prefix:
            n = next((n for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids), 0)
            self.prefix[piece] = piece[:n] or None  # only pieces and single characters come here
        return self.prefix[piece]

    def encode(self, text: str) -> list[str]:
        """Pieces of a normalised text; characters without a piece stay alone."""
        size = len(text)
        longest = [1] * size
        for end, n in self.automaton.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        failed = bytearray(size + 8 >> 3)  # one bit a position
        out: list[str] = []
        at, last, known, prefix = 0, "", self.pairs.get, self.prefix
        piece = text[:longest[0]] if text else None
        while piece is not None:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = known((last, piece))
                if fit or fit is None and self.fits(last, piece):
                    out.append(piece)
                    at, last = end, piece
                    piece = text[at:at + longest[at]] if at < size else None
                    continue
            piece = prefix[piece] if piece in prefix else self.shorter(piece)
            while piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(last)
                piece = self.shorter(out.pop())
                last = out[-1] if out else ""
        return out

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte_ids[f"<0x{b:02X}>"] for b in p.encode()]
        return out

    def segment_ids(self, text: str) -> bytes:
        """Ids of a segment as 32-bit numbers; the last one or two times ``KNOWN_SEGMENTS`` short segments are remembered."""
        known = self.segments.get(text)
        if known is None:
            known = self.older.get(text)
            if known is None:
                known = np.array(self.to_ids(self.encode(text)), np.int32).tobytes()
            if len(self.segments) >= KNOWN_SEGMENTS:
                self.older, self.segments = self.segments, {}
            if len(text) <= 64:
                self.segments[text] = known
        return known

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the offsets of the texts."""
        normal = [self.model.normalize(t) for t in texts]
        sizes = np.fromiter(map(len, normal), np.int64, len(normal))
        joined = "".join(normal)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        letter = self.letter[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.together[letter[:-1], letter[1:]]
        begin = np.cumsum(sizes) - sizes
        cut[begin[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        number, first = distinct_words(points.view(np.uint8), starts * 4, ends * 4)
        found = [self.segment_ids(joined[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        width = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        per = width[number]
        ids = flat[ragged(per, (np.cumsum(width) - width)[number])]
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(per, out=before[1:])
        return ids, before[np.searchsorted(starts, np.append(begin, len(points)))]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and model file."""
    return Encoder(path)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ``ids`` array<int>: the ids of every whole text, without begin or end ids, as the library gives them.

    ``model_path`` names a merge-type model file that exists on every executor. Null and empty texts have no ids; equal rows
    each keep theirs; an empty table gives an empty one; an input column named like ``ids`` is replaced, all others
    stay. There is no shuffle; a block holds about ``BLOCK_BYTES`` of text or one longer text.
    """
    d = docs.drop(ids)
    schema = StructType([*d.schema, StructField(ids, ArrayType(IntegerType()))])

    def run(batches):
        e = encoder(model_path)
        for b in sliced(batches, BLOCK_BYTES, text):
            flat, offsets = e.encode_block([t or "" for t in b.column(text).to_pylist()])
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, ids])

    return d.mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def decoder(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with ``decoded``: the text of every row's ids; null or no ids give an empty text, other columns stay."""
    d = encoded.drop(decoded)
    schema = StructType([*d.schema, StructField(decoded, StringType())])

    def run(batches):
        model = decoder(model_path)
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                texts = [model.decode(x) if x else "" for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, decoded])

    return d.mapInArrow(run, schema)


@query("op12_sentencepiece")
def op12_sentencepiece(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
