"""Token counts from pre-token frequencies.

A task cuts its texts into pre-tokens and keeps, per block of documents, the sparse table of (document, pre-token, frequency) and
the list of distinct pre-tokens, dealt into hash buckets. All lists of a bucket meet in one task, where each distinct
pre-token is encoded once and its number of pieces goes back to every block that listed it. A block then sums frequency
times pieces per document. Texts are never shuffled and token ids are never kept.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm.shared import keep, partitions, query, read

BLOCK_CHARS = 16_000_000
BUCKETS_PER_PARTITION = 2

# The pre-token pattern of byte-level BPE and the Unicode white space that it splits on.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_RUN = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
_COMMON = re.compile("[\\x00-\\u024f]*")


class _Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _runs(text: str, specials: re.Pattern | None) -> list[str]:
    """White-space delimited runs; no pre-token crosses a border of runs. Special strings stand alone."""
    if specials is None or not specials.search(text):
        return _RUN.findall(text)
    out = []
    for i, part in enumerate(specials.split(text)):
        out += [part] if i % 2 else _RUN.findall(part)
    return out


def _pretokens(run: str, pattern, specials, tokenizer) -> list[str]:
    bare = run[1:] if run[0] == " " else run
    if bare.isalpha() and _COMMON.fullmatch(bare):
        return [run]
    if specials is not None and specials.fullmatch(run):
        return [run]
    if _COMMON.fullmatch(run):
        return pattern.findall(run)
    return [run[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(run)]


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte planes apart, compressed."""
    import zstandard
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(values)) + planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack("<q", raw[:8])[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(4, n).T).view("<u4").reshape(-1)


def _pack_strings(items: list[str]) -> bytes:
    import zstandard
    raw = [x.encode() for x in items]
    sizes = np.array([len(x) for x in raw], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(raw)) + sizes + b"".join(raw))


def _unpack_strings(blob: bytes) -> list[str]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack("<q", raw[:8])[0]
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64) + 8 + 4 * n
    starts = [8 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b].decode() for a, b in zip(starts, ends.tolist())]


def _block(ids, texts, buckets: int, tools) -> dict:
    import xxhash
    pattern, specials, tokenizer = tools
    runs = _Numbered()
    counts, flat, n_bytes = [], [], []
    for text in texts:
        found = _runs(text, specials)
        counts.append(len(found))
        flat.append(np.fromiter(map(runs.__getitem__, found), np.int64, len(found)))
        n_bytes.append(len(text.encode()))
    pieces = _Numbered()
    parts = [[pieces[p] for p in _pretokens(r, pattern, specials, tokenizer)] for r in runs]
    names = list(pieces)
    bucket = np.fromiter((xxhash.xxh32_intdigest(p.encode()) % buckets for p in names), np.int64, len(names))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    per_run = np.fromiter(map(len, parts), np.int64, len(parts))
    run_at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(per_run, out=run_at[1:])
    run_pieces = place[np.fromiter((p for x in parts for p in x), np.int64, run_at[-1])]
    occurrence = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    width = per_run[occurrence]
    start = np.repeat(run_at[occurrence] - (np.cumsum(width) - width), width)
    key = np.repeat(doc, width) * max(1, len(names)) + run_pieces[start + np.arange(len(start))]
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    distinct = key[first]
    # the gap to the key before fits 32 bits as long as a block holds fewer than 2**32 (document, pre-token) cells between two entries
    gap = np.diff(distinct, prepend=0)
    far = np.flatnonzero(gap >= 1 << 32)
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    lists = [_pack_strings([names[i] for i in order[e - s:e]]) for s, e in zip(sizes, ends)]
    return {"ids": ids, "n_bytes": n_bytes, "n_pieces": len(names), "gaps": _pack(gap & 0xFFFFFFFF), "far": far.tolist(),
            "far_by": (gap[far] >> 32).tolist(), "freq": _pack(np.diff(first, append=len(key))), "lists": lists}


def _tools(path):
    import regex
    marks = special_strings(path)
    specials = re.compile("(" + "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")") if marks else None
    return regex.compile(PRETOKEN), specials, _load(path)


def _blocks(path: str, buckets: int, schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext
        tools = _tools(path)
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id"), b.column("text")):
                ids.append(i.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist([{"block": f"{part}-{made}", **_block(ids, texts, buckets, tools)}], schema)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield pa.RecordBatch.from_pylist([{"block": f"{part}-{made}", **_block(ids, texts, buckets, tools)}], schema)
    return run


def _count_lists(path: str):
    """Pieces of every listed pre-token; a pre-token is encoded when its bucket sees it first."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        tokenizer = _load(path)
        bucket, known = None, {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                items = _unpack_strings(r["pieces"])
                new = [x for x in items if x not in known]
                for x, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    known[x] = len(e)
                out.append({"block": r["block"], "bucket": bucket, "counts": _pack(np.array([known[x] for x in items], np.int64))})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _sums(schema: pa.Schema, limit: int):
    def run(batches):
        for b in batches:
            for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                n = np.concatenate([_unpack(c["counts"]) for c in r["counted"]]).astype(np.int64)
                gap = _unpack(r["gaps"]).astype(np.int64)
                gap[np.array(r["far"], np.int64)] += np.array(r["far_by"], np.int64) << 32
                key = np.cumsum(gap)
                width = max(1, r["n_pieces"])
                doc, piece = key // width, key % width
                part = np.zeros(len(key) + 1, np.int64)
                np.cumsum(n[piece] * _unpack(r["freq"]).astype(np.int64), out=part[1:])
                edge = np.searchsorted(doc, np.arange(len(r["ids"]) + 1))
                tokens = part[edge[1:]] - part[edge[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], schema.field("doc_id").type), pa.array(r["n_bytes"], pa.int64()),
                                                  pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())], schema=schema)
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text; other columns are ignored).

    Counts are those of the tokenizer file without added special tokens, truncation or padding; special strings inside a text count as
    the library's default has it. Null texts are empty and have 0 tokens; equal rows each get a row; an empty table gives
    an empty one; a text longer than a block is a block of its own. ``tokenizer_path`` must exist on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType
    buckets = partitions(spark) * BUCKETS_PER_PARTITION
    rows = (f"block string, ids array<{kind.simpleString()}>, n_bytes array<bigint>, n_pieces bigint, gaps binary, far array<bigint>, "
            "far_by array<bigint>, freq binary, lists array<binary>")
    schema = pa.schema([("block", pa.string()), ("ids", pa.list_(to_arrow_type(kind))), ("n_bytes", pa.list_(pa.int64())),
                        ("n_pieces", pa.int64()), ("gaps", pa.binary()), ("far", pa.list_(pa.int64())),
                        ("far_by", pa.list_(pa.int64())), ("freq", pa.binary()), ("lists", pa.list_(pa.binary()))])
    blocks = keep(d.mapInArrow(_blocks(tokenizer_path, buckets, schema), rows), "token-blocks")
    lists = blocks.select("block", F.posexplode("lists").alias("bucket", "pieces"))
    counted = lists.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_count_lists(tokenizer_path), "block string, bucket int, counts binary")
    back = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("counted"))
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return blocks.drop("lists").join(back, "block").mapInArrow(
        _sums(out, limit), f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    import public_tokenizers
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
