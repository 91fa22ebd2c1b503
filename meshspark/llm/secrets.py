"""Secret scans through a ledger of blobs: a text is scanned once per rule version, however many paths hold it."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshspark.llm.shared import query, read, sliced
from meshspark.session import scratch_path

# (kind, version, pattern, group that must be long enough, least characters); order is the order of kinds at one start.
_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
# To the END mark. Without one before the next BEGIN mark: over header lines and lines of base64 alone, with plain or escaped line feeds
# (a last line at the end of the text may be short), so that prose which only names the mark is left as it is.
_MARK = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_FEED = r"[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*"
_HEADER = r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+"
_BODY = f"(?:(?:{_FEED})++(?:{_HEADER}|=?[A-Za-z0-9+/]{{16,}}+={{0,2}}|=?[A-Za-z0-9+/]++={{0,2}}(?=\\s*\\Z)|=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/])))++(?:{_FEED})*+"
_PEM = f"-----BEGIN {_MARK}(?:(?:(?!-----(?:BEGIN|END) {_MARK}).)*+-----END {_MARK}|{_BODY})"
RULES = (
    ("assign", "1", "(" + _KEY + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "1", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "1", "[0-9a-f]{16,}", 0, 16),
    ("pem", "3", _PEM, 0, 1),
    ("jwt", "1", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", "1", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "1", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:bigint,end:bigint>>"


def rule_ids(rules=RULES) -> list[str]:
    return [f"{r[0]}@{r[1]}" for r in rules]


def new_ledger(spark: SparkSession, path: str) -> str:
    """An empty ledger table at ``path``, in storage that all executors share."""
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _scanner(rules):
    ids = rule_ids(rules)
    compiled = {i: (re.compile(r[2], re.ASCII | re.DOTALL), r[3], r[4]) for i, r in zip(ids, rules)}

    def scan(batches):
        for b in sliced(batches):
            found = []
            for text, todo in zip(b.column("text").to_pylist(), b.column("todo").to_pylist()):
                spans = []
                for i in todo:
                    pattern, group, least = compiled[i]
                    for m in pattern.finditer(text):
                        if m.end(group) - m.start(group) >= least:
                            spans.append({"rule": i, "start": m.start(), "end": m.end()})
                found.append(spans)
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("todo"), pa.array(found, kind)],
                                             names=["blob", "rules", "findings"])
    return scan


def blob_id():
    """Content address of a text; null and empty texts share one."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def update(docs: DataFrame, ledger: str, rules=RULES) -> None:
    """Scan the (blob, rule version) pairs that the ledger does not hold and append them.

    Copies meet on their content address before the scan, combined inside each task first. The job appends whole batches
    through Spark's committer; a pair recorded twice by two writers is harmless, since readers merge findings as sets.
    """
    spark = docs.sparkSession
    ids = rule_ids(rules)
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    blobs = docs.select(blob_id().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    todo = blobs.join(seen, "blob", "left").withColumn(
        "todo", F.array_except(F.array(*[F.lit(i) for i in ids]), F.coalesce("_seen", F.array().cast("array<string>")))) \
        .filter(F.size("todo") > 0).select("blob", "text", "todo")
    todo.mapInArrow(_scanner(rules), LEDGER).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(blob, findings array<struct<start, place, end, kind>>) of the given rule versions, sorted; blobs without any are left out."""
    order = F.create_map(*[x for k, i in enumerate(rule_ids(rules)) for x in (F.lit(i), F.lit(k))])
    kinds = F.create_map(*[x for i, r in zip(rule_ids(rules), rules) for x in (F.lit(i), F.lit(r[0]))])
    one = spark.read.schema(LEDGER).parquet(ledger).filter(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")) \
        .filter(F.col("f.rule").isin(rule_ids(rules)))
    return one.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
        F.col("f.start").alias("start"), order[F.col("f.rule")].alias("place"), F.col("f.end").alias("end"),
        kinds[F.col("f.rule")].alias("kind")))).alias("findings"))


def scan(docs: DataFrame, ledger: str, rules=RULES, columns: list[str] | None = None) -> DataFrame:
    """Every document (path) with the findings of its content: ``columns`` of docs plus ``findings``, sorted by start and kind.

    Null and empty texts have none, texts are read whole, equal texts are scanned once and found at all their rows, an empty
    table gives an empty one. A column named findings in ``docs`` is replaced. ``columns`` defaults to all but text.
    """
    update(docs, ledger, rules)
    columns = [c for c in (columns or [c for c in docs.columns if c != "text"]) if c != "findings"]
    found = findings(docs.sparkSession, ledger, rules).withColumnRenamed("findings", "_findings")
    none = F.array().cast(found.schema["_findings"].dataType)
    return docs.select(*columns, blob_id().alias("_blob")).join(found.withColumnRenamed("blob", "_blob"), "_blob", "left") \
        .select(*columns, F.coalesce("_findings", none).alias("findings"))


def _redacted(batches):
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("findings").to_pylist()):
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        names = [c for c in b.schema.names if c != "findings"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names=names)


def redact(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; overlapping spans become one. n_chars follows the text.

    Null texts stay null, empty and very long ones are read whole, equal rows all come back, an empty table gives an empty one. A column
    named findings is replaced.
    """
    d = scan(docs, ledger, rules, docs.columns)
    out = d.mapInArrow(_redacted, docs.drop("findings").schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@query("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, new_ledger(spark, scratch_path(spark, "secret-ledger")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda k: F.size(F.filter("findings", lambda s: s.kind == k)).cast("long")
    base = F.filter("findings", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("findings")).alias("spans"))
