"""Quality rules, lines first: failing lines go, then documents that lose too much text.

A line fails if it is boilerplate (a licence, cookie, script or rights notice), navigation (items between bars or arrows), or
badly punctuated (no closing punctuation and none inside, or marks and symbols on most of its words). A line of prose that is
merely cut off stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meshspark.llm.shared import (SPACE, buffer_of, mixed, ngram_hashes, per_row, query, read, sliced, word_hashes, words_of)

MIN_WORDS = 50
MAX_LOST = 0.4
BOILERPLATE = ("licensed under", "the mit license", "general public license", "all rights reserved", "copyright", "cookie",
               "privacy policy", "terms of use", "terms of service", "javascript", "lorem ipsum", "sign up for", "click here",
               "subscribe to", "powered by")
NAVIGATION = re.compile(r"(?:^|\s)[|»›>·•](?=\s|$)")
CLOSED = tuple(".!?…:;\"'”’»)。！？")
INNER = ".!?,;:"
NOISY = re.compile(r"!{2,}|[#*$%&|<>]")
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1

METRICS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("lost_words", T.LongType()),
    T.StructField("n_boilerplate", T.LongType()), T.StructField("n_navigation", T.LongType()),
    T.StructField("n_punctuation", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())])


def line_verdict(line: str, words: int, boilerplate: tuple = BOILERPLATE, marked: bool = True) -> str:
    """'' for a line to keep, else the rule it fails. Lines without a word are kept."""
    if boilerplate:
        low = line.lower()
        if any(p in low for p in boilerplate):
            return "boilerplate"
    if "|" in line or "»" in line or "›" in line or ">" in line or "·" in line or "•" in line:
        if 4 * len(NAVIGATION.findall(line)) > words:
            return "navigation"
    if marked and 2 * len(NOISY.findall(line)) > words:
        return "punctuation"
    if not line.rstrip().endswith(CLOSED) and not any(c in line for c in INNER):
        return "punctuation"
    return ""


def _lines(text: str) -> tuple[int, int, dict, str]:
    """Lines equal to an earlier one, words lost, lines failed by rule, and what is left."""
    seen, left, dup, lost = set(), [], 0, 0
    failed = {"boilerplate": 0, "navigation": 0, "punctuation": 0}
    low = text.lower()
    phrases = tuple(p for p in BOILERPLATE if p in low)
    marked = "!!" in text or any(c in text for c in "#*$%&|<>")
    for line in text.split("\n"):
        words = len(line.encode().split())
        if not words:
            left.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        rule = line_verdict(line, words, phrases, marked)
        if rule:
            failed[rule] += 1
            lost += words
        else:
            left.append(line)
    return dup, lost, failed, "\n".join(left) if lost else text


def _repeats(data, starts, ends, row, n) -> np.ndarray:
    """Per row, the words inside 3-word windows that occur twice or more in the row."""
    h = word_hashes(data, starts, ends)
    g, first = ngram_hashes(h, row, 3)
    if not len(g):
        return np.zeros(n, np.int64)
    g = mixed(g ^ (row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(g)
    g = g[order]
    same = g[1:] == g[:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for i in range(3):
        hit[first[twice] + i] = True
    return np.bincount(row[hit], minlength=n)


def _measure(batches):
    for b in sliced(batches):
        n = b.num_rows
        data, offsets = buffer_of(b.column("text"))
        starts, ends, row = words_of(data, offsets)
        n_words = np.bincount(row, minlength=n)
        chars = per_row(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
        symbols = per_row(_SYMBOL[data], offsets)
        repeats = _repeats(data, starts, ends, row, n)
        failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
        lines = [_lines(t or "") for t in b.column("text").to_pylist()]
        lost = np.array([x[1] for x in lines], np.int64)
        kept = ~failed & (lost <= MAX_LOST * n_words)
        out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": [x[0] for x in lines],
               "n_repeat_words": repeats, "base_failed": failed, "lost_words": lost,
               **{f"n_{k}": [x[2][k] for x in lines] for k in ("boilerplate", "navigation", "punctuation")}, "kept": kept,
               "clean_text": [x[3] for x in lines]}
        own = [c for c in b.schema.names if c not in out]
        arrays = [b.column(c) for c in own] + [pa.array(out[f.name], _ARROW[f.dataType.simpleString()]) for f in METRICS]
        yield pa.RecordBatch.from_arrays(arrays, names=own + METRICS.names)


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def measure(docs: DataFrame) -> DataFrame:
    """Every document with its word and line figures, the verdict and the text without failing lines.

    Adds the columns of METRICS (input columns of those names are replaced). Null or empty texts have no words and fail the
    base rule; a text of any length is read whole; equal rows get equal results; an empty table gives an empty one.
    A document is kept if it passes the base rule and failing lines hold at most 40 % of its words. No shuffle.
    """
    d = docs.drop(*METRICS.names)
    return d.mapInArrow(_measure, T.StructType([*d.schema.fields, *METRICS.fields]))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``; n_chars follows the text."""
    m = measure(docs).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        m = m.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return m.select(*docs.columns)


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return measure(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
