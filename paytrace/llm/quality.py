"""Quality rules: base counts per document and line frequency across the documents of a source.

A line's normal form is its lower-cased words. Lines that too many different texts of one source share
are removed; a document with too few words left is rejected. ``judge`` gives the verdicts, ``keep`` the
documents that stay, without these lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, grams, lists, lower, per_doc, scratch, span_hash, stored, word_spans

MIN_WORDS = 20
REPEAT_WORDS = 8
MAX_REPEAT_PERCENT = 30
LINE_DOCS = 20  # a line is common from so many different texts of its source on ...
LINE_SHARE_PERCENT = 10  # ... if they are more than this share of the source's texts
MIN_LEFT_PERCENT = 30  # a document with fewer of its words left is depleted

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ("doc_id long, source string, key long, text_hash long, " + ", ".join(f"{m} long" for m in _MEASURES)
           + ", lines array<long>, line_words array<int>")


def _seen_before(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the owner holds the value earlier, and whether it holds it more than once."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    same = np.zeros(len(values), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (values[order][1:] == values[order][:-1])
    again = np.zeros(len(values), bool)
    again[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    twice = np.zeros(len(values), bool)
    twice[order] = either
    return again, twice


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per document; line hashes and word counts, with the index of each document's first line."""
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=solid[1:])
    chars = solid[ends] - solid[starts]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks + 1]))  # where lines begin
    line_start = edges[edges < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_first = np.searchsorted(starts, line_start)
    line_last = np.searchsorted(starts, line_end)
    used = line_last > line_first
    line_start, line_end, line_first, line_last = line_start[used], line_end[used], line_first[used], line_last[used]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    bare_end = line_end - (data[line_end - 1] == 10)
    again, _ = _seen_before(owner, span_hash(data, line_start, bare_end))
    docs = len(offsets) - 1

    raw = span_hash(data, starts, ends)
    windows, at = grams(raw, first, REPEAT_WORDS)
    _, twice = _seen_before(np.searchsorted(first, at, "right") - 1, windows)
    covered = np.zeros(len(raw) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + REPEAT_WORDS, -1)
    small = span_hash(lower(data), starts, ends)
    line_hash = span_hash(small, line_first, line_last).astype(np.int64)
    counts = {
        "n_words": n_words, "word_chars": per_doc(chars, first), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(owner[again], minlength=docs),
        "n_repeat_words": per_doc(np.cumsum(covered)[:-1] > 0, first),
    }
    return counts, line_hash, (line_last - line_first).astype(np.int32), np.searchsorted(owner, np.arange(docs + 1))


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
            counts, hashes, words, first = _measure(data, offsets)
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_pydict(
                {c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "source", "key", "text_hash")}
                | {m: pa.array(counts[m].astype(np.int64)) for m in _MEASURES}
                | {"lines": lists(hashes, first), "line_words": lists(words, first)})


def row_key() -> Column:
    """One number for doc_id, source and text, null or not: rows that share it are repeats of one row."""
    return F.xxhash64("doc_id", "source", "text", F.col("text").isNull())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def common_lines(measured: DataFrame, docs: int = LINE_DOCS, share: int = LINE_SHARE_PERCENT) -> DataFrame:
    """(source, line) of lines in at least ``docs`` different texts of a source and over ``share`` % of them.

    Exact copies count once. Counting is two partial aggregations, so no source or line meets in one task.
    """
    of = measured.select("source", "text_hash", "lines")
    seen = of.select("source", "text_hash", F.explode("lines").alias("line")).distinct()
    counts = seen.groupBy("source", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= docs)
    size = of.select("source", "text_hash").distinct().groupBy(F.col("source").alias("s")).agg(F.count("*").alias("texts"))
    return counts.join(size, F.col("s").eqNullSafe(F.col("source"))).where(
        F.col("docs") * 100 > F.col("texts") * share).select("source", "line", "docs", "texts")


def _verdicts(documents: DataFrame, docs: int, share: int) -> tuple[DataFrame, DataFrame]:
    """What ``judge`` gives; key and place of each common line (counted over lines with words) and its words."""
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             "text", row_key().alias("key"), F.xxhash64("text").alias("text_hash"))
    measured = stored(given.mapInArrow(_measures, _SCHEMA), "measured")
    common = stored(common_lines(measured, docs, share).select(F.col("source").alias("s"), "line"), "lines")
    each = measured.select("key", "source", F.posexplode(F.arrays_zip("lines", "line_words")).alias("at", "l")).select(
        "key", "source", "at", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = each.join(common, F.col("s").eqNullSafe(F.col("source")) & (each["line"] == common["line"]))
    hits = stored(hit.select("key", "at", "words").distinct(), "hits")
    removed = hits.groupBy("key").agg(F.sum("words").alias("words_removed"))
    left = F.col("n_words") - F.col("words_removed")
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * MIN_LEFT_PERCENT)
    verdicts = (
        measured.join(removed, "key", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ((F.col("words_removed") == 0) | ~depleted))
        .select("doc_id", *_MEASURES, "base_failed", "kept", "words_removed", "key")
    )
    return verdicts, hits


def judge(documents: DataFrame, docs: int = LINE_DOCS, share: int = LINE_SHARE_PERCENT) -> DataFrame:
    """Per row: doc_id, the counts, words_removed, base_failed and kept.

    A document that passes the base rules is rejected if its common lines leave fewer than ``MIN_WORDS``
    words or ``MIN_LEFT_PERCENT`` % of its words. Null or empty text has no words and fails the base rules; null is a
    source of its own; repeated rows get equal verdicts; an empty table gives an empty result; only
    doc_id, source and text are read.
    """
    return _verdicts(documents, docs, share)[0]


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines at these places, counted over lines with words."""
    left, at = [], 0
    for line in text.split("\n"):
        used = bool(line.strip(" \t\n\v\f\r"))
        if not used or at not in gone:
            left.append(line)
        at += used
    return "\n".join(left)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [without_lines(t.as_py(), set(g.as_py())) for t, g in zip(batch.column(at), batch.column("__gone"))]
        names = [c for c in batch.schema.names if c != "__gone"]
        columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, batch.schema.field(at).type)}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)


def keep(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that pass, their common lines removed from ``text``, other columns as they were.

    ``n_chars``, where there is one, follows the text. Only rows that lose lines go through Python.
    """
    with scratch() as kept:
        verdicts, hits = _verdicts(documents, LINE_DOCS, LINE_SHARE_PERCENT)
        rejected = kept(stored(verdicts.where("NOT kept").select(F.col("key").alias("__key")).distinct(), "rejected"))
        gone = kept(stored(hits.groupBy(F.col("key").alias("__key")).agg(F.collect_list("at").alias("__gone")), "gone"))
    # joined in one way at every size: whether these tables are small says nothing about the next input
    rejected, gone = rejected.hint("merge"), gone.hint("merge")
    passed = documents.withColumn("__row", row_key()).join(rejected, F.col("__row") == F.col("__key"), "left_anti")
    same = passed.join(gone, F.col("__row") == F.col("__key"), "left_anti").drop("__row")
    less = passed.join(gone, F.col("__row") == F.col("__key")).drop("__row", "__key")
    return same.unionByName(less.mapInArrow(_cleaned, documents.schema))
