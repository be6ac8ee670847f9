"""Language identification by bit-sliced Bloom filters of n-grams.

One table of masks serves all languages: bit ``l`` of a cell belongs to language ``l``. An n-gram's cells
are combined with AND, and the bits left are the languages that contain it. A text's language is the one
with the most n-grams after the expected false positives of each language's bits are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, fold, mix, per_doc, stored

GRAM = 5  # bytes, over letters and single spaces
CELLS = 1 << 20
PROBES = 3
DOCS_PER_LANG = 2_000  # bound of the labelled sample
MIN_COUNT = 3
MIN_RATIO = 0.1  # a language contains an n-gram at least so often, against the language that has it most often
UNKNOWN = "und"
MIN_COVERAGE = 0.3  # texts with less of what their language reaches are rejected by ``keep``

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]
    cells: np.ndarray  # (CELLS, words) of 64 languages each
    false_rate: np.ndarray
    default: int
    reach: np.ndarray  # share of a language's own n-grams that it would still hold without one occurrence of them


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled n-grams of letters and single spaces; index of each document's first one."""
    plain = _FOLD[data]
    gap = plain == 32
    again = np.zeros(len(plain), bool)
    again[1:] = gap[1:] & gap[:-1]
    again[offsets[:-1][offsets[:-1] < len(plain)]] = False
    used = np.zeros(len(plain) + 1, np.int64)
    np.cumsum(~again, out=used[1:])
    plain, offsets = plain[~again], used[offsets]
    count = max(len(plain) - GRAM + 1, 0)
    value = np.zeros(count, np.uint64)
    for i in range(GRAM):
        value = (value << np.uint64(8)) | plain[i:i + count]
    last = np.repeat(offsets[1:], np.diff(offsets))[:count]
    at = np.flatnonzero(np.arange(count) + GRAM <= last)
    return mix(value[at]), np.searchsorted(at, offsets)


def _probes(grams: np.ndarray) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(PROBES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in blocks(batch.column(1)):
            grams, first = _grams(data, offsets)
            owner = np.repeat(langs[row:end], np.diff(first))
            for lang in np.unique(owner):
                values, counts = np.unique(grams[owner == lang], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang_no": pa.array(np.full(len(values), lang, np.int32)), "gram": pa.array(values.astype(np.int64)),
                    "n": pa.array(counts.astype(np.int64))})


def train(documents: DataFrame) -> Model:
    """Learns from ``text`` and non-null ``lang`` outside the held-out fold.

    About ``DOCS_PER_LANG`` documents a language, chosen by a hash of doc_id, bound the fit; what reaches the
    driver is one row per cell and 64 languages. Every label is learned.
    """
    spark = documents.sparkSession
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(), F.lit(0)) != 2))
    found = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in sorted(found, key=lambda r: r["lang"])}
    langs = list(sizes)
    words = (len(langs) + 63) // 64
    cells = np.zeros((CELLS, max(words, 1)), np.uint64)
    reach = np.zeros(len(langs))
    if langs:
        share = spark.createDataFrame([(lang, i, min(1.0, DOCS_PER_LANG / sizes[lang])) for i, lang in enumerate(langs)],
                                      "lang string, lang_no int, rate double")
        draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
        sample = usable.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(draw).select("lang_no", "text")
        counts = stored(sample.mapInArrow(_count, "lang_no int, gram long, n long").groupBy("gram", "lang_no").agg(F.sum("n").alias("n")),
                        "grams")  # read three times
        total = counts.groupBy(F.col("lang_no").alias("no")).agg(F.sum("n").alias("total"))
        rated = counts.join(F.broadcast(total), F.col("no") == F.col("lang_no")).withColumn("f", F.col("n") / F.col("total"))
        most = rated.groupBy(F.col("gram").alias("g")).agg(F.max("f").alias("most"))
        held = stored(rated.join(most, F.col("g") == F.col("gram")).where(
            (F.col("n") >= MIN_COUNT) & (F.col("f") >= MIN_RATIO * F.col("most"))).select("gram", "lang_no", "n", "f"), "held")
        for r in held.where(F.col("n") > MIN_COUNT).groupBy("lang_no").agg(F.sum("f").alias("reach")).collect():
            reach[r["lang_no"]] = r["reach"]
        step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
        probes = F.array(*[(F.col("gram") + F.lit(i).cast("long") * step).bitwiseAND(F.lit(CELLS - 1).cast("long"))
                           for i in range(PROBES)])
        bit = F.expr("shiftleft(1L, lang_no % 64)")
        rows = held.select(F.explode(probes).alias("cell"), F.expr("lang_no div 64").alias("word"), bit.alias("bit")).groupBy(
            "cell", "word").agg(F.bit_or("bit").alias("bits")).toArrow()  # whatever the session's settings, no object per row in the driver
        for batch in rows.to_batches():
            cell, word, bits = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            cells[cell, word] = bits.view(np.uint64)
    fill = np.array([np.mean((cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
    default = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i), default=-1)
    return Model(langs, cells, fill ** PROBES, default, reach)


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language, its share of the corrected counts and of the text's n-grams, per document."""
    grams, first = _grams(data, offsets)
    docs = len(offsets) - 1
    if not model.langs:
        return np.full(docs, -1), np.zeros(docs), np.zeros(docs)
    where = _probes(grams)
    masks = model.cells[where[0]]
    for cell in where[1:]:
        masks = masks & model.cells[cell]
    counts = np.zeros((docs, len(model.langs)))
    n = np.diff(first)
    for i, rate in enumerate(model.false_rate):
        hits = per_doc((masks[:, i // 64] >> np.uint64(i % 64)).astype(np.uint8) & 1, first)
        counts[:, i] = np.maximum(hits - n * rate, 0) / max(1 - rate, 1e-9)
    best = counts.argmax(axis=1)
    total = counts.sum(axis=1)
    share = np.divide(counts.max(axis=1), total, out=np.zeros(docs), where=total > 0)
    coverage = np.divide(counts.max(axis=1), n, out=np.zeros(docs), where=n > 0)
    return np.where(total > 0, best, model.default), share, coverage


def _row_key() -> Column:
    """One number for doc_id, text and lang, null or not."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull(), "lang", F.col("lang").isNull())


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a key of the row, coverage and the reach it is held against, per row.

    Null text and text without a letter give ``und`` with score 0; so does everything if no label was learned.
    Ties go to the language first in code point order; a text without a known n-gram gets the most frequent
    language with score 0. Null doc_id counts as not held out. Repeated rows get equal results. ``coverage`` is the
    share of the text's n-grams that its language holds; ``reach`` is that of the label's own texts, 0 for a label that
    was not learned, and without a label that of the language found.
    """
    model = model or train(documents)
    held = documents.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(), F.lit(0)) == 2).alias("held_out"),
                             _row_key().alias("key"), letters.alias("letters"), "text",
                             F.col("lang").cast("string").alias("lang"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, UNKNOWN], object)
        reach = dict(zip(m.langs, m.reach))
        for batch in batches:
            has = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, data, offsets in blocks(batch.column(4)):
                best, share, coverage = score_block(m, data, offsets)
                part, known = batch.slice(row, end - row), has[row:end]
                labels = [names[i] if label is None else label for i, label in zip(best, part.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names[np.where(known, best, -1)], pa.string()),
                     pa.array(np.where(known, share, 0.0)), part.column(2), pa.array(np.where(known, coverage, 0.0)),
                     pa.array([float(reach.get(label, 0.0)) for label in labels])],
                    names=["doc_id", "held_out", "lang_pred", "score", "key", "coverage", "reach"])

    return given.mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double, key long, coverage double, reach double")


def languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score per row. An empty table gives an empty result."""
    return identify(documents.select("doc_id", "text", "lang")).drop("key", "coverage", "reach")


def keep(documents: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows whose text is in a language, all columns as they were.

    The best language has to hold ``min_coverage`` times the share of the text's n-grams that the texts of its label
    reach. How many other languages hold them too does not count, and texts under a label with few or no
    n-grams learned stay, as nothing speaks against them; texts without a letter go.
    """
    unsure = identify(documents).where((F.col("lang_pred") == UNKNOWN) | (F.col("coverage") < min_coverage * F.col("reach")))
    rejected = stored(unsure.select(F.col("key").alias("__key")).distinct(), "rejected")
    return documents.withColumn("__row", _row_key()).join(rejected, F.col("__row") == F.col("__key"), "left_anti").drop("__row")
