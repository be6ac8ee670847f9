"""Toxicity by two Kneser-Ney bigram models of word pieces, one of toxic and one of ordinary documents.

Both classes back off to one set of counts, so an expression that is rare in either class differs little
between them. The difference of the two log-likelihoods is normalised by length over the whole text and
taken for each of the text's most toxic words; a logistic curve fitted on labelled documents that the
models have not seen turns these figures into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, fold, lower, mix, per_doc, span_hash, stored, word_spans

DOCS_PER_CLASS = 3_000  # bound of the labelled sample
CALIBRATE = 4  # one in so many labelled documents fits the curve, the others the models
PIECE = 4  # bytes of a word that make one symbol, so that inflected forms share their stem
DISCOUNT = 0.75
SHARED = 50.0  # added to every piece's shared count
TOP = 4  # words
THRESHOLD = 0.3

_BREAK = np.ones(256, bool)
_BREAK[97:123] = _BREAK[65:91] = _BREAK[128:] = False
_START = np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    unigram: np.ndarray  # (words + 1, 2): backed-off probability by class; the last row is for unknown pieces
    rest: np.ndarray  # (words + 1, 2): mass that a context leaves to the unigrams
    pairs: np.ndarray  # sorted hashes
    seen: np.ndarray  # (pairs + 1, 2): discounted probability
    curve: np.ndarray  # weights of the logistic curve, constant first


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word pieces and of the pieces before them, the index of each word's first piece and of each
    document's first word."""
    starts, ends, first = word_spans(data, offsets, _BREAK)
    count = (ends - starts + PIECE - 1) // PIECE
    behind = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(behind[-1]) - np.repeat(behind[:-1], count)
    at = np.repeat(starts, count) + nth * PIECE
    pieces = span_hash(lower(data), at, np.minimum(at + PIECE, np.repeat(ends, count)))
    pieces = np.where(nth == 0, pieces, mix(pieces))  # the start of a word is another symbol than its middle
    before = np.empty_like(pieces)
    before[1:] = pieces[:-1]
    text_start = behind[first[:-1]]
    before[text_start[text_start < len(pieces)]] = _START
    return pieces, before, behind, first


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _TIMES + words)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, its length where missing."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in blocks(batch.column(1)):
            words, before, behind, first = _pieces(data, offsets)
            label = np.repeat(toxic[row:end], np.diff(behind[first]))
            for value in (0, 1):
                both = np.stack([before[label == value], words[label == value]], axis=1)
                if len(both):
                    pairs, counts = np.unique(both, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "toxic": pa.array(np.full(len(pairs), value, np.int32)), "before": pa.array(pairs[:, 0].astype(np.int64)),
                        "word": pa.array(pairs[:, 1].astype(np.int64)), "n": pa.array(counts.astype(np.int64))})


def _model(pairs: DataFrame) -> Model:
    """``pairs``: before, word, n0, n1. What reaches the driver is bounded by the labelled sample."""
    words = pairs.groupBy("word").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]).toPandas()
    contexts = pairs.groupBy("before").agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)]).toPandas()
    often = pairs.where(F.col("n0") + F.col("n1") >= 2).toPandas()  # single pairs are left to the unigrams
    return fit(words, contexts, often)


def fit(words: pd.DataFrame, contexts: pd.DataFrame, often: pd.DataFrame) -> Model:
    """Discounted and backed-off probabilities from counts by class: kinds of left neighbours per piece (k0, k1),
    occurrences per context (t0, t1) and per pair (n0, n1)."""
    key = words["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    key, kinds = key[order], words[["k0", "k1"]].to_numpy(float)[order]
    total = np.maximum(kinds.sum(axis=0), 1)
    shared = np.append(kinds.sum(axis=1), 0) + SHARED
    shared /= shared.sum()
    above = np.maximum(kinds - DISCOUNT, 0) / total
    unigram = np.concatenate([above, np.zeros((1, 2))]) + np.outer(shared, 1 - above.sum(axis=0))
    known = contexts["before"].to_numpy(np.int64).view(np.uint64)
    sums = np.zeros((len(key) + 1, 2))
    start = np.zeros(2)
    sums[_find(key, known)] = contexts[["t0", "t1"]].to_numpy(float)
    if (known == _START).any():
        start = contexts[["t0", "t1"]].to_numpy(float)[known == _START][0]
    sums[-1] = start  # contexts outside the words: the start of a text
    before = often["before"].to_numpy(np.int64).view(np.uint64)
    at = _find(key, before)
    seen = np.maximum(often[["n0", "n1"]].to_numpy(float) - DISCOUNT, 0) / np.maximum(sums[at], 1)
    rest = np.ones((len(key) + 1, 2))
    for c in (0, 1):
        rest[:, c] -= np.bincount(at, weights=seen[:, c], minlength=len(key) + 1)
    hashed = _pair(before, often["word"].to_numpy(np.int64).view(np.uint64))
    order = np.argsort(hashed)
    return Model(key, unigram, np.clip(rest, 1e-3, 1), hashed[order], np.concatenate([seen[order], np.zeros((1, 2))]), np.zeros(1))


def figures(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document the log-likelihood difference per piece of the whole text, then of its most toxic words."""
    pieces, before, behind, first = _pieces(data, offsets)
    at, of = _find(model.words, pieces), _find(model.words, before)
    rest = np.where(((of < len(model.words)) | (before == _START))[:, None], model.rest[of], 1.0)
    chance = model.seen[_find(model.pairs, _pair(before, pieces))] + rest * model.unigram[at]
    gain = np.log(chance[:, 1]) - np.log(chance[:, 0])
    docs = len(offsets) - 1
    out = np.zeros((docs, 1 + TOP))
    out[:, 0] = per_doc(gain, behind[first]) / np.maximum(np.diff(behind[first]), 1)
    each = per_doc(gain, behind)
    owner = np.repeat(np.arange(docs), np.diff(first))
    order = np.lexsort((-each, owner))
    for i in range(TOP):
        some = first[:-1] + i < first[1:]
        out[some, 1 + i] = np.maximum(each[order[first[:-1][some] + i]], 0)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns ``labels.toxic`` outside the held-out fold.

    A document with several labels is toxic if one says so; null labels and documents are left out. About
    ``DOCS_PER_CLASS`` documents of each class, chosen by a hash of doc_id, bound the fit.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold() != 2).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, DOCS_PER_CLASS / max(sizes.get(1, 1), 1))).otherwise(
        min(1.0, DOCS_PER_CLASS / max(sizes.get(0, 1), 1)))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < rate * (1 << 30))
    sample = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").join(
        F.broadcast(chosen), "id")  # at most about twice DOCS_PER_CLASS ids
    later = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(CALIBRATE)) == 0
    counted = sample.where(~later).select("toxic", "text").mapInArrow(
        _count, "toxic int, before long, word long, n long")
    model = _model(stored(counted.groupBy("before", "word").agg(
        *[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]), "pairs"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                x = figures(held.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *[pa.array(c) for c in np.ascontiguousarray(x.T)]],
                    names=["toxic", *[f"x{i}" for i in range(x.shape[1])]])

    schema = "toxic int, " + ", ".join(f"x{i} double" for i in range(1 + TOP))
    points = sample.where(later).select("toxic", "text").mapInArrow(measure, schema).toPandas().to_numpy(float)
    model.curve = np.zeros(2 + TOP)
    toxic = points[:, 0] if len(points) else np.zeros(0)
    if 0 < toxic.sum() < len(toxic):
        drawn = {c: max((toxic == c).sum(), 1) for c in (0, 1)}
        weight = np.where(toxic == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
        model.curve = _logistic(points[:, 1:], toxic, weight * len(points) / weight.sum())
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted per row.

    Null and empty texts have all figures 0 and so the curve's constant; without any usable labels every
    score is 0.5. Null doc_id counts as not held out. Repeated rows get equal scores.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(), F.lit(0)) == 2).alias("held_out"), "text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(2)):
                x = figures(m, data, offsets)
                chance = 1 / (1 + np.exp(-np.clip(m.curve[0] + x @ m.curve[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(chance),
                     pa.array((chance >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return given.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def rate_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels and scores every row."""
    return score(documents, train(documents, labels))
