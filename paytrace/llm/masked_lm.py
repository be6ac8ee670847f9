"""Language model scores by masked pseudo-likelihood.

A small window network predicts every word from the words on both sides: the embeddings of ``SIDE`` words to
the left and right, one table per position, add up to a hidden layer; the output is a class of the
vocabulary and a word of that class. The sum of the words' conditional log-probabilities scores a document.

The vocabulary comes from the counts of all words of all documents. Training masks every position (``MASK``)
of all documents, spread over ``ROUNDS`` rounds: each task starts from the shared weights and makes steps over its own
documents, and the weights are averaged by trained positions, in levels of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, lower, mix, per_doc, span_hash, stored, word_spans

CLASSES = 64
PER_CLASS = 64
SIZE = CLASSES * PER_CLASS
RARE = 256  # ids that words outside the vocabulary share, by hash
EDGE = SIZE  # id of the places before and behind a text
SIDE = 2
DIM = 16
MASK = 1.0  # share of all positions that training masks; each in one round
ROUNDS = 2
STEP = 0.1
BATCH = 1_024
PART = 16_384  # positions scored at a time
FAN_IN = 16  # weights averaged by one task of the tree
FLUSH = 1 << 20  # distinct words a counting task holds at most
_BREAK = np.ones(256, bool)
_BREAK[97:123] = _BREAK[65:91] = _BREAK[48:58] = _BREAK[128:] = False


@dataclass
class Words:
    hashes: np.ndarray  # sorted
    ids: np.ndarray
    chance: np.ndarray  # share of each id among all words


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, _BREAK)
    return span_hash(lower(data), starts, ends), first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "n": pa.array(n)})

    words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            new, count = np.unique(_hashes(data, offsets)[0], return_counts=True)
            merged, which = np.unique(np.concatenate([words, new]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n, count]), minlength=len(merged)).astype(np.int64)
            words = merged
            if len(words) > FLUSH:
                yield out(words, n)
                words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield out(words, n)


def vocabulary(documents: DataFrame) -> Words:
    """The most frequent words of all documents; the driver gets ``SIZE - RARE`` of them and one row per rare id."""
    counts = stored(documents.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(SIZE - RARE).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    chance = np.full(SIZE, 0.5)
    chance[RARE:RARE + len(top)] = [r["n"] for r in top]
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    chance[:RARE] += max(total - sum(r["n"] for r in top), 0) / RARE
    order = np.argsort(hashes)
    return Words(hashes[order], (np.arange(len(top)) + RARE)[order], chance / chance.sum())


def _ids(words: Words, hashes: np.ndarray) -> np.ndarray:
    rare = (mix(hashes) % np.uint64(RARE)).astype(np.int64)
    if not len(words.hashes):
        return rare
    at = np.minimum(np.searchsorted(words.hashes, hashes), len(words.hashes) - 1)
    return np.where(words.hashes[at] == hashes, words.ids[at], rare)


def _context(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids of the words around each word, ``EDGE`` beyond the text."""
    count = np.diff(first)
    padded = np.full(len(ids) + SIDE * (len(count) + 1), EDGE, np.int32)
    at = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(count) + 1), count)
    padded[at] = ids
    return np.stack([padded[at + shift] for shift in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def start_weights(words: Words, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random embeddings; the output begins with the share of each word."""
    draw = np.random.default_rng(seed)
    chance = words.chance.reshape(PER_CLASS, CLASSES).T  # id % CLASSES is the class
    by_class = chance.sum(axis=1)
    return {
        "look": draw.normal(0, 0.1, (2 * SIDE, SIZE + 1, DIM)).astype(np.float32), "bend": np.zeros(DIM, np.float32),
        "cls": np.zeros((CLASSES, DIM), np.float32), "cls0": np.log(by_class).astype(np.float32),
        "word": np.zeros((CLASSES, PER_CLASS, DIM), np.float32), "word0": np.log(chance / by_class[:, None]).astype(np.float32),
    }


def _hidden(w: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    total = w["bend"] + w["look"][0].take(context[:, 0], axis=0)
    for i in range(1, context.shape[1]):
        total += w["look"][i].take(context[:, i], axis=0)
    return np.tanh(total, out=total)


def _exp(x: np.ndarray) -> np.ndarray:
    """Logits of this network are far from overflow; the bound only guards against a failed training."""
    if x.max(initial=0.0) > 60.0:
        np.minimum(x, 60.0, out=x)
    return np.exp(x, out=x)


def _chances(h: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Chances of a softmax, not yet divided by their sums."""
    logits = h @ table.T
    logits += bias
    return _exp(logits)


def _over(x: np.ndarray) -> np.ndarray:
    """Sum of each row; a product is faster here than ``sum``."""
    return x @ np.ones(x.shape[1], np.float32)


def _by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    edge = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        if edge[c] < edge[c + 1]:
            yield c, order[edge[c]:edge[c + 1]]


def log_chances(w: dict[str, np.ndarray], ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log-probability of each word given the words around it."""
    out = np.zeros(len(ids), np.float32)
    for at in range(0, len(ids), PART):
        part = slice(at, at + PART)
        h, cls, nth = _hidden(w, context[part]), ids[part] % CLASSES, ids[part] // CLASSES
        chance = _chances(h, w["cls"], w["cls0"])
        got = chance[np.arange(len(h)), cls] / _over(chance)
        for c, rows in _by_class(cls):
            chance = _chances(h.take(rows, axis=0), w["word"][c], w["word0"][c])
            got[rows] *= chance[np.arange(len(rows)), nth[rows]] / _over(chance)
        out[part] = np.log(np.maximum(got, 1e-30))
    return out.astype(np.float64)


def train_step(w: dict[str, np.ndarray], past: dict[str, np.ndarray], ids: np.ndarray, context: np.ndarray) -> None:
    """One step over one position at least, with rates that shrink with past gradients; changes ``w`` and ``past``.

    Positions are sorted by class, so that only the three products per class are made class by class.
    """
    order = np.argsort((ids % CLASSES).astype(np.uint8), kind="stable")
    ids, context = ids[order], context[order]
    cls, nth, each = ids % CLASSES, ids // CLASSES, np.arange(len(ids))
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    met, edge = np.flatnonzero(np.diff(ends)), ends.tolist()
    h = _hidden(w, context)
    top = _chances(h, w["cls"], w["cls0"])
    top /= _over(top)[:, None]
    top[each, cls] -= 1
    back = top @ w["cls"]

    low = np.empty((len(ids), PER_CLASS), np.float32)
    parts = [(w["word"][c], h[edge[c]:edge[c + 1]], low[edge[c]:edge[c + 1]], c) for c in met.tolist()]
    for word, mine, chance, _ in parts:
        np.dot(mine, word.T, out=chance)
    low += w["word0"].take(cls, axis=0)
    _exp(low)
    low /= _over(low)[:, None]
    low[each, nth] -= 1
    inner, grad = np.empty_like(back), np.zeros((CLASSES, PER_CLASS, DIM), np.float32)
    for word, mine, chance, c in parts:
        np.dot(chance, word, out=inner[edge[c]:edge[c + 1]])
        np.dot(chance.T, mine, out=grad[c])
    back += inner
    back *= 1 - h * h

    def move(name: str, grad: np.ndarray) -> None:
        past[name] += grad * grad
        grad *= STEP
        grad /= np.sqrt(past[name])
        w[name] -= grad

    bias = np.zeros((CLASSES, PER_CLASS), np.float32)
    bias[met] = np.add.reduceat(low, ends[met], axis=0)
    move("word", grad)
    move("word0", bias)
    move("cls", top.T @ h)
    move("cls0", top.sum(axis=0))
    move("bend", back.sum(axis=0))
    # the tables of all positions lie one behind the other, so that one sort finds the rows of every word in each of them
    look, held = (x["look"].reshape(-1, x["look"].shape[2]) for x in (w, past))
    place = (context + np.arange(context.shape[1]) * w["look"].shape[1]).T.ravel()
    order = np.argsort(place.astype(np.uint16), kind="stable")
    seen = place[order]
    start = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
    used, count = seen[start], np.diff(start, append=len(seen))
    each = back.take(order % len(ids), axis=0)
    grad, several = each.take(start, axis=0), count > 1
    if several.any():  # most words occur once and need no sum
        size = count[several]
        grad[several] = np.add.reduceat(each[np.repeat(several, count)], np.cumsum(size) - size, axis=0)
    squares = held.take(used, axis=0)
    squares += grad * grad
    held[used] = squares
    grad *= STEP
    grad /= np.sqrt(squares, out=squares)
    look[used] = look.take(used, axis=0) - grad


def _packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32)


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a partition's weights; one row is in memory at a time."""
    total, seen, task = None, 0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column(1)[i].as_py()
            flat = np.frombuffer(batch.column(2)[i].as_buffer(), np.float32).astype(np.float64) * n
            total, seen, task = (flat if total is None else total + flat), seen + n, batch.column(0)[i].as_py()
    if seen:
        yield _row(task, seen, (total / seen).astype(np.float32))


def _row(task: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "task": pa.array([task], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([flat.tobytes()], pa.binary())})


_WEIGHTS = "task int, n long, weights binary"


def train(documents: DataFrame, words: Words) -> dict[str, np.ndarray]:
    """Weights after ``ROUNDS`` rounds over all documents. The driver gets ``FAN_IN`` sets of weights at most."""
    spark = documents.sparkSession
    weights = start_weights(words)
    held_words = spark.sparkContext.broadcast(words)
    for number in range(ROUNDS):
        held = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], number: int = number, held=held) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            w = {k: v.copy() for k, v in held.value.items()}
            past = {k: np.full(v.shape, 1e-2, np.float32) for k, v in w.items()}
            seen = 0
            for batch in batches:
                number_of = batch.column(0).fill_null(0).to_numpy()
                for row, end, data, offsets in blocks(batch.column(1)):
                    hashes, first = _hashes(data, offsets)
                    ids = _ids(held_words.value, hashes)
                    count = np.diff(first)
                    place = np.arange(len(ids)) - np.repeat(first[:-1], count)
                    doc = np.repeat(number_of[row:end].astype(np.uint64), count)
                    draw = mix(mix(doc + np.uint64(1)) + place.astype(np.uint64)) % np.uint64(1 << 20)
                    low, high = (int(MASK * (1 << 20) * k / ROUNDS) for k in (number, number + 1))
                    masked = np.flatnonzero((draw >= np.uint64(low)) & (draw < np.uint64(high)))
                    context = _context(ids, first)[masked]
                    order = np.argsort(draw[masked], kind="stable")
                    for at in range(0, len(masked), BATCH):
                        pick = order[at:at + BATCH]
                        train_step(w, past, ids[masked[pick]], context[pick])
                    seen += len(masked)
            if seen:
                yield _row(TaskContext.get().partitionId(), seen, _packed(w))

        sets = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(learn, _WEIGHTS)
        sets = stored(sets, "weights")
        left = sets.count()
        while left > FAN_IN:
            groups = -(-left // FAN_IN)
            sets = stored(sets.repartition(groups, F.pmod("task", F.lit(groups))).mapInArrow(_averaged, _WEIGHTS), "weights")
            fewer = sets.count()
            if fewer >= left:
                break
            left = fewer
        got = [(r["n"], np.frombuffer(r["weights"], np.float32).astype(np.float64)) for r in sets.orderBy("task").toLocalIterator()]
        if got:
            seen = sum(n for n, _ in got)
            weights = _unpacked((sum(n * flat for n, flat in got) / seen).astype(np.float32), weights)
        held.unpersist()
    return weights


def score(documents: DataFrame, words: Words, weights: dict[str, np.ndarray]) -> DataFrame:
    """Per row: doc_id, n_tokens, log_likelihood, per_token (null without tokens).

    A token is a run of letters and digits, lower-cased A-Z. Null and empty texts have no tokens and
    log_likelihood 0. Repeated rows get equal scores; an empty table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast((words, weights))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = held.value
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                hashes, first = _hashes(data, offsets)
                ids = _ids(known, hashes)
                n = np.diff(first)
                total = per_doc(log_chances(w, ids, _context(ids, first)), first)
                mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(total),
                     pa.array(mean, mask=n == 0)], names=["doc_id", "n_tokens", "log_likelihood", "per_token"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rate, "doc_id long, n_tokens long, log_likelihood double, per_token double")


def score_documents(documents: DataFrame) -> DataFrame:
    """Vocabulary, training and scores over the same whole table."""
    words = vocabulary(documents)
    return score(documents, words, train(documents, words))
