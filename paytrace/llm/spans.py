"""Substring dedup: words inside 13-word passages that an earlier document holds are removed.

Suffix automata of reference shards give, for each document streamed through them, the matching statistics: how many
words up to each place occur in a row in a document of a smaller doc_id. Runs of at least ``WINDOW`` words go.

One automaton for the whole corpus fits in no task, and sending every shard to every document would cost documents x
shards. So each passage meets only the shard that can hold its windows. The smallest word-gram hash inside a window, its
anchor, depends on the window's words alone; all windows in a row with the same anchor form one passage, which goes to the
anchor's shard. Equal windows have equal anchors and meet there. Anchors of a single document are left out first.
Inside a shard distinct passages come in order of their first document: each is matched against the automaton of the smaller
doc_ids, then added to it. An anchor with very many different passages (the edge of a passage that many texts quote) is cut to
single windows, each of which is its own anchor, so equal ones fall together before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import BLOCK, blocks, discard, lists, mix, span_hash, stored, word_spans

WINDOW = 13
GRAM = 5  # words of an anchor
SHARD_WORDS = 1 << 16  # words of distinct passages in one automaton, about
HOT_WORDS = 1 << 14  # an anchor with more words of distinct passages is cut to windows

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_NOTHING = hashlib.sha256(b"").hexdigest()


def _anchored(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, anchor hash) of each run of windows that share the place of their smallest gram hash."""
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        hashes = hashes * _RADIX + words[i:i + len(hashes)]
    hashes = mix(hashes)
    least, place = hashes[:count].copy(), np.arange(count)
    for i in range(1, window - gram + 1):
        other = hashes[i:i + count]
        at = np.flatnonzero(other < least)
        least[at], place[at] = other[at], at + i
    start = np.flatnonzero(np.arange(count) + window <= np.repeat(first[1:], np.diff(first))[:count])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    return start[begin], start[last] + window, hashes[place[begin]]


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """sha256 of these words with one space between them; bytes are moved section by section, no word becomes an object."""
    whole = hashlib.sha256()
    for low in range(0, len(starts), BLOCK // 8):
        begin, length = starts[low:low + BLOCK // 8], ends[low:low + BLOCK // 8] - starts[low:low + BLOCK // 8] + 1
        behind = np.cumsum(length)
        take = np.arange(behind[-1]) + np.repeat(begin - (behind - length), length)
        take[behind - 1] = 0
        out = data[take]
        out[behind - 1] = 0x20
        whole.update(out.data if low + BLOCK // 8 < len(starts) else out[:-1].data)
    return whole.hexdigest()


def _profiles(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            words = span_hash(data, starts, ends)
            begin, _, anchor = _anchored(words, first, window, gram)
            prints = [_digest(data, starts[a:b], ends[a:b]) for a, b in zip(first[:-1], first[1:])]
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(prints, pa.string()),
                 lists(anchor.astype(np.int64), np.searchsorted(begin, first))], names=["doc_id", "key", "n_words", "sha", "anchors"])


def _passages(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Passages of the wanted anchors: doc_id, key, first word, words, anchor, the words with one space between them."""
    for batch in batches:
        wanted = batch.column(3)
        for row, end, data, offsets in blocks(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            begin, until, anchor = _anchored(span_hash(data, starts, ends), first, window, gram)
            owner = np.searchsorted(first, begin, "right") - 1
            asked = wanted.slice(row, end - row)
            values = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.asarray(asked.value_lengths().fill_null(0))
            told = np.repeat(np.arange(end - row), sizes)
            # one number for document and anchor; a chance hit only adds a passage that matches nothing
            use = np.flatnonzero(np.isin(mix(anchor + owner.astype(np.uint64) * _RADIX), mix(values + told.astype(np.uint64) * _RADIX)))
            begin, until, anchor, owner = begin[use], until[use], anchor[use], owner[use]
            low, high = starts[begin], ends[until - 1]
            text = data.tobytes()
            cut = [b" ".join(text[a:b].split()) for a, b in zip(low.tolist(), high.tolist())]  # bytes split at the same places
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), pa.array((begin - first[owner]).astype(np.int64)),
                 pa.array((until - begin).astype(np.int32)), pa.array(anchor.astype(np.int64)),
                 pa.array(cut, pa.binary()).cast(pa.string())], names=["doc_id", "key", "at", "n", "anchor", "passage"])


class Automaton:
    """Suffix automaton over words of the texts added so far."""

    def __init__(self) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.link = [0]
        self.length = [0]

    def matches(self, words: list[str]) -> list[int]:
        """Matching statistics: for each word the length of the longest run up to it that an added text holds."""
        steps, link, length = self.steps, self.link, self.length
        state, held, out = 0, 0, []
        for word in words:
            after = steps[state].get(word)
            while after is None and state:
                state = link[state]
                held = length[state]
                after = steps[state].get(word)
            if after is not None:
                state, held = after, held + 1
            out.append(held)
        return out

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: str) -> int:
        steps, link, length = self.steps, self.link, self.length
        after = steps[last].get(word)
        if after is not None:  # another text went this way
            return after if length[after] == length[last] + 1 else self._split(last, after, word)
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while True:
            after = steps[state].get(word)
            if after is not None:
                link[new] = after if length[after] == length[state] + 1 else self._split(state, after, word)
                return new
            steps[state][word] = new
            if not state:
                return new
            state = link[state]

    def _split(self, state: int, old: int, word: str) -> int:
        """The part of ``old`` that ends texts as short as ``state`` allows, as a state of its own."""
        steps, link, length = self.steps, self.link, self.length
        new = len(steps)
        steps.append(dict(steps[old]))
        length.append(length[state] + 1)
        link.append(link[old])
        link[old] = new
        while steps[state].get(word) == old:
            steps[state][word] = new
            if not state:
                break
            state = link[state]
        return new


def covered(lengths: list[int], window: int) -> list[int]:
    """Maximal spans of words inside a match of at least ``window`` words: start, end, start, end, ..."""
    out: list[int] = []
    for i, n in enumerate(lengths):
        if n >= window:
            if out and out[-1] >= i + 1 - window:
                out[-1] = i + 1
            else:
                out += [i + 1 - window, i + 1]
    return out


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Distinct passages by (shard, first document): the spans of each that earlier documents hold."""
    shard, shelf, waiting, doc = None, Automaton(), [], None
    for batch in batches:
        spans = []
        for s, d, passage in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
            if s != shard:
                shard, shelf, waiting = s, Automaton(), []
            if d != doc:  # passages of one doc_id are added together: it is not smaller than itself
                doc = d
                for words in waiting:
                    shelf.add(words)
                waiting = []
            words = passage.split(" ")
            spans.append(covered(shelf.matches(words), window))
            waiting.append(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in (1, 2, 3, 5)] + [pa.array(spans, pa.list_(pa.int32()))],
            names=["first_doc", "anchor", "print", "last_doc", "spans"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, n_removed and the hash of the words outside the spans (``cuts``: start, end of word numbers)."""
    for batch in batches:
        cuts = batch.column(3)
        for row, end, data, offsets in blocks(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            removed, prints = [], []
            for i in range(end - row):
                a, b = int(first[i]), int(first[i + 1])
                edges = np.zeros(b - a + 1, np.int64)
                for cut in cuts[row + i].as_py() or []:
                    edges[cut["from"]] += 1
                    edges[cut["to"]] -= 1
                stay = np.flatnonzero(np.cumsum(edges)[:-1] == 0) + a
                removed.append(b - a - len(stay))
                prints.append(_digest(data, starts[stay], ends[stay]))
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(prints, pa.string())],
                                             names=["doc_id", "key", "n_removed", "kept_sha256"])


def _cut_hot(passages: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Passages of the anchors in ``hot`` as single windows, each its own anchor; the others as they are."""
    named = hot.withColumnRenamed("anchor", "h")
    calm = passages.join(named, F.col("anchor") == F.col("h"), "left_anti")
    many = passages.join(named, F.col("anchor") == F.col("h"), "left_semi").withColumn("w", F.split("passage", " "))
    each = many.select("doc_id", "key", "at", "w", F.explode(F.sequence(F.lit(0), F.col("n") - window)).alias("i")).select(
        "doc_id", "key", (F.col("at") + F.col("i")).alias("at"), F.lit(window).alias("n"),
        F.array_join(F.slice("w", F.col("i") + 1, window), " ").alias("passage"))
    return calm.select("doc_id", "key", "at", "n", "anchor", "passage").unionByName(
        each.withColumn("anchor", F.xxhash64("passage")))


def _distinct(passages: DataFrame) -> DataFrame:
    return passages.groupBy("anchor", "passage").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                                                     F.max("n").alias("n"))


def repeated_spans(documents: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, key, n_words, sha per row) and spans (doc_id, key, from, to) of words to remove.

    ``key`` is a hash of the text. Spans are given for the smallest doc_id of each sequence of words only: any other
    document with the same words loses all of them if they are a window or more.
    """
    gram = min(GRAM, window)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    profiles = stored(given.mapInArrow(lambda b: _profiles(b, window, gram),
                                       "doc_id long, key long, n_words long, sha string, anchors array<long>"), "profiles")
    usable = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    lead = usable.groupBy("sha").agg(F.min(F.struct("doc_id", "key")).alias("l")).select("l.*")
    leaders = usable.join(lead, ["doc_id", "key"], "left_semi").select("doc_id", "key", F.explode("anchors").alias("anchor")).distinct()
    often = leaders.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select(F.col("anchor").alias("a"))
    wanted = stored(leaders.join(often, F.col("anchor") == F.col("a"), "left_semi").groupBy("doc_id", "key").agg(
        F.collect_list("anchor").alias("wanted")), "wanted")  # a document's own anchors
    texts = given.join(wanted.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "wanted"), (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")))
    passages = stored(texts.select("doc_id", "key", "text", "wanted").mapInArrow(
        lambda b: _passages(b, window, gram), "doc_id long, key long, at long, n int, anchor long, passage string"), "passages")
    hot = stored(_distinct(passages).groupBy("anchor").agg(F.sum("n").alias("words")).where(F.col("words") > hot_words).select("anchor"), "hot")
    discard(wanted)
    whole = passages
    passages = stored(_cut_hot(whole, hot, window).withColumn("print", F.xxhash64("passage", F.lit(13))), "cut")
    discard(whole, hot)
    distinct = stored(_distinct(passages), "distinct")
    words = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    placed = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select(
        "shard", "first_doc", "anchor", F.xxhash64("passage", F.lit(13)).alias("print"), "passage", "last_doc")
    ordered = placed.repartition("shard").sortWithinPartitions("shard", "first_doc")
    found = ordered.mapInArrow(lambda b: _matched(b, window), "first_doc long, anchor long, print long, last_doc long, spans array<int>")
    found = found.where("last_doc > first_doc OR size(spans) > 0").drop("last_doc")
    known = stored(found.withColumnsRenamed({"anchor": "a", "print": "p"}), "matched")
    discard(distinct)
    at = passages.select("doc_id", "key", "at", "n", "anchor", "print").join(
        known, (F.col("anchor") == F.col("a")) & (F.col("print") == F.col("p")))
    all_of_it = F.array(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n")).alias("to")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.struct(
        (F.col("at") + F.element_at("spans", i)).alias("from"), (F.col("at") + F.element_at("spans", i + 1)).alias("to")))
    cuts = F.when(F.col("doc_id") > F.col("first_doc"), all_of_it).when(F.size("spans") > 0, pairs)
    spans = stored(at.select("doc_id", "key", F.explode(cuts).alias("c")).select("doc_id", "key", "c.from", "c.to"), "spans")
    discard(known, passages)
    return profiles.drop("anchors"), spans


def dedup(documents: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if it lies in ``window`` consecutive words that also start in a document with a smaller doc_id; windows
    are judged on the whole input. Rows of one doc_id are never smaller than each other, so repeated rows keep what
    one of them would keep. A null doc_id is smaller than none and larger than none: such rows stay whole. Null and empty
    texts have no words; a text shorter than a window stays whole. Long texts are hashed section by section. Ties cannot
    arise. Further columns are ignored; an empty table gives an empty result.
    """
    profiles, spans = repeated_spans(documents, window, shard_words, hot_words)
    per_doc = spans.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("from", "to")).alias("cuts"))
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    changed = given.join(per_doc, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "cuts")
    left = stored(changed.mapInArrow(_without, "doc_id long, key long, n_removed long, kept_sha256 string").distinct(), "left")
    discard(spans)
    lead = stored(profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy(F.col("sha").alias("s")).agg(
        F.min("doc_id").alias("smallest"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    rows = profiles.join(lead, F.col("sha") == F.col("s"), "left").join(
        left.withColumnsRenamed({"doc_id": "d", "key": "k"}), (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    again = F.coalesce(F.col("doc_id") > F.col("smallest"), F.lit(False))  # null without a window, a doc_id or a copy
    return rows.select(
        "doc_id", "n_words", F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(again, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
