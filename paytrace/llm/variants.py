"""Spelling variant grouping: words that differ by one code point, found by dense prefix and suffix tiles.

Two words differ by a single edit exactly if their common prefix and suffix together reach the longer length minus one, so
one of the two reaches half of that. Words are dealt into groups by the first and by the last half, once for each length the
longer word may have. A group is cut into blocks of a bounded size, and every two blocks of a group are compared
as padded code-point matrices, each word of one against each of the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, discard, lower, span_hash, stored, word_spans

EVERY = 97  # one occurrence in so many, picked by its hash, loses a code point
MIN_LENGTH = 5
MIN_COUNT = 3
TWICE = 2  # a form is so many times as frequent as its variant
TILE_WORDS = 1_024  # words in a block, about
TILE_POINTS = 1 << 16  # code points in a block, about
SMALL = 32  # groups up to this size are compared side by side
CELLS = 1 << 22  # code points compared in one step
WORDS_HELD = 1 << 17  # words a task counts before it hands them on
TEXT_BLOCK = 1 << 21

_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_OTHER = np.ones(256, bool)
_OTHER[[*range(ord("a"), ord("z") + 1), _LEAD]] = False
_SHORT = 40  # bytes up to which hashes are combined from tables


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the runs long enough, their code points and documents."""
    small = lower(data)
    marked = small.copy()
    if len(marked):
        marked[1:][small[:-1] == _LEAD] = ord("a")  # the second byte of such a letter
    starts, ends, first = word_spans(marked, offsets, _OTHER)
    leads = np.zeros(len(small) + 1, np.int64)
    np.cumsum(small == _LEAD, out=leads[1:])
    points = ends - starts - (leads[ends] - leads[starts])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    use = points >= MIN_LENGTH
    return small, starts[use], ends[use], points[use], owner[use]


def _hashes(prefix: np.ndarray, owner: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each document's prefix followed by a word: the prefix's value moved on by the word's bytes, xor the word's."""
    moved = np.empty((_SHORT + 1, len(prefix)), np.uint32)
    moved[0] = prefix
    for i in range(_SHORT):
        moved[i + 1] = (moved[i] >> np.uint32(8)) ^ _CRC[moved[i] & np.uint32(255)]
    return moved[np.minimum(size, _SHORT), owner] ^ crc


def _count(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())],
                                         names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        names = batch.column(0)
        for row, end, data, offsets in blocks(batch.column(1), TEXT_BLOCK):
            small, starts, ends, points, owner = _occurrences(data, offsets)
            _, one, which = np.unique(span_hash(small, starts, ends), return_index=True, return_inverse=True)
            whole = small.tobytes()
            words = [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            prefix = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in names.slice(row, end - row).to_pylist()]
            size = ends - starts
            value = _hashes(np.array(prefix, np.uint32), owner, np.array([zlib.crc32(w) for w in words], np.uint32)[which], size)
            for i in np.flatnonzero(size > _SHORT):
                value[i] = zlib.crc32(words[which[i]], prefix[owner[i]])
            cut = value % np.uint32(every) == 0
            counts = np.bincount(which[~cut], minlength=len(words))
            for word, n in zip(words, counts.tolist()):
                if n:
                    held[word] = held.get(word, 0) + n
            for i in np.flatnonzero(cut & (points > MIN_LENGTH)):
                word, at = words[which[i]].decode(), int(value[i]) % int(points[i])
                left = (word[:at] + word[at + 1:]).encode()
                held[left] = held.get(left, 0) + 1
            if len(held) > WORDS_HELD:
                yield handed()
    if held:
        yield handed()


def counted(documents: DataFrame, every: int = EVERY, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more; tasks count before anything is shuffled."""
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = given.mapInArrow(lambda b: _count(b, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _padded(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, one row each, from the left and to the right edge, and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    column = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    # padding differs from every code point; where it meets padding, lengths decide
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, column] = codes
    right[row, column + np.repeat(width - size, size)] = codes
    return left, right, size


def _run(equal: np.ndarray) -> np.ndarray:
    """Length of the run of true values at the start of each row."""
    return np.where(equal.all(axis=-1), equal.shape[-1], equal.argmin(axis=-1))


def _single_edits(prefix: np.ndarray, suffix: np.ndarray, a: np.ndarray, b: np.ndarray, longer: np.ndarray | int, by_suffix: np.ndarray | bool) -> np.ndarray:
    """Whether the words differ by one edit, judged in the group of the longer length and, once a pair, of the first fitting half."""
    short, long = np.minimum(a, b), np.maximum(a, b)
    prefix, suffix = np.minimum(prefix, short), np.minimum(suffix, short)
    near = (long == longer) & (long - short <= 1) & (prefix < long) & (prefix + suffix >= long - 1)
    return near & ((prefix >= long // 2) ^ by_suffix)


def _tile(a: tuple, b: tuple, longer: int, by_suffix: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words of two blocks; a block against itself gives each pair once."""
    (al, ar, an), (bl, br, bn) = a, b
    step = max(1, CELLS // max(1, len(bn) * al.shape[1]))
    found = []
    for low in range(0, len(an), step):
        rows = slice(low, low + step)
        prefix = _run(al[rows, None] == bl[None])
        suffix = _run((ar[rows, None] == br[None])[:, :, ::-1])
        near = _single_edits(prefix, suffix, an[rows, None], bn[None], longer, by_suffix)
        i, j = np.nonzero(near)
        i += low
        use = i < j if same else np.ones(len(i), bool)
        found.append((i[use], j[use]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _side_by_side(groups: list[tuple[int, bool, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Near pairs inside many small groups at once: all words, places of the pairs."""
    words = [w for _, _, g in groups for w in g]
    left, right, size = _padded(words, max(g[0] for g in groups))
    sizes = np.array([len(g[2]) for g in groups])
    start = np.cumsum(sizes) - sizes
    partners = np.repeat(start + sizes, sizes) - np.arange(len(words)) - 1  # words behind this one in its group
    i = np.repeat(np.arange(len(words)), partners)
    j = np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners) + i + 1
    longer = np.repeat([g[0] for g in groups], sizes)
    kind = np.repeat([g[1] for g in groups], sizes)
    keep, step = [np.zeros(0, np.int64)], max(1, CELLS // left.shape[1])
    for low in range(0, len(i), step):
        p, q = i[low:low + step], j[low:low + step]
        near = _single_edits(_run(left[p] == left[q]), _run((right[p] == right[q])[:, ::-1]), size[p], size[q], longer[p], kind[p])
        keep.append(np.flatnonzero(near) + low)
    use = np.concatenate(keep)
    return words, i[use], j[use]


def _listed(column: pa.Array) -> Iterator[tuple[list[str], list[int]] | None]:
    """Words and counts of each block of a column, null for none."""
    flat = column.flatten()
    words, counts = flat.field("word").to_pylist(), flat.field("n").to_pylist()
    at = 0
    for size in column.value_lengths().to_pylist():
        yield None if size is None else (words[at:at + size], counts[at:at + size])
        at += size or 0


def _near_rows(words: list[str], counts: list[int], i: np.ndarray, others: list[str], other_counts: list[int], j: np.ndarray) -> pa.RecordBatch:
    a, b, n, m = (pa.array(v, t).take(pa.array(at)) for v, t, at in (
        (words, pa.string(), i), (others, pa.string(), j), (counts, pa.int64(), i), (other_counts, pa.int64(), j)))
    both = [pa.concat_arrays(pair) for pair in ((a, b), (b, a), (m, n))]
    return pa.RecordBatch.from_arrays(both, names=["word", "near", "near_n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks (the second null: the first against itself) to (word, near, near_n), both ways."""
    waiting: dict[int, list[tuple[int, bool, list[str], list[int]]]] = {}  # small groups of words about as long
    points: dict[int, int] = {}

    def compared(size: int) -> pa.RecordBatch:
        groups = waiting.pop(size)
        points.pop(size)
        words, i, j = _side_by_side([g[:3] for g in groups])
        counts = [n for g in groups for n in g[3]]
        return _near_rows(words, counts, i, words, counts, j)

    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            for longer, by_suffix, a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _listed(part.column(2)), _listed(part.column(3))):
                if b is None and len(a[0]) <= SMALL:
                    size = longer.bit_length()
                    waiting.setdefault(size, []).append((longer, by_suffix, *a))
                    points[size] = points.get(size, 0) + longer * len(a[0])
                    if points[size] > CELLS // 64:
                        yield compared(size)
                    continue
                first = _padded(a[0], longer)
                i, j = _tile(first, first if b is None else _padded(b[0], longer), longer, by_suffix, b is None)
                yield _near_rows(*a, i, *(b or a), j)
    for size in list(waiting):
        yield compared(size)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of all distinct ``words`` (word, n) that differ by one code point."""
    size = F.char_length("word")
    keys = [F.struct((size + more).alias("longer"), F.lit(by_suffix).alias("by_suffix"),
                     (F.substr("word", size - half + 1, half) if by_suffix else F.substr("word", F.lit(1), half)).alias("half"))
            for more in (0, 1) for by_suffix, half in ((False, _half(size + more)), (True, _half(size + more)))]
    each = words.select("word", "n", size.alias("size"), F.explode(F.array(*keys)).alias("k")).select("word", "n", "size", "k.*")
    key = ["longer", "by_suffix", "half"]
    wide = F.ceil(F.greatest(F.count("*") / TILE_WORDS, F.col("longer") * F.count("*") / TILE_POINTS)).cast("int")
    groups = each.groupBy(*key).agg(wide.alias("parts"), F.count("*").alias("c"), F.max("size").alias("top")).where(
        (F.col("c") > 1) & (F.col("top") == F.col("longer"))).drop("c", "top")
    placed = each.join(groups, key).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    tables = stored(placed.groupBy(*key, "part", "parts").agg(F.collect_list(F.struct("word", "n")).alias("a")), "blocks")
    alone = tables.select("longer", "by_suffix", "a", F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("b"))
    several = tables.where("parts > 1")
    second = several.select(*[F.col(c).alias(f"{c}_b") for c in key], F.col("part").alias("part_b"), F.col("a").alias("b"))
    together = several.join(second, (F.col("longer") == F.col("longer_b")) & (F.col("by_suffix") == F.col("by_suffix_b")) & (
        F.col("half") == F.col("half_b")) & (F.col("part") < F.col("part_b"))).select("longer", "by_suffix", "a", "b")
    return alone.unionByName(together).mapInArrow(_pairs, "word string, near string, near_n long")


def _half(longer: Column) -> Column:
    """Half of the longer length minus one, rounded up, which is half of the longer length rounded down."""
    return F.floor(longer / 2).cast("int")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each form is followed to the last, twice as far a round. Forms must not circle."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("w"), F.col("root").alias("r"))
        ways = stored(ways.join(further, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def group(words: DataFrame, times: int = TWICE) -> DataFrame:
    """Distinct ``words`` (word, n) with form, root, n_near and form_n; ties of n go to the smaller word."""
    words = stored(words, "words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
    joined = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    often = -F.col("b.less") >= F.col("n") * times
    told = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("b.near")).alias("form"),
        F.when(often, -F.col("b.less")).alias("form_n")), "forms")
    last = roots(told.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return told.join(last, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(documents: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; an occurrence whose crc32 of ``<doc_id>:<run>`` 97 divides
    loses one code point first. A null doc_id counts as empty in that text; null and empty texts hold no words; repeated
    rows count as often as they occur; words may be of any length, blocks shrink with it. Among equally frequent near
    words the smallest in code-point order is the form. Other columns are ignored; an empty table gives an empty result.
    """
    return group(counted(documents))
