"""Shared parts of the text operators: tables in the shared folder, global ranks, vectorised word hashing.

The numpy helpers work on one block of texts at a time: the UTF-8 bytes of whole documents side by side,
at most about ``BLOCK`` bytes unless one document alone is longer. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrace.sources.session import drop_folder, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SECTION = 1 << 16
_written: list[list[DataFrame]] = []  # by open ``scratch`` block


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(SECTION + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_RADIX), _powers(_INVERSE)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new table in the folder of ``spark.checkpoint.dir`` and reads it back.

    Lineage ends there, every executor sees it, and the planner knows its size, so whether a side is
    broadcast follows from Spark's own size threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _written:
        _written[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` once nothing that is still to be read depends on them."""
    for table in tables:
        drop_folder(table.sparkSession, table.stored_at)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what ``stored`` writes inside of the block when it ends, but for tables passed to the function it gives."""
    written: list[DataFrame] = []
    _written.append(written)
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.stored_at)
        return table

    try:
        yield keep
    finally:
        _written.pop()
        discard(*[t for t in written if t.stored_at not in kept])


def ranked(df: DataFrame, order: list[str | Column], rank: str, name: str) -> DataFrame:
    """Adds ``rank``, the 0-based position in ``order``, by range partitions and their row counts.

    The rows are written once; what is broadcast has one row per partition.
    """
    at = F.monotonically_increasing_id()  # partition number above bit 33, row number in the partition below
    sorted_rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{rank}__at", at), name)
    part = F.shiftright(f"{rank}__at", 33).alias(f"{rank}__part")
    sizes = sorted_rows.groupBy(part).agg(F.count("*").alias("n"))
    prior = Window.orderBy(f"{rank}__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(f"{rank}__part", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias(f"{rank}__start"))
    inside = F.col(f"{rank}__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_rows.withColumn(f"{rank}__part", F.shiftright(f"{rank}__at", 33))
        .join(F.broadcast(starts), f"{rank}__part")
        .withColumn(rank, inside + F.col(f"{rank}__start"))
        .drop(f"{rank}__part", f"{rank}__start", f"{rank}__at")
    )


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents side by side: (first row, row behind the last, bytes, offsets). Null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, whole[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, so that their order and any of their bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (bytes or 64-bit hashes); equal spans hash alike wherever they stand.

    Spans must begin in rising order. They are hashed in runs that cover at most ``SECTION`` values, a longer span
    section by section, so what is held besides the result does not grow with the length of a text.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        until = max(at + 1, int(np.searchsorted(starts, low + SECTION, "right")))
        fits = np.flatnonzero(ends[at:until] > low + SECTION)
        if len(fits) and fits[0] == 0:
            out[at] = _long_span(values, low, int(ends[at]))
            at += 1
            continue
        until = at + int(fits[0]) if len(fits) else until
        first, last = starts[at:until] - low, ends[at:until] - low
        total = _totals(values[low:low + int(last.max(initial=0))])
        out[at:until] = (total[last] - total[first]) * _DOWN[first]
        at = until
    return mix(out + (ends - starts).astype(np.uint64))


def _totals(values: np.ndarray) -> np.ndarray:
    terms = _BYTE[values] if values.dtype == np.uint8 else values
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms * _UP[:len(terms)], out=total[1:])
    return total


def _long_span(values: np.ndarray, start: int, end: int) -> np.uint64:
    total, scale = 0, 1
    for low in range(start, end, SECTION):
        part = _totals(values[low:min(low + SECTION, end)])
        total = (total + int(part[-1]) * scale) % (1 << 64)
        scale = scale * int(_UP[SECTION]) % (1 << 64)
    return np.uint64(total)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    cut = np.zeros(min(len(data), BLOCK) + 1, bool)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(data), BLOCK):
        high = min(low + BLOCK, len(data))
        cut[:] = False  # a document ends before this byte
        cut[offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high, "right")] - low] = True
        solid = np.zeros(high - low + 2, bool)  # with the byte before and the one behind
        solid[1:-1] = ~space[data[low:high]]
        solid[0] = low > 0 and not space[data[low - 1]]
        solid[-1] = high < len(data) and not space[data[high]]
        n = high - low
        starts.append(np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:n])) + low)
        ends.append(np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:n + 1])) + low + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` words in a row within one document, and the index of their first words."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _RADIX + words[i:i + count]
    doc_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(count) + n <= doc_end[:count])
    return mix(out[at]), at


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per document, by the index of each document's first value."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One Arrow list per document."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 4: the documents with 2 are held out of every training."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
