"""Shards along a Hilbert curve over document metadata, in DataFrame functions only.

Source and language become 16 levels each by their share of the rows in code point order, the size becomes
a level by its power of two. Rows are sorted by the index of their cell on the 3-dimensional Hilbert curve
and the sorted run is cut into shards of equal row counts, so a shard covers a compact box of all three
dimensions and its files can be skipped by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrace.functions.order import running_totals
from paytrace.llm.common import ranked

BITS = 4
DIMS = 3


def _set_bits(v: int) -> int:
    """Number of set bits at the low end."""
    return (~v & (v + 1)).bit_length() - 1


def tables() -> dict[str, list[int]]:
    """Per digit of the curve index: rank of a Gray code, entry corner and main direction of the sub-cube."""
    size = 1 << DIMS
    gray = [w ^ (w >> 1) for w in range(size)]
    return {
        "rank": [gray.index(c) for c in range(size)],
        "entry": [gray[2 * ((w - 1) // 2)] if w else 0 for w in range(size)],
        "turn": [0 if not w else _set_bits(w if w % 2 else w - 1) % DIMS for w in range(size)],
    }


def curve_index(levels: list[Column]) -> Column:
    """Index on the Hilbert curve of the cell with these levels, each below ``2 ** BITS``."""
    fixed = {k: F.array(*[F.lit(v) for v in vs]) for k, vs in tables().items()}
    mask = (1 << DIMS) - 1

    def rotated(x: Column, by: Column, left: bool) -> Column:
        one = F.when(by == 0, x)
        for k in range(1, DIMS):
            a, b = (k, DIMS - k) if left else (DIMS - k, k)
            one = one.when(by == k, F.shiftleft(x, a).bitwiseOR(F.shiftright(x, b)).bitwiseAND(F.lit(mask)))
        return one

    def step(state: Column, bit: Column) -> Column:
        corner = state["c"][bit].bitwiseXOR(state["entry"])
        digit = F.get(fixed["rank"], rotated(corner, F.pmod(state["turn"] + 1, F.lit(DIMS)), False))
        shift = F.pmod(state["turn"] + 1, F.lit(DIMS))
        return F.struct(
            (state["h"] * (1 << DIMS) + digit).alias("h"),
            state["entry"].bitwiseXOR(rotated(F.get(fixed["entry"], digit), shift, True)).alias("entry"),
            F.pmod(state["turn"] + F.get(fixed["turn"], digit) + 1, F.lit(DIMS)).alias("turn"),
            state["c"].alias("c"),
        )

    def corner_at(b: int) -> Column:
        bits = [F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), d) for d, v in enumerate(levels)]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    corners = F.array(*[corner_at(b) for b in reversed(range(BITS))])
    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("entry"), F.lit(0).alias("turn"), corners.alias("c"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(BITS)]), start, step, lambda s: s["h"])


def _levels(documents: DataFrame, name: str, level: str, total: Column) -> DataFrame:
    """(``name``_value, ``level``): whole values in code point order, null first, cut into levels of like row counts."""
    counts = documents.groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    placed = ranked(counts, [F.col("value").asc_nulls_first()], "at", level)
    steps = running_totals(placed, [], "at", ["n"], descending=False).select("at", "before_n")
    return placed.join(steps, "at").select(
        F.col("value").alias(f"{name}_value"), F.floor(F.col("before_n") * (1 << BITS) / total).cast("int").alias(level))


def curve(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the curve index of every row."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    )
    total = documents.agg(F.count("*").alias("n")).scalar()
    size_level = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size")).cast("int") - 3)
    sources, langs = _levels(documents, "source", "source_level", total), _levels(documents, "lang", "lang_level", total)
    return (
        rows.join(sources, F.col("source").eqNullSafe(F.col("source_value"))).join(langs, F.col("lang").eqNullSafe(F.col("lang_value")))
        .select("doc_id", "size", "text_crc32",
                curve_index([F.col("source_level"), F.col("lang_level"), size_level]).cast("long").alias("curve"))
    )


def place(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Every row with its shard and slot; counts differ by one at most.

    Null text has size 8 and the crc32 of nothing; null source or language sorts first. Rows of one cell
    go by doc_id, crc32 and size, so hot sources and groups of equal texts are cut wherever the count asks
    for it. Repeated rows each take a slot. An empty table gives an empty result. Only columns named here
    are read, so further columns do no harm.
    """
    order = ["curve", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    placed = ranked(curve(documents), order, "pos", "shards")
    total = documents.agg(F.count("*").alias("n")).scalar()
    exact = F.expr(f"pos * {shards} div __total")
    return (
        placed.withColumn("__total", total).withColumn("shard", exact.cast("int"))
        .withColumn("slot", F.col("pos") - F.expr(f"(shard * __total + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
