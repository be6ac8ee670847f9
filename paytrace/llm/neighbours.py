"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts with random links; in each round every node brings its
neighbours and those that link to it together, pairs that are new to each other are compared, and each node keeps its
``LINKS`` best. Every step is a join or an aggregation over node numbers. A query begins at its own node and
expands the best nodes not expanded yet, ``WIDTH`` a hop for all queries together, until the ``POOL`` best
are all expanded; the best of them are then scored exactly.

Links and hops compare 8-bit codes of the vectors; the scores returned come from the original vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrace.llm.common import ranked, stored
from paytrace.sources.session import shared_folder

LINKS = 24
BACK = 24  # links towards a node that take part in a round
OFFERS = 4  # best new partners that one meeting offers a node
ROUNDS = 6
SETTLED = 0.03  # stop when fewer links than this share changed
POOL = 448
WIDTH = 160
HOPS = 24
EXACT = 48  # nodes of a query that are scored exactly at least


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _binary(column: pa.Array) -> np.ndarray:
    """Equally long byte strings as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(len(column), -1)


def _vectors(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes: a float32 scale and one signed byte per component."""
    scale = np.ascontiguousarray(codes[:, :4]).view(np.float32)
    return codes[:, 4:].view(np.int8).astype(np.float32) * scale


def _encode(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.zeros((batch.num_rows, dim))
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            vectors[np.repeat(np.arange(len(size)), size), at] = lists.flatten().to_numpy(zero_copy_only=False)
            vectors /= np.abs(vectors).max(axis=1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            scale = (np.abs(vectors).max(axis=1, keepdims=True) / 127).astype(np.float32)
            codes = np.concatenate([scale.view(np.uint8), np.rint(vectors / scale).astype(np.int8).view(np.uint8)], axis=1)
            off = np.linalg.norm(np.rint(vectors / scale) * scale - vectors, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=["node", "code", "off"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the nodes that meet at a node; offers each the best new partners above its weakest link."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        if not len(flat):
            continue
        size = np.diff(lists.offsets.to_numpy())
        member, fresh, weakest = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        vectors = _vectors(_binary(flat.field(3)))
        begin = np.cumsum(size) - size
        most = int(size.max())
        for g in range(0, len(size), 512):
            n = size[g:g + 512]
            at = begin[g:g + 512, None] + np.arange(most)
            here = np.arange(most) < n[:, None]
            at = np.where(here, at, 0)
            block = vectors[at]
            like = block @ block.transpose(0, 2, 1)
            new = fresh[at]
            fits = here[:, :, None] & here[:, None, :] & (new[:, :, None] | new[:, None, :]) & (
                member[at][:, :, None] != member[at][:, None, :]) & (like > weakest[at][:, :, None])
            like = np.where(fits, like, -9.0)
            if most > OFFERS:
                edge = np.partition(like, most - OFFERS, axis=2)[:, :, most - OFFERS, None]
                fits &= like >= edge
            i, a, b = np.nonzero(fits)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(member[at[i, a]]), "b": pa.array(member[at[i, b]]), "s": pa.array(like[i, a, b].astype(np.float32))})


def _best(links: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return links.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def _backward(links: DataFrame, most: int, order: Column) -> DataFrame:
    """Links turned round, ``most`` for each node they lead to."""
    place = F.row_number().over(Window.partitionBy("b").orderBy(order, "a"))
    return links.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")


def graph(codes: DataFrame, nodes: int) -> DataFrame:
    """Links (a, b, s) between node numbers 0 .. ``nodes`` - 1, up to ``LINKS`` from each."""
    if nodes < 2:
        return codes.sparkSession.createDataFrame([], "a long, b long, s float, fresh boolean")
    run = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(nodes - 1))
    offsets = F.sequence(F.lit(0), F.lit(min(LINKS, nodes - 1) - 1))
    start = codes.select(F.col("node").alias("a"), F.explode(offsets).alias("j"), run.alias("run"))
    start = start.select("a", ((F.col("a") + 1 + (F.col("run") + F.col("j")) % (nodes - 1)) % nodes).alias("b"))
    links = stored(start.select("a", "b", F.lit(-1.0).cast("float").alias("s"), F.lit(True).alias("fresh")), "links")
    for number in range(ROUNDS):
        weakest = links.groupBy("a").agg(F.min("s").alias("weakest"))
        known = codes.join(weakest, F.col("a") == F.col("node")).select("node", "code", "weakest")
        back = _backward(links, BACK, F.xxhash64(F.lit(number), "a", "b"))
        meets = links.select(F.col("a").alias("at"), F.col("b").alias("member"), "fresh").unionByName(
            back.select(F.col("b").alias("at"), F.col("a").alias("member"), "fresh"))
        meets = meets.join(known, F.col("node") == F.col("member")).groupBy("at").agg(
            F.collect_set(F.struct("member", "fresh", "weakest", "code")).alias("members"))  # LINKS + BACK at most
        offers = meets.where(F.exists("members", lambda m: m["fresh"])).select("members").mapInArrow(_meet, "a long, b long, s float")
        # the random links of the start have not been compared; they give way to any offer
        both = links.select("a", "b", "s", F.lit(True).alias("old")).unionByName(offers.withColumn("old", F.lit(False)))
        merged = both.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.max("old").alias("old"))
        kept = _best(merged, LINKS).select("a", "b", "s", (~F.col("old")).alias("fresh"))
        links = stored(kept, "links")
        changed = links.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if changed is None or changed < SETTLED:
            break
    return links


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares queries with the neighbours of the nodes they expand; those above the query's bound go on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        query, low = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        vectors = _vectors(_binary(batch.column(1)))
        lists = batch.column(3)
        flat = lists.flatten()
        size = np.diff(lists.offsets.to_numpy())
        others, codes = flat.field(0).to_numpy(), _binary(flat.field(1))
        begin = np.cumsum(size) - size
        for g in range(0, len(size), 2048):
            n = size[g:g + 2048]
            owner = np.repeat(np.arange(g, g + len(n)), n)
            rows = slice(begin[g], begin[g] + n.sum())
            like = np.einsum("nd,nd->n", _vectors(codes[rows]), vectors[owner])
            good = np.flatnonzero(like > low[owner])
            yield pa.RecordBatch.from_pydict({
                "q": pa.array(query[owner[good]]), "node": pa.array(others[rows][good]), "s": pa.array(like[good].astype(np.float32))})


def search(queries: DataFrame, links: DataFrame, codes: DataFrame, k: int = 5) -> DataFrame:
    """(q, node): the ``EXACT`` best nodes found for each query, its own among them, and all others in the pool that could be
    among the ``k`` best but for the error of the codes. ``queries``: q, the number of its node.

    The links with the codes of the nodes they lead to are written once, in buckets by node, so a hop
    shuffles only what the queries expand.
    """
    spark = queries.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = _backward(links, LINKS, F.desc("s"))
    both = links.select("a", "b").unionByName(back.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = both.join(codes.select(F.col("node").alias("b"), "code"), "b").groupBy("a").agg(
        F.collect_list(F.struct("b", "code")).alias("near"))  # 2 * LINKS at most
    name, near = _bucketed(near, buckets)
    try:
        return _searched(queries, near, codes, k)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _searched(queries: DataFrame, near: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    asked = stored(queries.join(codes, F.col("node") == F.col("q")).select("q", "code"), "asked")
    # per query one row of bounded lists, best first; ``open`` marks what has not been expanded
    entry = F.struct(F.lit(9.0).cast("float").alias("s"), F.col("q").alias("node"), F.lit(True).alias("open"))
    pool = stored(asked.select("q", F.array(entry).alias("pool")), "pool")
    for _ in range(HOPS):
        todo = F.slice(F.filter("pool", lambda e: e["open"]), 1, WIDTH)
        low = F.when(F.size("pool") < POOL, F.lit(-9.0)).otherwise(F.element_at("pool", -1)["s"]).cast("float")
        ahead = pool.select("q", low.alias("low"), F.explode(todo).alias("e")).select("q", "low", F.col("e.node").alias("node"))
        ahead = stored(ahead.join(asked, "q").select("q", "code", "low", "node"), "ahead")
        if ahead.isEmpty():
            break
        found = ahead.join(near, F.col("node") == F.col("a")).select("q", "code", "low", "near").mapInArrow(
            _expand, "q long, node long, s float").distinct()
        new = found.groupBy("q").agg(F.collect_list(F.struct("s", "node")).alias("found"))  # WIDTH * 2 * LINKS at most
        opened = F.transform(todo, lambda e: e["node"])
        state = pool.join(new, "q", "left")
        closed = F.transform("pool", lambda e: F.struct(e["s"].alias("s"), e["node"].alias("node"), (
            e["open"] & ~F.array_contains(opened, e["node"])).alias("open")))
        have = F.transform("pool", lambda e: e["node"])
        fresh = F.transform(F.filter(F.coalesce("found", F.array()), lambda e: ~F.array_contains(have, e["node"])),
                            lambda e: F.struct(e["s"].alias("s"), e["node"].alias("node"), F.lit(True).alias("open")))
        pool = stored(state.select("q", F.slice(F.sort_array(F.concat(closed, fresh), asc=False), 1, POOL).alias("pool")), "pool")
    # a cosine of codes is off by at most the two vectors' errors and their product; so is the k-th best one's
    off = codes.agg(F.max("off")).first()[0] or 0.0
    margin = 2 * (2 * off + off * off)
    reach = F.element_at("pool", F.least(F.size("pool"), F.lit(k + 1)))["s"] - F.lit(margin)  # its own node comes first
    near_best = F.filter("pool", lambda e, i: (i < EXACT) | (e["s"] >= reach))
    return stored(pool.select("q", F.explode(near_best).alias("e")).select("q", F.col("e.node").alias("node")), "found")


def _bucketed(near: DataFrame, buckets: int) -> tuple[str, DataFrame]:
    """The table written in buckets of ``a``; buckets need a name in the catalog."""
    spark = near.sparkSession
    name = f"llm_graph_{uuid.uuid4().hex}"
    near.repartition(buckets, "a").write.bucketBy(buckets, "a").option(
        "path", f"{shared_folder(spark).rstrip('/')}/llm/{name}").format("parquet").saveAsTable(name)
    return name, spark.table(name)


def _cosine(a: str, b: str) -> Column:
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, p: s + p)

    return total(F.col(a), F.col(b)) / (F.sqrt(total(F.col(a), F.col(a))) * F.sqrt(total(F.col(b), F.col(b))))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose vec_id is divisible by ``every``.

    Score is the cosine in double precision; ties go to the smaller vec_id. Rows without vec_id and vectors
    that are null, empty, zero or hold null or non-finite components take no part. Shorter vectors count
    as padded with zeros. Rows that repeat a vec_id with an equal vector count once. With fewer than
    ``k`` other rows all are returned; an empty table gives an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + 0.0))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    rows = stored(rows, "vectors")
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    # a query needs at most k members of a node besides itself
    members = rows.select("h1", "h2", "vec_id").withColumn("r", F.rank().over(first)).where(F.col("r") <= k + 1).distinct()
    members = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    heads = members.where("r = 1").join(rows, ["h1", "h2", "vec_id"]).select("h1", "h2", "v").dropDuplicates(["h1", "h2"])
    numbered = stored(ranked(heads, ["h1", "h2"], "node", "nodes"), "nodes")
    size = numbered.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    codes = stored(numbered.select("node", "v").mapInArrow(_encode(size["dim"] or 0), "node long, code binary, off double"), "codes")
    keyed = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2", "v").dropDuplicates(["vec_id", "h1", "h2"]).join(
        numbered.select("h1", "h2", "node"), ["h1", "h2"])
    asked = stored(keyed.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("node").alias("q")), "queries")
    found = search(asked.select("q").distinct(), graph(codes, size["n"]), codes, k)
    named = members.join(numbered, ["h1", "h2"]).select("node", "vec_id", "v")
    scored = found.join(named, "node").join(asked, "q").where("vec_id <> query_id").select(
        "query_id", "vec_id", _cosine("qv", "v").alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
