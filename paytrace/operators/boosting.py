"""Leaf-wise gradient boosting on histograms, several models at a time.

Features are binned once at quantiles and packed in blocks of rows. A pass over the blocks adds up, for the leaves that
have no split yet, gradients, hessians and rows per feature and bin; sums meet per (model, leaf, feature), where the best
cut is found, so only one candidate per leaf and feature comes back. The tree then grows best leaf first as far as the
candidates reach; a pass asks for all open leaves and for the children of the others, so a tree takes about as many
passes as it is deep. Models that share the table (feature families, left-out typologies) share every pass. A table of few
rows has nothing to exchange: one task per model makes the passes of several trees by itself.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed
from ..sources.session import drop_folder, new_folder

BINS = 255
BLOCK_ROWS = 4_096
BLOCKS_MERGED = 16
SUMS_ROWS = 32_768  # rows up to which every leaf's sums are added up from its rows
LEAVES = 31
MIN_ROWS = 20  # rows of a leaf at least
MIN_HESSIAN = 1e-3
FLUSH = 25  # trees that are added to stored scores at a time
ALONE_ROWS = 1_000_000  # rows up to which a pass takes less time than the jobs that would add it up (two bytes a row and feature in the task)


@dataclass
class Tree:
    """Arrays by node: a row goes left if its bin is at most ``cut``; leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        for column, blank in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([blank, blank])
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        return a, a + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf each row of ``bins`` ends in."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins))
        while True:
            at = node[live]
            f = feature[at]
            inner = f >= 0
            if not inner.all():
                live, at, f = live[inner], at[inner], f[inner]
            if not len(live):
                return node
            node[live] = np.where(bins[live, f] <= cut[at], left[at], right[at])

    def added(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass(frozen=True)
class Candidate:
    """Sums of a leaf and its best cut."""

    g: float
    h: float
    rows: float
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    left: tuple[float, float, float] = (0.0, 0.0, 0.0)


def best_cuts(histograms: np.ndarray, l2: float, min_rows: int = MIN_ROWS) -> tuple[np.ndarray, ...]:
    """(gain, bin, sums of g, h and rows left of it) of the best cut per feature; gain 0 where there is none.

    ``histograms``: g, h and rows by feature and bin.
    """
    g, h, n = np.cumsum(histograms, axis=2)
    whole_g, whole_h, whole_n = g[:, -1:], h[:, -1:], n[:, -1:]
    fits = (n >= min_rows) & (whole_n - n >= min_rows) & (h >= MIN_HESSIAN) & (whole_h - h >= MIN_HESSIAN)
    gain = np.where(fits, g * g / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g * whole_g / (whole_h + l2), 0.0)
    at = gain.argmax(axis=1)
    each = np.arange(len(at))
    best = np.where(gain[each, at] > 1e-12, gain[each, at], 0.0)
    return best, at, g[each, at], h[each, at], n[each, at]


class _Growing:
    """One tree that grows best leaf first as its leaves' candidates become known."""

    def __init__(self, leaves: int):
        self.limit, self.tree, self.known, self.ahead = leaves, Tree(), {}, {}
        self.open, self.done = [0], False

    def wanted(self) -> list[tuple[int, ...]]:
        """Paths of leaves whose candidates are asked for: those in the tree and the children of the next to split."""
        paths = [self.path[n] for n in self.open if n not in self.known]
        room = self.limit - len(self.open)
        ready = sorted((n for n in self.open if n in self.known and self.known[n].gain > 0), key=lambda n: -self.known[n].gain)
        return paths + [child for n in ready[:room] for child in ((*self.path[n], 0), (*self.path[n], 1)) if child not in self.ahead]

    path: dict[int, tuple[int, ...]]

    def start(self, root: Candidate) -> None:
        self.path, self.known = {0: ()}, {0: root}

    def learn(self, path: tuple[int, ...], found: Candidate) -> None:
        self.ahead[path] = found

    def grow(self) -> None:
        """Splits as long as every open leaf's candidate is known."""
        while not self.done:
            for n in self.open:
                if n not in self.known and self.path[n] in self.ahead:
                    self.known[n] = self.ahead[self.path[n]]
            if len(self.open) >= self.limit:
                self.done = True
                return
            if any(n not in self.known for n in self.open):
                return
            best = max(self.open, key=lambda n: (self.known[n].gain, -n))
            if self.known[best].gain <= 0:
                self.done = True
                return
            a, b = self.tree.split(best, self.known[best].feature, self.known[best].cut)
            self.path[a], self.path[b] = (*self.path[best], 0), (*self.path[best], 1)
            self.open.remove(best)
            self.open += [a, b]

    def finish(self, step: float, l2: float) -> Tree:
        for n in self.open:
            c = self.known.get(n) or self.sums_of(n)
            self.tree.value[n] = -step * c.g / (c.h + l2)
        return self.tree

    def sums_of(self, node: int) -> Candidate:
        """Sums of a leaf nobody asked a histogram for, from its parent's cut."""
        parent = next(p for p in range(len(self.tree.feature)) if self.tree.feature[p] >= 0 and node in (self.tree.left[p], self.tree.right[p]))
        c = self.known[parent]
        if node == self.tree.left[parent]:
            return Candidate(*c.left)
        return Candidate(c.g - c.left[0], c.h - c.left[1], c.rows - c.left[2])


def cut_points(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cut values per column: one pass of approximate quantiles for all columns."""
    grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(c, grid, F.lit(20_000)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for i, points in enumerate(cuts):
        out[:, i] = np.searchsorted(points, values[:, i], "left")
    return out


def _packed(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], models: int) -> Iterator[pa.RecordBatch]:
    """Rows y, model flags, features to blocks of bytes."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(low, BLOCK_ROWS)
            table = [part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(part.num_columns)]
            bins = _binned(np.column_stack(table[1 + models:]), cuts)
            yield pa.RecordBatch.from_pydict({
                "rows": pa.array([len(bins)], pa.int32()), "bins": pa.array([bins.tobytes()], pa.binary()),
                "y": pa.array([table[0].astype(np.uint8).tobytes()], pa.binary()),
                "use": pa.array([np.column_stack(table[1:1 + models]).astype(np.uint8).tobytes()], pa.binary()),
                "scores": pa.array([b""], pa.binary())})


BLOCK = "rows int, bins binary, y binary, use binary, scores binary"


def _unpacked(row: dict, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k = row["rows"], len(base)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(n, -1)
    scores = np.frombuffer(row["scores"], float).reshape(n, k) if row["scores"] else np.tile(base, (n, 1))
    return bins, np.frombuffer(row["y"], np.uint8), np.frombuffer(row["use"], np.uint8).reshape(n, k), scores


def _rescored(batches: Iterator[pa.RecordBatch], base: np.ndarray, recent: list[list[Tree]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            bins, _, _, scores = _unpacked(row, base)
            total = scores + np.column_stack([sum((t.added(bins) for t in trees), np.zeros(len(bins))) for trees in recent])
            out.append(row | {"scores": total.tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


Asked = list[tuple[int, Tree, dict[int, int]]]  # model, tree reaching down to the asked leaves, leaf to its number


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.ndarray]]  # bins, y, use, bins by feature, raw score of a model


def _block(row: dict, base: np.ndarray, recent: list[list[Tree]]) -> Block:
    bins, y, use, scores = _unpacked(row, base)
    return bins, y, use, np.ascontiguousarray(bins.T), lambda k: scores[:, k] + sum((t.added(bins) for t in recent[k]), np.zeros(len(bins)))


def _added_up(rows: Iterable[Block], asked: Asked, bins_each: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of gradients, hessians and rows by feature and bin per (model, leaf number)."""
    total: dict[int, np.ndarray] = {}
    for bins, y, use, features, raw in rows:
        for model, tree, numbers in asked:
            p = 1 / (1 + np.exp(-raw(model)))
            place = np.full(len(tree.feature) + 1, -1)  # the last one is that of rows the model leaves out
            place[list(numbers)] = range(len(numbers))
            leaf = place[np.where(use[:, model] > 0, tree.leaves(bins), -1)]
            rows_in = np.flatnonzero(leaf >= 0)
            at, p, y_in, size = leaf[rows_in] * bins_each, p[rows_in], y[rows_in], len(numbers) * bins_each
            g, h = p - y_in, p * (1 - p)
            sums = total.setdefault(model, np.zeros((3, len(features), size)))
            for f, column in enumerate(features):
                key = at + column[rows_in]
                for i, weight in enumerate((g, h, None)):
                    sums[i, f] += np.bincount(key, weight, size)
    return {(model, number): np.ascontiguousarray(total[model].reshape(3, -1, len(numbers), bins_each)[:, :, i])
            for model, _, numbers in asked if model in total for i, number in enumerate(numbers.values())}


def _histograms(batches: Iterator[pa.RecordBatch], base: np.ndarray, recent: list[list[Tree]], asked: Asked, bins_each: int) -> Iterator[pa.RecordBatch]:
    """One task's sums per (model, leaf) and feature."""
    total = _added_up((_block(row, base, recent) for batch in batches for row in batch.to_pylist()), asked, bins_each)
    rows = [dict(model=m, leaf=leaf, feature=f, sums=sums[:, f].tobytes()) for (m, leaf), sums in total.items() for f in range(sums.shape[1])]
    schema = pa.schema([("model", pa.int32()), ("leaf", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


FOUND = "model int, leaf int, feature int, g double, h double, rows double, gain double, cut int, lg double, lh double, ln double"


def _found(batches: Iterator[pa.RecordBatch], l2: float, min_rows: int, bins_each: int) -> Iterator[pa.RecordBatch]:
    """The best cut per (model, leaf, feature); parts of one key come one after another."""
    out, key, total = [], None, None

    def close() -> None:
        if key is not None:
            gain, at, *left = (x[0] for x in best_cuts(total[:, None], l2, min_rows))
            out.append((*key, *map(float, total.sum(axis=1)), float(gain), int(at), *map(float, left)))

    for batch in batches:
        for m, leaf, f, sums in zip(*(batch.column(i).to_pylist() for i in range(4))):
            part = np.frombuffer(sums, float).reshape(3, bins_each)
            if (m, leaf, f) == key:
                total = total + part
            else:
                close()
                key, total = (m, leaf, f), part
    close()
    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype(
        {"model": "int32", "leaf": "int32", "feature": "int32", "cut": "int32"}), preserve_index=False)


def _better(old: Candidate, feature: int, gain: float, cut: int, left: tuple[float, float, float]) -> Candidate:
    """The candidate with the larger gain; the earlier feature on ties."""
    return Candidate(old.g, old.h, old.rows, gain, feature, cut, left) if gain > old.gain * (1 + 1e-12) else old


def _grown(candidates: Callable[[Asked], dict[tuple[int, int], Candidate]], able: list[int], leaves: int, step: float, l2: float) -> dict[int, Tree]:
    """One tree per model; all models' open leaves are asked for together."""
    grown = {k: _Growing(leaves) for k in able}
    first = candidates([(k, Tree(), {0: 0}) for k in able])
    for k, g in grown.items():
        g.start(first[k, 0])
        g.grow()
    while True:
        asked, paths = [], {}
        for k, g in grown.items():
            if not g.done and (want := g.wanted()):
                tree, numbers = _reaching(g, want)
                asked.append((k, tree, {node: i for i, node in enumerate(numbers)}))
                paths[k] = want
        if not asked:
            return {k: g.finish(step, l2) for k, g in grown.items()}
        for (k, i), c in candidates(asked).items():
            grown[k].learn(paths[k][i], c)
        for k in paths:
            grown[k].grow()


def _merged(rows: list[dict]) -> dict:
    """Several blocks without scores as one, so that fewer and longer arrays are added up."""
    return {"rows": sum(row["rows"] for row in rows)} | {c: b"".join(row[c] for row in rows) for c in ("bins", "y", "use", "scores")}


class _SmallerChild:
    """Sums as of ``_added_up`` for one model: of two children asked for the smaller is added up, the other is what their parent has more."""

    def __init__(self):
        self.known: dict[tuple[int, ...], np.ndarray] = {}

    def __call__(self, rows: Iterable[Block], asked: Asked, bins_each: int) -> dict[tuple[int, int], np.ndarray]:
        (model, tree, numbers), = asked
        if len(tree.feature) == 1:  # a new tree
            self.known.clear()
        paths, rest, todo = {0: ()}, [], dict(numbers)
        for n, feature in enumerate(tree.feature):
            if feature < 0:
                continue
            a, b = tree.left[n], tree.right[n]
            paths |= {a: (*paths[n], 0), b: (*paths[n], 1)}
            whole = self.known.get(paths[n])
            if a in numbers and b in numbers and whole is not None:
                left = whole[2, feature, :tree.cut[n] + 1].sum()
                big, small = (a, b) if 2 * left > whole[2, feature].sum() else (b, a)
                rest.append((big, small, whole))
                del todo[big]
        added = _added_up(rows, [(model, tree, {node: i for i, node in enumerate(todo)})], bins_each)
        sums = {node: added[model, i] for i, node in enumerate(todo)}
        for big, small, whole in rest:
            sums[big] = np.where(whole[2] == sums[small][2], 0.0, whole - sums[small])  # nothing is left in a bin without rows
        self.known |= {paths[node]: found for node, found in sums.items()}
        return {(model, number): sums[node] for node, number in numbers.items()}


def _locally(batches: Iterator[pa.RecordBatch], base: np.ndarray, allowed: list[set[int]], rounds: int, leaves: int, step: float,
             l2: float, min_rows: int, bins_each: int) -> Iterator[pa.RecordBatch]:
    """Rounds of the models a task was dealt, over a table of few rows: no sums have to be exchanged, so it makes the passes itself."""
    dealt: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            dealt.setdefault(row["model"], []).append(row)
    told = []
    for k, rows in sorted(dealt.items()):
        blocks, scores = [], []
        rows.sort(key=lambda row: row["number"])
        if sum(row["rows"] for row in rows) > SUMS_ROWS:
            rows = [_merged(rows[i:i + BLOCKS_MERGED]) for i in range(0, len(rows), BLOCKS_MERGED)]
        for row in rows:
            bins, y, use, features, raw = _block(row, base, [[] for _ in base])
            own = [raw(k), np.zeros(len(bins))]  # as of the last flush, and what was added since
            blocks.append((bins, y, use, features, lambda _, own=own: own[0] + own[1]))
            scores.append((bins, own))

        add = _added_up if sum(len(block[0]) for block in blocks) <= SUMS_ROWS else _SmallerChild()

        def candidates(asked: Asked, blocks: list[Block] = blocks, add=add) -> dict[tuple[int, int], Candidate]:
            out = {}
            for (model, number), sums in add(blocks, asked, bins_each).items():
                g, h, n = (float(x) for x in sums[:, 0].sum(axis=1))
                best = Candidate(g, h, n)
                for f, (gain, cut, *left) in enumerate(zip(*(x.tolist() for x in best_cuts(sums, l2, min_rows)))):
                    if gain > 0 and f in allowed[model]:
                        best = _better(best, f, gain, cut, tuple(left))
                out[model, number] = best
            return out

        for turn in range(rounds):
            tree = _grown(candidates, [k], leaves, step, l2)[k]
            for bins, own in scores:
                own[1] = own[1] + tree.added(bins)
                if (turn + 1) % FLUSH == 0:  # adds up in the order of a table that is written anew
                    own[:] = [own[0] + own[1], np.zeros(len(bins))]
            told.append((k, turn, json.dumps(vars(tree))))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.int32()), pa.array([x[1] for x in told], pa.int32()),
                                      pa.array([x[2] for x in told], pa.string())], names=["model", "turn", "tree"])


@dataclass
class Boosted:
    """Trees over binned features, with their cut points and decision threshold."""

    columns: tuple[str, ...]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    threshold: float = 0.5

    def probability(self, values: np.ndarray) -> np.ndarray:
        bins = _binned(values, self.cuts)
        return 1 / (1 + np.exp(-sum((t.added(bins) for t in self.trees), np.full(len(bins), self.base))))

    def probabilities_replaced(self, own: np.ndarray, given: np.ndarray, replaced: Sequence[int | None]) -> Iterator[np.ndarray]:
        """Probabilities of ``own`` with one column after another taken from ``given`` (none for None)."""
        bins, other = _binned(own, self.cuts), _binned(given, self.cuts)
        plain = [t.added(bins) for t in self.trees]
        asks: dict[int | None, set[int]] = {}
        for i, t in enumerate(self.trees):
            for f in set(t.feature):
                asks.setdefault(f, set()).add(i)
        for at in replaced:
            changed = bins.copy()
            if at is not None:
                changed[:, at] = other[:, at]
            again = asks.get(at, ())
            raw = sum((t.added(changed) if i in again else plain[i] for i, t in enumerate(self.trees)), np.full(len(bins), self.base))
            yield 1 / (1 + np.exp(-raw))

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Adds the probability of the suspicious class; a missing column or value counts as 0."""
        kept = [c for c in df.columns if c != name]
        have = set(df.columns)
        model = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(self.columns)]
        given = df.select(*kept, *model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.column_stack([batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(len(self.columns))])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(self.probability(values))],
                                                 names=[*kept, name])

        return given.mapInArrow(run, StructType([*given.schema.fields[:len(kept)], StructField(name, DoubleType())]))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, json.dumps(vars(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, nodes string").write.mode("overwrite").json(f"{path}/trees")
        meta = json.dumps(dict(columns=self.columns, cuts=[list(c) for c in self.cuts], base=self.base, threshold=self.threshold))
        spark.createDataFrame([(meta,)], "boosted string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "Boosted":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.schema("boosted string").json(f"{path}/metadata").first()[0])
        trees = [Tree(**json.loads(r.nodes)) for r in spark.read.schema("tree int, nodes string").json(f"{path}/trees").orderBy("tree").collect()]
        return Boosted(tuple(meta["columns"]), [np.array(c) for c in meta["cuts"]], meta["base"], trees, meta["threshold"])


def fit_many(df: DataFrame, models: Sequence[tuple[Sequence[str], Column | None]], label: str = "label", iterations: int = 300, step: float = 0.06,
             leaves: int = LEAVES, l2: float = 1.0, min_rows: int = MIN_ROWS) -> list[Boosted]:
    """One boosted model per (columns, row filter or None), all fitted in the same passes over ``df``.

    Null or missing features count as 0. A model without rows of both classes gets no trees and a constant score.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for cs, _ in models for c in cs))
    have = set(df.columns)
    features = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)]
    flags = [(F.lit(1) if rows is None else F.coalesce(rows, F.lit(False)).cast("int")).alias(f"u{k}") for k, (_, rows) in enumerate(models)]
    table = df.select(F.col(label).cast("double").alias("y"), *flags, *features)
    cuts = cut_points(table, [f"f{i}" for i in range(len(columns))])
    folder = new_folder(spark, "boosting")
    count = len(models)
    table.mapInArrow(lambda b: _packed(b, cuts, count), BLOCK).write.parquet(f"{folder}/0")
    counts = table.agg(F.count("*").alias("rows"), *[F.sum(F.col("y") * F.col(f"u{k}")).alias(f"p{k}") for k in range(len(models))],
                       *[F.sum(f"u{k}").alias(f"n{k}") for k in range(len(models))]).first()
    base, able = np.zeros(len(models)), []
    for k in range(len(models)):
        p, n = counts[f"p{k}"] or 0.0, counts[f"n{k}"] or 0
        share = min(max(p / n if n else 0.5, 1e-9), 1 - 1e-9)
        base[k] = math.log(share / (1 - share))
        if 0 < p < n:
            able.append(k)
    allowed = [{columns.index(c) for c in cs} for cs, _ in models]
    bins_each = max([len(c) for c in cuts], default=0) + 1
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/0")
    alone = counts["rows"] <= ALONE_ROWS or blocks.rdd.getNumPartitions() == 1
    done: list[list[Tree]] = [[] for _ in models]
    recent: list[list[Tree]] = [[] for _ in models]

    def candidates(asked: Asked) -> dict[tuple[int, int], Candidate]:
        parts = blocks.mapInArrow(lambda b: _histograms(b, base, recent, asked, bins_each), "model int, leaf int, feature int, sums binary")
        keyed = parts.repartition("model", "leaf", "feature").sortWithinPartitions("model", "leaf", "feature")
        rows = keyed.mapInArrow(lambda b: _found(b, l2, min_rows, bins_each), FOUND).collect()  # leaves x features
        out: dict[tuple[int, int], Candidate] = {}
        for r in sorted(rows, key=lambda r: (r.model, r.leaf, r.feature)):
            old = out.get((r.model, r.leaf)) or Candidate(r.g, r.h, r.rows)
            out[r.model, r.leaf] = _better(old, r.feature, r.gain, r.cut, (r.lg, r.lh, r.ln)) if r.feature in allowed[r.model] else old
        return out

    turn = 0
    while able and turn < iterations:
        rounds = iterations if alone else min(FLUSH, iterations - turn)
        if alone:
            dealt = blocks.withColumn("number", F.xxhash64("bins", "y", "use")).withColumn("model", F.explode(F.array(*[F.lit(k) for k in able])))
            told = dealt.repartitionByRange(len(able), "model").mapInArrow(
                lambda b: _locally(b, base, allowed, iterations, leaves, step, l2, min_rows, bins_each), "model int, turn int, tree string").collect()
            for r in sorted(told, key=lambda r: (r.model, r.turn)):
                recent[r.model].append(Tree(**json.loads(r.tree)))
        else:
            for _ in range(rounds):
                for k, tree in _grown(candidates, able, leaves, step, l2).items():
                    recent[k].append(tree)
        turn += rounds
        for k in able:
            done[k] += recent[k]
        if turn < iterations:
            fresh = f"{folder}/{turn}"
            scored = blocks.mapInArrow(lambda b, r=[list(t) for t in recent]: _rescored(b, base, r), BLOCK)
            scored.write.parquet(fresh)
            blocks, recent = spark.read.schema(BLOCK).parquet(fresh), [[] for _ in models]
            if turn > FLUSH:
                drop_folder(spark, f"{folder}/{turn - FLUSH}")
    drop_folder(spark, folder)
    out = []
    for k, (cs, _) in enumerate(models):
        own = [columns.index(c) for c in cs]
        renumber = {f: i for i, f in enumerate(own)} | {-1: -1}
        for tree in done[k]:
            tree.feature = [renumber[f] for f in tree.feature]
        out.append(Boosted(tuple(cs), [cuts[f] for f in own], float(base[k]), done[k]))
    return out


def _reaching(growing: _Growing, paths: list[tuple[int, ...]]) -> tuple[Tree, list[int]]:
    """A copy of the tree that is split further where children are asked for, and the node of each path."""
    tree = Tree(*(list(getattr(growing.tree, c)) for c in ("feature", "cut", "left", "right", "value")))
    nodes = []
    for path in paths:
        node = 0
        for depth, side in enumerate(path):
            if tree.feature[node] < 0:
                at = next(n for n in growing.open if growing.path[n] == path[:depth])
                tree.split(node, growing.known[at].feature, growing.known[at].cut)
            node = tree.right[node] if side else tree.left[node]
        nodes.append(node)
    return tree, nodes


def fit(df: DataFrame, label: str = "label", columns: Sequence[str] = fixed.ALL_FEATURES, **settings) -> Boosted:
    """One model on all rows."""
    return fit_many(df, [(columns, None)], label, **settings)[0]

