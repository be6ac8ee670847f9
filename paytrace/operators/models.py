"""Anomaly and classification models on account features."""

from __future__ import annotations

import copy
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.order import exact_percentiles, numbered
from . import boosting, evaluate
from ..sources.session import cut


# ------------------------------------------------------------------------------- robust scaling
def scale_parameters(df: DataFrame, columns) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column; a zero range counts as 1."""
    wanted = {}
    for c in columns:
        for tag, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            wanted[f"{c}__{tag}"] = (c, p)
    q = exact_percentiles(df, wanted)
    return {c: (q[f"{c}__q2"], (q[f"{c}__q3"] - q[f"{c}__q1"]) or 1.0) for c in columns}


def scaled(parameters: dict[str, tuple[float, float]]) -> Column:
    """The scaled features as one array column, in parameter order."""
    return F.array(*[(F.col(c).cast("double") - mid) / width for c, (mid, width) in parameters.items()])


# ----------------------------------------------------------------------------- isolation forest
NODE = "tree int, node int, left int, right int, feature int, cut double, size int"


def _path_length(n):
    """Expected path length of a failed search among n points (Liu, Ting and Zhou 2008)."""
    n = np.asarray(n, dtype=float)
    inner = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, inner, np.where(n == 2, 1.0, 0.0))


def _grower(seed: int, depth_limit: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iat[0])
        rng = np.random.default_rng([seed, tree])
        points = np.array(rows.sort_values("pick")["x"].tolist(), dtype=float)
        nodes, todo = [], [(0, np.arange(len(points)), 0)]
        made = 1
        while todo:
            node, members, depth = todo.pop()
            x = points[members]
            usable = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(members) > 1 else []
            if depth >= depth_limit or len(usable) == 0:
                nodes.append((tree, node, -1, -1, -1, 0.0, len(members)))
                continue
            f = int(rng.choice(usable))
            at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            below = x[:, f] <= at
            nodes.append((tree, node, made, made + 1, f, at, len(members)))
            todo += [(made, members[below], depth + 1), (made + 1, members[~below], depth + 1)]
            made += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "left", "right", "feature", "cut", "size"])

    return grow


def draw_limit(wanted: int, n: int) -> int:
    """Largest 64-bit hash that draws about ``wanted`` of ``n`` rows, whatever ``n`` is."""
    return min((wanted << 64) // max(n, 1) - (1 << 63), (1 << 63) - 1)


class IsolationForest:
    """Isolation forest: trees are grown from samples of at most 256 rows, one task per tree.

    The node table (trees x 511 rows at most) is the only thing sent to every task.
    """

    def __init__(self, columns, trees: int = 150, sample: int = 256, contamination: float = 0.1, seed: int = 42):
        self.columns, self.trees, self.sample, self.contamination, self.seed = tuple(columns), trees, sample, contamination, seed

    def fit(self, df: DataFrame, key: str = "account_id") -> "IsolationForest":
        n = df.count()
        if n == 0:
            raise ValueError("cannot fit on an empty feature table")
        self.parameters = scale_parameters(df, self.columns)
        size = min(self.sample, n)
        rows = df.select(F.col(key).alias("key"), scaled(self.parameters).alias("x"))
        # Each row draws a hash per tree; enough rows fall under the rate to fill every sample.
        limit = draw_limit(2 * size, n)
        drawn = F.filter(
            F.sequence(F.lit(0), F.lit(self.trees - 1)),
            lambda i: F.xxhash64(F.lit(self.seed), F.col("key"), i) <= F.lit(limit))
        picks = rows.select("key", "x", F.explode(drawn).alias("tree")).withColumn(
            "pick", F.xxhash64(F.lit(self.seed + 1), "key", "tree"))
        order = Window.partitionBy("tree").orderBy("pick", "key")
        chosen = picks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
        grown = chosen.select("tree", "pick", "x").groupBy("tree").applyInPandas(
            _grower(self.seed, int(np.ceil(np.log2(max(size, 2))))), NODE)
        self.nodes = grown.toPandas().sort_values(["tree", "node"])
        self.size = size
        # Offset: the share ``contamination`` of the rows falls below 0.
        scores = cut(self._depths(df, key))
        self.offset = exact_percentiles(scores, {"o": ("neg", self.contamination)})["o"]
        return self

    def _depths(self, df: DataFrame, key: str) -> DataFrame:
        starts = np.searchsorted(self.nodes["tree"].unique(), self.nodes["tree"].to_numpy())
        first = np.flatnonzero(np.r_[True, np.diff(starts) > 0])
        base = first[starts]
        left = np.where(self.nodes["left"] < 0, -1, self.nodes["left"] + base)
        right = np.where(self.nodes["right"] < 0, -1, self.nodes["right"] + base)
        table = df.sparkSession.sparkContext.broadcast((
            first, left, right, self.nodes["feature"].to_numpy(), self.nodes["cut"].to_numpy(),
            _path_length(self.nodes["size"].to_numpy()), float(_path_length(self.size))))

        @F.pandas_udf("double")
        def negative_score(x: pd.Series) -> pd.Series:
            roots, lo, hi, feature, at, leaf, norm = table.value
            points = np.array(x.tolist(), dtype=float).reshape(len(x), -1)
            total = np.zeros(len(points))
            for root in roots:
                here = np.full(len(points), root)
                live = np.flatnonzero(lo[here] >= 0)
                while len(live):
                    node = here[live]
                    here[live] = np.where(points[live, feature[node]] <= at[node], lo[node], hi[node])
                    total[live] += 1
                    live = live[lo[here[live]] >= 0]
                total += leaf[here]
            return pd.Series(-np.power(2.0, -total / len(roots) / max(norm, 1e-12)))

        return df.select(key, negative_score(scaled(self.parameters)).alias("neg"))

    def decision(self, df: DataFrame, key: str = "account_id") -> DataFrame:
        """(key, raw_score): lower is more unusual, below 0 is an outlier."""
        return self._depths(df, key).select(key, (F.col("neg") - self.offset).alias("raw_score"))


# ---------------------------------------------------------------------------------- classifiers
def _assembled(df: DataFrame, columns) -> DataFrame:
    """Model columns as doubles; a missing column counts as 0."""
    have = set(df.columns)
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns])


class Classifier:
    """A fitted pipeline with its feature list and decision threshold."""

    def __init__(self, model: PipelineModel, columns, threshold: float = 0.5):
        self.model, self.columns, self.threshold = model, tuple(columns), float(threshold)

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Adds the probability of the suspicious class."""
        out = self.model.transform(_assembled(df, self.columns))
        drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns]
        return out.withColumn("__p", vector_to_array("probability")[1]).drop(*drop).withColumnRenamed("__p", name)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _session().createDataFrame([(json.dumps(self.columns), self.threshold)], "columns string, threshold double").coalesce(
            1).write.mode("overwrite").json(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "Classifier":
        row = _session().read.schema("columns string, threshold double").json(f"{path}/metadata").first()
        return Classifier(PipelineModel.load(f"{path}/model"), json.loads(row["columns"]), row["threshold"])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def load_classifier(path: str) -> "Classifier | boosting.Boosted":
    """A saved classifier of either kind."""
    boosted = "boosted" in _session().read.json(f"{path}/metadata").columns
    return boosting.Boosted.load(path) if boosted else Classifier.load(path)


def fit_boosting(df: DataFrame, label: str = "label", columns=fixed.ALL_FEATURES, iterations: int = 300, step: float = 0.06,
                 leaves: int = boosting.LEAVES, l2: float = 1.0) -> boosting.Boosted:
    """Leaf-wise gradient-boosted trees on histograms."""
    return boosting.fit(df, label, columns, iterations=iterations, step=step, leaves=leaves, l2=l2)


def fit_forest(df: DataFrame, label: str = "label", columns=fixed.ALL_FEATURES, trees: int = 300, depth: int = 12,
               seed: int = 42) -> Classifier:
    """Random forest with balanced classes and at least two rows per leaf."""
    forest = RandomForestClassifier(labelCol="__y", featuresCol="features", weightCol="__w", numTrees=trees,
                                    maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return _fit(forest, df, label, columns, balanced=True)


def _fit(estimator, df: DataFrame, label: str, columns, balanced: bool = False) -> Classifier:
    columns = tuple(columns)
    rows = _assembled(df, columns).withColumn("__y", F.col(label).cast("double"))
    if balanced:
        counts = rows.agg(F.count("*").alias("n"), F.sum("__y").alias("p")).first()
        pos = counts["n"] / (2.0 * max(counts["p"], 1.0))
        neg = counts["n"] / (2.0 * max(counts["n"] - counts["p"], 1.0))
        rows = rows.withColumn("__w", F.when(F.col("__y") == 1, pos).otherwise(neg))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), estimator]).fit(rows)
    return Classifier(model, columns)


def with_best_threshold(classifier, validation: DataFrame, label: str = "label"):
    """The classifier with the threshold of best F1 on ``validation``."""
    scored = cut(classifier.score(validation, "score").withColumn("y", F.col(label)).select("y", "score"))
    out = copy.copy(classifier)
    out.threshold = float(evaluate.best_f1_threshold(scored).first()["threshold"])
    return out


# ------------------------------------------------------------------------------ occlusion drivers
def label_of(name: Column) -> Column:
    """Plain-language name of a feature."""
    known = F.create_map(*[F.lit(x) for pair in fixed.FEATURE_LABELS.items() for x in pair])
    out = known[name]
    for prefix, text in fixed.NEIGHBOUR_LABELS:
        rest = F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), "_", " ")
        out = F.coalesce(out, F.when(name.startswith(prefix), F.concat(F.lit(text), rest)))
    return F.coalesce(out, F.regexp_replace(name, "_", " "))


def drivers(classifier: Classifier, features: DataFrame, wanted: DataFrame, top: int = 3, candidates: int = 14,
            min_drop: float = 0.005) -> DataFrame:
    """Features whose replacement by the population median lowers an account's score most.

    ``wanted`` holds ``account_id``. Each wanted account becomes up to ``candidates`` variants, scored in
    one pass. Without any drop above ``min_drop`` the most unusual features are listed.
    """
    columns = [c for c in classifier.columns if not c.startswith("tier_")]
    table = _assembled(features, classifier.columns)
    medians = exact_percentiles(table, {c: (c, 0.5) for c in columns})
    deviations = table.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    rows = table.join(wanted.select("account_id"), "account_id", "left_semi")
    away = F.array(*[
        F.struct((F.abs(F.col(c) - medians[c]) / ((deviations[c] or 0.0) + 1e-9)).alias("away"), F.lit(c).alias("feature"),
                 F.col(c).alias("value"), F.lit(float(medians[c])).alias("typical"))
        for c in columns])
    ordered = F.slice(F.sort_array(away, asc=False), 1, candidates)
    base = classifier.score(rows, "base")
    variants = base.select("account_id", "base", *classifier.columns, F.posexplode(ordered).alias("rank", "p"))
    occluded = variants.select(
        "account_id", "base", "rank", "p.feature", "p.value", "p.typical",
        *[F.when(F.col("p.feature") == c, F.col("p.typical")).otherwise(F.col(c)).alias(c) if c in medians else F.col(c)
          for c in classifier.columns])
    scored = classifier.score(occluded, "without").withColumn("drop", F.col("base") - F.col("without"))
    strong = F.col("drop") > min_drop
    per = Window.partitionBy("account_id")  # at most ``candidates`` rows
    order = per.orderBy(strong.cast("int").desc(), F.when(strong, F.col("drop")).desc_nulls_last(), "rank")
    ranked = scored.withColumn("any_strong", F.max(strong.cast("int")).over(per)).withColumn("place", F.row_number().over(order))
    kept = ranked.where((F.col("place") <= top) & (strong | (F.col("any_strong") == 0)))
    return kept.select(
        "account_id", "place", "feature", label_of(F.col("feature")).alias("label"), F.round("value", 3).alias("value"),
        F.round("typical", 3).alias("typical"), F.round(F.greatest("drop", F.lit(0.0)), 4).alias("contribution"))


# ------------------------------------------------------------------------------- model experiments
def ladder_models(train: DataFrame, **settings) -> dict[str, boosting.Boosted]:
    """One model per step of feature families, all fitted in the same passes."""
    steps = {name: [c for f in families for c in fixed.FAMILIES[f]] for name, families in fixed.LADDER}
    return dict(zip(steps, boosting.fit_many(train, [(columns, None) for columns in steps.values()], **settings)))


def ablation(train: DataFrame, test: DataFrame, network: str | None = None, **settings) -> DataFrame:
    """Average precision as feature families are added: (step, features, n_features, pr_auc).

    With ``network``, a column of ``test``, the mean over networks and its deviation ``std``.
    """
    by = ["step", "features", "n_features"]
    out = None
    for step, (name, model) in enumerate(ladder_models(train, **settings).items()):
        scored = model.score(test, "score").select(
            F.lit(step).alias("step"), F.lit(name).alias("features"), F.lit(len(model.columns)).alias("n_features"),
            (F.lit(0) if network is None else F.col(network)).alias("network"), F.col("label").alias("y"), "score")
        out = scored if out is None else out.unionByName(scored)
    each = evaluate.average_precision(cut(out), [*by, "network"])  # the curve reads its rows several times
    if network is None:
        return each.drop("network")
    return each.groupBy(*by).agg(F.avg("pr_auc").alias("pr_auc"), F.stddev_pop("pr_auc").alias("std"))


def permutation_importance(model: boosting.Boosted, test: DataFrame, columns=None, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Drop in average precision when one column is shuffled over the accounts: (feature, importance, std).

    Shuffling joins two independent row numberings, so no column passes through one task. Each row meets its donor once
    and is scored with every column replaced in turn, so all columns cost one join and one grouped average precision. Scores
    are written once; of a row's trees only those that ask for the replaced column are walked again.
    """
    wanted = [model.columns.index(c) for c in columns or model.columns]
    names = [model.columns[i] for i in wanted] + [""]
    width = len(model.columns)
    table = cut(_assembled(test, model.columns).select(
        "account_id", F.col("label").cast("int").alias("y"), F.array(*[F.col(c) for c in model.columns]).alias("x")))

    def scored(batches):
        for batch in batches:
            own, given = (np.array(batch.column(i).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width) for i in (2, 3))
            for number, chances in enumerate(model.probabilities_replaced(own, given, [*wanted, None])):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(own), number, np.int32)), pa.array(chances)],
                    names=["repeat", "y", "number", "score"])

    out = None
    for turn in range(repeats):
        rows = numbered(table, "account_id", seed, "slot").select(F.lit(turn).alias("repeat"), "y", "x", "slot")
        donors = numbered(table, "account_id", seed + 1 + turn, "slot").select(F.col("x").alias("given"), "slot")
        pairs = rows.join(donors, "slot").select("repeat", "y", "x", "given")
        out = pairs if out is None else out.unionByName(pairs)
    told = cut(out.mapInArrow(scored, "repeat int, y int, number int, score double"))
    each = cut(evaluate.average_precision(told, ["repeat", "number"]))
    whole = each.where(F.col("number") == len(wanted)).select("repeat", F.col("pr_auc").alias("whole"))
    drop = each.where(F.col("number") < len(wanted)).join(whole, "repeat").withColumn("drop", F.col("whole") - F.col("pr_auc"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("number") + 1)
    return drop.groupBy(name.alias("feature")).agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def family_share(importance: DataFrame) -> DataFrame:
    family = F.create_map(*[F.lit(x) for f, names in fixed.FAMILIES.items() for n in names for x in (n, f)])
    rows = importance.select(family[F.col("feature")].alias("family"), F.greatest("importance", F.lit(0.0)).alias("v"))
    total = rows.agg(F.sum("v")).scalar()
    return rows.groupBy("family").agg(F.sum("v").alias("v")).select(
        "family", F.when(total > 0, F.col("v") / total).otherwise(F.col("v")).alias("share"))


def leave_one_out(train: DataFrame, test: DataFrame, typologies, columns=fixed.ALL_FEATURES, validation: DataFrame | None = None,
                  **settings) -> DataFrame:
    """Recall and average precision on a typology the model never saw; the models share every pass of the fit.

    With ``validation`` each model gets its threshold of best F1 there, on rows without its typology.
    """
    fitted = boosting.fit_many(train, [(columns, ~F.col("typology").eqNullSafe(name)) for name in typologies], **settings)
    out = None
    for name, model in zip(typologies, fitted):
        if validation is not None:
            model = with_best_threshold(model, validation.where(~F.col("typology").eqNullSafe(name)))
        scored = model.score(test.where((F.col("label") == 0) | (F.col("typology") == name)), "score").withColumn("y", F.col("label"))
        rows = scored.select(F.lit(name).alias("typology"), "y", "score", (F.col("score") >= model.threshold).alias("alert"))
        out = rows if out is None else out.unionByName(rows)
    out = cut(out)
    told = evaluate.confusion(out, ["typology"]).select(
        "typology", (F.col("true_positives") + F.col("false_negatives")).alias("accounts"), "recall")
    return told.join(evaluate.average_precision(out, ["typology"]), "typology")
