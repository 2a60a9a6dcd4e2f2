"""Importance, attribution, neighbours and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.operators.metrics import confusion_rates
from yieldloom.operators.folds import seeded_md5, seeded_number
from yieldloom.plans import measured, row_index
from yieldloom.session import pin

BLOCK = 20_000
TILE = 256
#: Pivots whose vectors go to all tasks, at most.
PIVOTS = 1024


def feature_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Tree importances, shares of absolute coefficients, or zeros when a model has neither."""
    if hasattr(model, "featureImportances"):
        values, method = model.featureImportances.toArray(), "tree_impurity"
    elif hasattr(model, "coefficients"):
        raw = np.abs(model.coefficients.toArray())
        values, method = (raw / raw.sum() if raw.sum() > 0 else raw), "absolute_standardized_coefficient"
    else:
        values, method = np.zeros(len(names)), "not_available_for_estimator"
    rows = [(n, float(v), method) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double, importance_method string").orderBy(F.desc("importance"), "feature")


def f_score_importance(features: DataFrame, *, label: str = "bad", feature: str = "feature", value: str = "value") -> DataFrame:
    """Share of each feature's one-way F score between two classes, from mergeable sums of long rows."""
    cells = features.filter(F.col(value).isNotNull()).groupBy(feature, label).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    centre = cells.groupBy(feature).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"))
    gap = F.col("_m") - F.col("_g")
    total = cells.join(centre, feature).groupBy(feature).agg(
        F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("_n") * F.col("_v")).alias("_within"), F.sum(F.col("_n") * gap * gap).alias("_between")
    )
    between = F.col("_between") / F.nullif(F.col("_k") - 1, F.lit(0))
    within = F.col("_within") / F.nullif(F.col("_t") - F.col("_k"), F.lit(0))
    score = F.coalesce(F.when(within > 1e-12, between / F.when(within > 1e-12, within)), F.lit(0.0))
    scored = total.select(feature, score.alias("f_score"))
    overall = scored.agg(F.sum("f_score").alias("_sum"))
    return scored.crossJoin(F.broadcast(overall)).select(  # one row
        feature, "f_score", F.when(F.col("_sum") > 0, F.col("f_score") / F.col("_sum")).otherwise(0.0).alias("importance")
    )


def hurdle_forest_relevance(hurdle: DataFrame, forest: DataFrame, weight: float = 0.7) -> DataFrame:
    """Weighted sum of filter-score shares and forest importances per feature."""
    part = lambda df, w: df.select("feature", (w * F.col("importance")).alias("importance"))
    both = part(hurdle, weight).unionByName(part(forest, 1 - weight))
    return both.groupBy("feature").agg(F.sum("importance").alias("importance"))


def original_coefficients(coefficients: np.ndarray, *, components: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a linear model in input units: PCA loadings (inputs by k), then the scaler, folded in."""
    weights = np.asarray(coefficients, dtype=float)
    if components is not None:
        weights = np.asarray(components) @ weights
    if scale is not None:
        weights = np.where(np.asarray(scale) > 0, weights / np.where(np.asarray(scale) > 0, scale, 1.0), 0.0)
    return weights


def linear_attribution(df: DataFrame, keys: Sequence[str], features: Sequence[str], coefficients: Sequence[float], intercept: float) -> DataFrame:
    """Long (keys, feature, contribution, base): coefficient times distance from the mean.

    The contributions of a row and the base, the mean prediction, add up to its prediction.
    """
    means = df.agg(*[F.avg(f"`{f}`").alias(f"_m{i}") for i, f in enumerate(features)])
    joined = df.crossJoin(F.broadcast(means))  # one row
    base = sum((F.lit(float(c)) * F.col(f"_m{i}") for i, c in enumerate(coefficients)), F.lit(float(intercept)))
    parts = F.array(
        *[F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * (F.col(f"`{f}`") - F.col(f"_m{i}"))).alias("contribution")) for i, (f, c) in enumerate(zip(features, coefficients))]
    )
    return joined.select(*keys, F.explode(parts).alias("_p"), base.alias("base")).select(*keys, "_p.feature", "_p.contribution", "base")


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], float], *, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Drop of a score when one column is taken from the next row of a seeded hash order."""
    reference = score(df)
    shuffled = row_index(df.withColumn("_h", seeded_md5(seed, *order)), [], ["_h", *order], name="_pos")
    size = df.count()
    rows = []
    for f in features:
        donor = shuffled.select((F.col("_pos") % size + 1).alias("_pos"), F.col(f"`{f}`").alias("_moved"))
        moved = shuffled.join(donor, "_pos").withColumn(f, F.col("_moved")).drop("_moved", "_pos", "_h")
        rows.append((f, float(reference - score(moved))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def repeated_permutation_importance(df: DataFrame, features: Sequence[str], predict: Callable[[Mapping[str, Column]], Column], actual: str, *, order: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): the drop of r2 when a column is shuffled, over several shuffles.

    Rows stand in a seeded hash order; in each repeat every feature is taken from the row a seeded number of places
    further on. All features and repeats are one plan: a row meets its donor once a repeat, and squared errors are summed by
    feature and repeat. ``predict`` maps column expressions to the prediction. With one row nothing can move and all drops are 0;
    the std (of the population) is 0 for one repeat.
    """
    known = df.filter(F.col(actual).isNotNull())
    placed = pin(row_index(known.withColumn("_h", seeded_md5(seed, *order)), [], ["_h", *order], name="_pos").drop("_h"))
    n = placed.count()
    numbers = df.sparkSession.range(1, repeats + 1).select(F.col("id").alias("_repeat"), (seeded_number(seed, "id") % max(n - 1, 1) + 1).alias("_shift"))
    y, whole = F.col(actual).cast("double"), predict({f: F.col(f"`{f}`") for f in features})
    # One row a repeat: the shifts.
    rows = placed.withColumns({"_y": y, "_error": (y - whole) ** 2}).crossJoin(F.broadcast(numbers)).withColumn("_from", (F.col("_pos") + F.col("_shift") - 1) % n + 1)
    donors = placed.select(F.col("_pos").alias("_from"), *[F.col(f"`{f}`").alias(f"_moved{i}") for i, f in enumerate(features)])
    met = rows.join(donors, "_from")

    def moved(i: int) -> Column:
        return predict({f: F.col(f"_moved{i}") if k == i else F.col(f"`{f}`") for k, f in enumerate(features)})

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), ((y - moved(i)) ** 2).alias("e")) for i, f in enumerate(features)])
    errors = met.select("_repeat", "_y", "_error", F.explode(cells).alias("_c")).groupBy("_c.feature", "_repeat").agg(
        ((F.sum("_c.e") - F.sum("_error")) / F.nullif(F.var_pop("_y") * F.count("_y"), F.lit(0.0))).alias("drop")
    )
    return errors.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


class Rings:
    """Pivots and, around each, rings of training rows: cell, least and greatest distance and size of each ring."""

    def __init__(self, pivots: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray):
        self.pivots, self.cells, self.low, self.high, self.sizes = pivots, cells, low, high, sizes
        self.tile = max(1, min(TILE, (1 << 22) // max(1, len(cells))))  # points looked at together

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1, keepdims=True) - 2 * points @ self.pivots.T + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))

    def nearer(self, points: np.ndarray) -> np.ndarray:
        """Points by rings: no row of the ring is nearer than this (triangle inequality, less what rounding may add)."""
        d = self.distances(points)[:, self.cells]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) - 1e-6 * (1 + d)


def _rings(train: DataFrame, key: str, vector: str, target: str, block: int) -> tuple[DataFrame, Rings | None]:
    """Training rows by ring (at most ``block`` rows, numbered ``_tb``) and the rings; None without rows."""
    rows = train.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_x"), F.col(target).cast("double").alias("_y"))
    some = rows.orderBy(F.xxhash64("_key"), "_key").limit(min(PIVOTS, max(1, -(-rows.count() // block)))).select("_x").collect()
    if not some:
        return rows, None
    pivots = Rings(np.array([r["_x"] for r in some]), *[np.zeros(0)] * 4)

    def nearest_pivot(batches):
        for rows in batches:
            for at in range(0, len(rows), TILE):
                tile = rows.iloc[at : at + TILE]
                d = pivots.distances(np.stack(tile["_x"].to_numpy()))
                cell = d.argmin(axis=1)
                yield tile.assign(_cell=cell, _d=d[np.arange(len(d)), cell])

    kind = rows.schema["_key"].dataType.simpleString()
    celled = pin(rows.mapInPandas(nearest_pivot, f"_key {kind}, _x array<double>, _y double, _cell long, _d double"))
    ringed = pin(row_index(celled, ["_cell"], ["_d", "_key"], name="_at").withColumn("_ring", F.expr(f"(_at - 1) div {block}")))
    found = ringed.groupBy("_cell", "_ring").agg(F.min("_d").alias("low"), F.max("_d").alias("high"), F.count(F.lit(1)).alias("size")).orderBy("_cell", "_ring").toPandas()  # one row a block
    rings = Rings(pivots.pivots, found["_cell"].to_numpy(), found["low"].to_numpy(), found["high"].to_numpy(), found["size"].to_numpy())
    numbers = train.sparkSession.createDataFrame(found[["_cell", "_ring"]].assign(_tb=range(len(found))), "_cell long, _ring long, _tb long")
    return ringed.join(F.broadcast(numbers), ["_cell", "_ring"]).select("_tb", "_x", "_y"), rings


def _visits(validation: DataFrame, rings: Rings, key: str, vector: str, k: int, block: int) -> DataFrame:
    """Validation rows at home: ``_home`` is the ring that may have the nearest rows and has k of them, ``_vb`` a block of its rows."""

    def home(batches):
        enough = rings.sizes >= k
        for rows in batches:
            for at in range(0, len(rows), rings.tile):
                tile = rows.iloc[at : at + rings.tile]
                least = rings.nearer(np.stack(tile["_x"].to_numpy()))
                yield tile.assign(_home=np.where(enough, least, np.inf).argmin(axis=1))

    kind = validation.schema[key].dataType.simpleString()
    rows = validation.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_x"))
    at_home = pin(rows.mapInPandas(home, f"_id {kind}, _x array<double>, _home long"))
    return pin(row_index(at_home, ["_home"], ["_id"], name="_at").select("_id", "_x", "_home", F.expr(f"(_at - 1) div {block}").alias("_vb")))


def _further(near: DataFrame, homes: DataFrame, rings: Rings, k: int) -> DataFrame:
    """Validation rows once for each other ring that may have a row as near as the k-th one at home."""
    limits = near.groupBy("_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("_dist")).alias("_limit"))

    def others(batches):
        for rows in batches:
            for at in range(0, len(rows), rings.tile):
                tile = rows.iloc[at : at + rings.tile]
                limit = tile["_limit"].fillna(np.inf).to_numpy(float)
                may = rings.nearer(np.stack(tile["_x"].to_numpy())) <= limit[:, None]
                may[np.arange(len(tile)), tile["_home"].to_numpy()] = False
                row, ring = np.nonzero(may)
                yield tile.iloc[row][["_id", "_x", "_home", "_vb"]].assign(_tb=ring)

    kind = homes.schema["_id"].dataType.simpleString()
    return homes.join(limits, "_id", "left").mapInPandas(others, f"_id {kind}, _x array<double>, _home long, _vb long, _tb long")


def nearest_rows(train: DataFrame, validation: DataFrame, *, key: str, vector: str, target: str, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _dist, _y) that hold each validation row's k nearest training rows, and the pairs of blocks visited."""

    def nearest(v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out, chosen = {"_id": [], "_dist": [], "_y": []}, []
        if len(v) and len(t):
            base, y = np.stack(t["_x"].to_numpy()).astype(float), t["_y"].to_numpy()
            points = np.stack(v["_x"].to_numpy()).astype(float)
            length = (base**2).sum(axis=1)
            near, slack = min(k, len(base)), 1e-9 * (1 + length.max() + (points**2).sum(axis=1).max())
            for at in range(0, len(points), TILE):  # one matrix product per tile narrows the choice
                squares = length - 2 * points[at : at + TILE] @ base.T + (points[at : at + TILE] ** 2).sum(axis=1, keepdims=True)
                limits = np.partition(squares, near - 1, axis=1)[:, near - 1] + slack
                chosen += [np.flatnonzero(s <= t) for s, t in zip(squares, limits)]
            for row, x, some in zip(v["_id"], points, chosen):
                d = np.sqrt(((base[some] - x) ** 2).sum(axis=1))
                order = np.lexsort((y[some], d))[:k]
                best, d = some[order], d[order]
                out["_id"].extend([row] * len(best))
                out["_dist"].extend(d)
                out["_y"].extend(y[best])
        return pd.DataFrame(out)

    spark, kind = train.sparkSession, validation.schema[key].dataType.simpleString()
    schema = f"_id {kind}, _dist double, _y double"
    placed, rings = _rings(train, key, vector, target, block)
    if rings is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "_home long, _vb long, _tb long")
    homes = _visits(validation, rings, key, vector, k, block)

    def meet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = rows.select("_home", "_vb", "_tb").distinct()
        copies = placed.join(pairs.toDF("_h", "_v", "_t"), F.col("_tb") == F.col("_t")).select("_h", "_v", "_t", F.col("_x").alias("_x"), "_y")
        met = rows.groupBy("_home", "_vb", "_tb").cogroup(copies.groupBy("_h", "_v", "_t")).applyInPandas(nearest, schema)
        return met, pairs

    first, pairs = meet(homes.withColumn("_tb", F.col("_home")))
    first = pin(first)
    second, more = meet(pin(_further(first, homes, rings, k)))
    return first.unionByName(second), pairs.unionByName(more)


def knn(train: DataFrame, validation: DataFrame, *, key: str = "row", vector: str = "vector", target: str = "target", k: int = 5, block: int = BLOCK) -> DataFrame:
    """Distance-weighted mean target of the k nearest training rows, exact at any size.

    Training rows lie in rings around pivots, at most ``block`` rows each. A validation row first meets the ring it lies
    in, then only the rings that may have a row as near as its k-th so far by the triangle inequality. Validation rows
    of one ring travel together, so a training block is copied once for each block of them that needs it. A training
    row at distance zero decides alone. Without training rows there is no result.
    """
    near, _ = nearest_rows(train, validation, key=key, vector=vector, target=target, k=k, block=block)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("_id").orderBy("_dist", "_y"))).filter(F.col("_rank") <= k)
    exact = F.col("_dist") == 0
    weight = 1 / F.when(~exact, F.col("_dist"))
    out = ranked.groupBy(F.col("_id").alias(key)).agg(
        F.avg(F.when(exact, F.col("_y"))).alias("_same"), (F.sum(weight * F.col("_y")) / F.sum(weight)).alias("_near"), F.count(F.lit(1)).alias("neighbours")
    )
    return out.select(key, F.coalesce("_same", "_near").alias("predicted"), "neighbours")


def group_confusion(ledger: DataFrame, group: str = "lot", *, actual: str = "actual_bad", predicted: str = "predicted_bad") -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return ledger.groupBy(group).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))


def bootstrap_ci(before: DataFrame, after: DataFrame, group: str = "lot", *, draws: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the accuracy and f1 difference over multinomial resamples of groups.

    Both inputs are per-group confusion counts. Each resample picks as many groups as there are, by a seeded
    hash of (draw, slot), so no random state is kept and retries repeat the same picks.
    """
    counts = ["tp", "fp", "fn", "tn"]
    side = lambda df, p: df.select(group, *[F.col(c).alias(p + c) for c in counts])
    groups = row_index(side(before, "b_").join(side(after, "a_"), group), [], [group], name="_pos")
    n = groups.count()
    picks = before.sparkSession.range(draws * n).select(
        F.floor(F.col("id") / n).alias("_draw"), (seeded_number(seed, "id") % n + 1).alias("_pos")
    )
    drawn = picks.join(measured(groups), "_pos").groupBy("_draw").agg(*[F.sum(p + c).alias(p + c) for p in ("b_", "a_") for c in counts])

    def rates(p):
        named = drawn.select("_draw", *[F.col(p + c).alias(c) for c in counts])
        return confusion_rates(named).select("_draw", F.col("accuracy").alias(p + "accuracy"), F.col("f1").alias(p + "f1"))

    both = rates("b_").join(rates("a_"), "_draw")
    long = both.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col("a_" + m) - F.col("b_" + m)).alias("d")) for m in ("accuracy", "f1")
    ])).alias("_e")).select("_e.metric", "_e.d")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("draws"), q.alias("_q")).select("metric", "draws", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


class NeighbourModel(Model, HasFeaturesCol, HasPredictionCol):
    """Predicts with ``knn`` from the kept training vectors."""

    def __init__(self, train: DataFrame, k: int):
        super().__init__()
        self.train, self.k = train, k

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = pin(dataset.withColumn("_row", F.monotonically_increasing_id()))  # numbers must not change between the two uses
        found = knn(self.train, rows.select(F.col("_row").alias("row"), vector_to_array(F.col(self.getFeaturesCol())).alias("vector")), k=self.k)
        return rows.join(found.select(F.col("row").alias("_row"), F.col("predicted").alias(self.getPredictionCol())), "_row", "left").drop("_row")


class NeighbourRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Distance-weighted mean of the k nearest training rows, as a pipeline's last stage."""

    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k: int = 5):
        super().__init__()
        self._setDefault(k=5)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def _fit(self, dataset: DataFrame) -> NeighbourModel:
        label = F.col(self.getLabelCol()).cast("double")
        train = dataset.select(F.monotonically_increasing_id().alias("row"), vector_to_array(F.col(self.getFeaturesCol())).alias("vector"), label.alias("target"))
        return self._copyValues(NeighbourModel(pin(train.filter("target is not null")), self.getOrDefault(self.k)))
