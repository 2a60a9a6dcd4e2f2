"""Extremely randomised trees and histogram boosting, grown level by level from sums merged over the cluster."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.plans import group_stats
from yieldloom.session import pin

#: Trees that grow together; what a level merges is bounded by their open nodes.
TREES_AT_A_TIME = 8
#: Boosting rounds after which the rows' predictions are written anew instead of being added up from trees.
REFRESH = 8
#: Significant digits of scores, so that sums in another order choose the same cut.
DIGITS = 10
NODE_FIELDS = 6  # feature (-1: leaf), threshold, left, right, value, whether missing values go left


@dataclass
class Tree:
    """Nodes by number; node 0 is the root, children follow their parents. Values up to the threshold go left."""

    nodes: list[list[float]]

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(self.nodes, float).reshape(-1, NODE_FIELDS)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], table[:, 5] > 0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row reaches."""
        feature, threshold, left, right, _, missing_left = self.arrays()
        at = np.zeros(len(x), int)
        while len(inner := np.flatnonzero(feature[at] >= 0)):
            node = at[inner]
            value = x[inner, feature[node]]
            down = np.where(np.isnan(value), missing_left[node], value <= threshold[node])
            at[inner] = np.where(down, left[node], right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.arrays()[4][self.leaves(x)]


def unit(seed: int, *parts: int) -> float:
    """A number in (0, 1) from a scramble of whole numbers: the same on every machine and partition."""
    state = seed & (2**64 - 1)
    for part in parts:
        state = (state ^ (part + 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 % 2**64
        state = (state ^ (state >> 27)) * 0x94D049BB133111EB % 2**64
        state ^= state >> 31
    return ((state >> 11) + 0.5) / 2**53


def rounded(x):
    """To DIGITS significant digits."""
    x = np.asarray(x, float)
    size = np.where(x == 0, 1.0, 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.abs(np.where(x == 0, 1.0, x))))))
    return np.round(x * size) / size


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; missing cells are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def training_rows(dataset: DataFrame, features: str, label: str) -> DataFrame:
    """(x, y) of the rows with a label, written once."""
    known = dataset.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    return pin(known.filter(F.col("y").isNotNull() & ~F.isnan("y")))


def merged(rows: DataFrame, schema: str, names: list[str], work, keys: list[str], sums: list[str], lows: list[str] = (), highs: list[str] = ()) -> DataFrame:
    """Partial rows of each batch, combined by key; dealt by the first two keys, by which the best cuts are looked for, too."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x, *rest = matrix(batch.column(0)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(x, *rest)], names=names)

    parts = rows.mapInArrow(run, schema).repartition(*keys[:2])
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


class _TreeModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A base value plus the weighted sum of trees, kept as numbers."""

    nodes = Param(Params._dummy(), "nodes", "all trees' nodes, one after the other", typeConverter=TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes of each tree", typeConverter=TypeConverters.toListInt)
    base = Param(Params._dummy(), "base", "what is predicted without any tree", typeConverter=TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "factor of each tree's value", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, nodes: list[float] | None = None, sizes: list[int] | None = None, base: float = 0.0, weight: float = 1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, trees: list[Tree], base: float, weight: float):
        return cls(nodes=[float(v) for t in trees for n in t.nodes for v in n], sizes=[len(t.nodes) for t in trees], base=base, weight=weight)

    def trees(self) -> list[Tree]:
        table = np.array(self.getOrDefault(self.nodes), float).reshape(-1, NODE_FIELDS).tolist()
        ends = np.cumsum(self.getOrDefault(self.sizes)).tolist()
        return [Tree(table[s:e]) for s, e in zip([0, *ends], ends)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, weight = self.getOrDefault(self.base), self.getOrDefault(self.weight)
        shared = dataset.sparkSession.sparkContext.broadcast(self.trees())

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 0))
            total = np.full(len(x), base)
            for tree in shared.value:
                total += weight * tree.predict(rows)
            return pd.Series(total)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))


class ExtraTreesModel(_TreeModel):
    pass


class HistBoostingModel(_TreeModel):
    pass


class _Regressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest leaf", typeConverter=TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows of a leaf", typeConverter=TypeConverters.toInt)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class ExtraTreesRegressor(_Regressor):
    """Extremely randomised trees: each open node draws one cut per candidate feature, uniformly between the feature's

    least and greatest value among the node's rows, and keeps the one that lowers the squared error most. Candidates
    are the first square root of the feature count, in an order drawn for the node, of the features that vary there.
    Draws are scrambles of seed, tree, node and feature. All rows train every tree. A level is two passes: ranges,
    then sums left of the cuts; only these, one row per open node and feature, reach the driver.
    """

    @keyword_only
    def __init__(self, *, trees: int = 60, maxDepth: int = 12, minLeaf: int = 2, seed: int = 42):
        super().__init__()
        self._setDefault(trees=60, maxDepth=12, minLeaf=2, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        count, most = self.getOrDefault(self.trees), self.getOrDefault(self.maxDepth)
        grown: list[Tree] = []
        for first in range(0, count, TREES_AT_A_TIME):
            grown += self._grow(rows, range(first, min(count, first + TREES_AT_A_TIME)), most)
        return self._copyValues(ExtraTreesModel.of(grown, 0.0, 1.0 / max(1, count)))

    def _grow(self, rows: DataFrame, numbers: range, most: int) -> list[Tree]:
        seed, least = self.getSeed(), self.getOrDefault(self.minLeaf)
        sc = rows.sparkSession.sparkContext
        trees = [Tree([[-1, 0, 0, 0, 0, 0]]) for _ in numbers]
        names = [{0: 1} for _ in numbers]  # heap number of each open node, for its draws
        for depth in range(most + 1):
            open_ = {(t, node) for t, nodes in enumerate(names) for node in nodes}
            if not open_:
                break
            shared = sc.broadcast((trees, open_))

            def ranges(x, y):
                grown, wanted = shared.value
                out = []
                for t, tree in enumerate(grown):
                    at = tree.leaves(x)
                    for node in np.unique(at):
                        if (t, int(node)) in wanted:
                            mine = at == node
                            part, label = x[mine], y[mine]
                            for f in range(x.shape[1]):
                                out.append((t, int(node), f, len(label), float(label.sum()), float(label @ label), float(part[:, f].min()), float(part[:, f].max())))
                return zip(*out) if out else [[]] * 8

            fields = ["tree", "node", "feature", "n", "total", "squares", "low", "high"]
            found = merged(rows, "tree long, node long, feature long, n long, total double, squares double, low double, high double", fields, ranges, fields[:3], fields[3:6], ["low"], ["high"])
            cuts: dict[tuple[int, int], dict[int, float]] = {}
            facts: dict[tuple[int, int], tuple] = {}
            spans: dict[tuple[int, int], list] = {}
            for r in found.collect():
                key = (r["tree"], r["node"])
                facts[key] = r["n"], r["total"], r["squares"]
                spans.setdefault(key, []).append((r["feature"], r["low"], r["high"]))
            if not facts:  # no rows at all
                break
            for (t, node), (n, total, squares) in facts.items():
                trees[t].nodes[node][4] = float(rounded(total / n))
                varies = squares - total * total / n > 1e-12 * max(squares, 1e-300)
                name, drawn = names[t][node], numbers[t]
                if depth < most and n >= 2 * least and varies:
                    live = sorted((unit(seed, drawn, name, f, 1), f, low, high) for f, low, high in spans[(t, node)] if low < high)
                    take = live[: int(np.ceil(np.sqrt(len(spans[(t, node)]))))]
                    if take:
                        cuts[(t, node)] = {f: low + (high - low) * unit(seed, drawn, name, f, 2) for _, f, low, high in take}
            if not cuts:
                break
            tried = sc.broadcast((trees, cuts))

            def lefts(x, y):
                grown, given = tried.value
                out = []
                for t, tree in enumerate(grown):
                    at = tree.leaves(x)
                    for node in np.unique(at):
                        for f, cut in given.get((t, int(node)), {}).items():
                            label = y[(at == node) & (x[:, f] <= cut)]
                            out.append((t, int(node), f, len(label), float(label.sum())))
                return zip(*out) if out else [[]] * 5

            fields = ["tree", "node", "feature", "n", "total"]
            sums = merged(rows, "tree long, node long, feature long, n long, total double", fields, lefts, fields[:3], fields[3:])
            best: dict[tuple[int, int], tuple] = {}
            for r in sums.collect():
                key, n_left, left = (r["tree"], r["node"]), r["n"], r["total"]
                n, total, _ = facts[key]
                if n_left < least or n - n_left < least:
                    continue
                gain = left * left / n_left + (total - left) ** 2 / (n - n_left) - total * total / n
                score = (-float(rounded(gain)), r["feature"])
                if gain > 0 and (key not in best or score < best[key]):
                    best[key] = score
            opened: list[dict[int, int]] = [{} for _ in numbers]
            for (t, node), (_, f) in sorted(best.items()):
                nodes, name = trees[t].nodes, names[t][node]
                nodes[node][:4] = [f, cuts[(t, node)][f], len(nodes), len(nodes) + 1]
                opened[t] |= {len(nodes): 2 * name, len(nodes) + 1: 2 * name + 1}
                nodes += [[-1, 0, 0, 0, 0, 0], [-1, 0, 0, 0, 0, 0]]
            names = opened
        return trees


class HistBoostingRegressor(_Regressor):
    """Boosted trees on binned features for squared error.

    Bins are cut once at exact quantiles. Each level merges gradient sums by (leaf, feature, bin); the best cut of a
    leaf is found in Spark and one row per leaf is collected. Missing values need no imputation: they go to the side that
    gains more. With ``maxLeaves`` the tree keeps the cuts that growing the best leaf first would make. ``rowShare`` and
    ``columnShare`` below 1 draw rows and features for each tree by seeded scrambles.
    """

    rate = Param(Params._dummy(), "rate", "factor of each tree", typeConverter=TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature without missing values", typeConverter=TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "most leaves of a tree, 0 for no limit", typeConverter=TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "added to the row count of a leaf", typeConverter=TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows of each tree", typeConverter=TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of features of each tree", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, trees: int = 60, maxDepth: int = 8, minLeaf: int = 10, rate: float = 0.1, bins: int = 64, maxLeaves: int = 31, penalty: float = 0.0, rowShare: float = 1.0, columnShare: float = 1.0, seed: int = 42):
        super().__init__()
        self._setDefault(trees=60, maxDepth=8, minLeaf=10, rate=0.1, bins=64, maxLeaves=31, penalty=0.0, rowShare=1.0, columnShare=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Distinct inner quantiles of each feature."""
        bins = self.getOrDefault(self.bins)
        cells = rows.select(F.posexplode("x").alias("feature", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        shares = {f"q{i}": i / bins for i in range(1, bins)}
        found = {r["feature"]: np.unique([r[q] for q in shares]) for r in group_stats(cells, ["feature"], "value", [], shares).collect()}
        width = rows.select(F.size("x").alias("n")).first()
        return [found.get(f, np.empty(0)) for f in range(width["n"] if width else 0)]

    def _fit(self, dataset: DataFrame) -> HistBoostingModel:
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol()).withColumn("p", F.lit(0.0))
        # A number for each row, only used to draw rows; the pinned rows keep it.
        rows = pin(rows.withColumn("r", F.xxhash64("x", "y")))
        base = rows.agg(F.avg("y")).first()[0] or 0.0
        edges, rate, count = self._edges(rows), self.getOrDefault(self.rate), self.getOrDefault(self.trees)
        trees, waiting = [], []
        for number in range(count if edges else 0):
            tree = self._grow(rows, edges, waiting, base, number)
            if len(tree.nodes) == 1 and self.getOrDefault(self.rowShare) >= 1 and self.getOrDefault(self.columnShare) >= 1:
                break  # nothing is left to learn
            trees.append(tree)
            waiting.append(tree)
            if len(waiting) == REFRESH and number + 1 < count:
                rows, waiting = pin(self._refreshed(rows, waiting, rate)), []
        return self._copyValues(HistBoostingModel.of(trees, base, rate))

    def _refreshed(self, rows: DataFrame, waiting: list[Tree], rate: float) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(list(waiting))

        @F.pandas_udf("double")
        def add(x: pd.Series, p: pd.Series) -> pd.Series:
            cells = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 0))
            return p + rate * sum(tree.predict(cells) for tree in shared.value) if len(x) else p

        return rows.withColumn("p", add("x", "p"))

    def _grow(self, rows: DataFrame, edges: list[np.ndarray], waiting: list[Tree], base: float, number: int) -> Tree:
        rate, least, penalty = (self.getOrDefault(p) for p in (self.rate, self.minLeaf, self.penalty))
        seed, sc = self.getSeed(), rows.sparkSession.sparkContext
        share = self.getOrDefault(self.columnShare)
        ranked = sorted(range(len(edges)), key=lambda f: unit(seed, number, f, 3))
        used = sorted(ranked[: max(1, int(round(share * len(edges))))])
        row_share = self.getOrDefault(self.rowShare)
        drawn = rows
        if row_share < 1:
            drawn = rows.filter(F.pmod(F.xxhash64("r", F.lit(seed), F.lit(number)), F.lit(1_000_000)) < int(row_share * 1_000_000))
        tree, open_, gains = Tree([[-1, 0, 0, 0, 0, 0]]), {0}, {}
        for _ in range(self.getOrDefault(self.maxDepth)):
            shared = sc.broadcast((tree, list(waiting), open_, edges))

            def sums(x, y, p):
                grown, before, wanted, cuts = shared.value
                at = grown.leaves(x)
                rest = y - base - p - rate * sum((t.predict(x) for t in before), np.zeros(len(x)))
                out = []
                for node in np.unique(at):
                    if int(node) not in wanted:
                        continue
                    mine = at == node
                    part, left = x[mine], rest[mine]
                    for f in used:
                        gap = np.isnan(part[:, f])
                        code = np.where(gap, -1, np.searchsorted(cuts[f], part[:, f], side="left"))  # a value on an edge lies below it
                        kinds, place = np.unique(code, return_inverse=True)
                        total = np.bincount(place, left)
                        out += [(int(node), f, int(k), int(n), float(s)) for k, n, s in zip(kinds, np.bincount(place), total)]
                return zip(*out) if out else [[]] * 5

            fields = ["node", "feature", "bin", "n", "total"]
            cells = merged(drawn.select("x", "y", "p"), "node long, feature long, bin long, n long, total double", fields, sums, fields[:3], fields[3:])
            chosen = best_cuts(cells, least, penalty).collect()  # one row per open leaf
            opened = set()
            for r in sorted(chosen, key=lambda r: r["node"]):
                node = r["node"]
                tree.nodes[node][4] = r["total"] / (r["n"] + penalty)
                if r["gain"] is not None and r["gain"] > 0:
                    start = len(tree.nodes)
                    cut = edges[r["feature"]]
                    # Behind the last edge only missing values go right.
                    tree.nodes[node][:4] = [r["feature"], float(cut[r["bin"]]) if r["bin"] < len(cut) else float("inf"), start, start + 1]
                    tree.nodes[node][5] = float(r["missing_left"])
                    gains[node] = r["gain"]
                    left = r["left_total"] / (r["left_n"] + penalty)
                    right = (r["total"] - r["left_total"]) / (r["n"] - r["left_n"] + penalty)
                    tree.nodes += [[-1, 0, 0, 0, left, 0], [-1, 0, 0, 0, right, 0]]
                    opened |= {start, start + 1}
            if not opened:
                break
            open_ = opened
        return best_first(tree, gains, self.getOrDefault(self.maxLeaves))


def best_cuts(cells: DataFrame, least: int, penalty: float) -> DataFrame:
    """(node, n, total, gain, feature, bin, missing_left, left_n, left_total): each node's best cut, or a null gain.

    ``cells``: (node, feature, bin, n, total), bin -1 being missing values. Of equal gains the first feature, then the
    first bin wins; missing values go right unless left gains more.
    """
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    run = cells.select(
        "node", "feature", "bin", F.sum("n").over(upto).alias("_n"), F.sum("total").over(upto).alias("_t"), F.sum("n").over(whole).alias("n"), F.sum("total").over(whole).alias("total"),
        F.coalesce(F.max(F.when(F.col("bin") < 0, F.col("n"))).over(whole), F.lit(0)).alias("_gn"), F.coalesce(F.max(F.when(F.col("bin") < 0, F.col("total"))).over(whole), F.lit(0.0)).alias("_gt"),
    )
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("missing_left")
    tried = run.select("*", sides).withColumns(
        {"left_n": F.col("_n") - F.when(F.col("missing_left"), 0).otherwise(F.col("_gn")), "left_total": F.col("_t") - F.when(F.col("missing_left"), 0.0).otherwise(F.col("_gt"))}
    )
    right_n, right = F.col("n") - F.col("left_n"), F.col("total") - F.col("left_total")
    allowed = (F.col("bin") >= 0) & (F.col("left_n") >= least) & (right_n >= least) & (F.col("left_n") > 0) & (right_n > 0) & ((F.col("_gn") > 0) | ~F.col("missing_left"))
    gain = F.col("left_total") ** 2 / (F.col("left_n") + penalty) + right**2 / (right_n + penalty) - F.col("total") ** 2 / (F.col("n") + penalty)
    scale = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(F.abs(gain))))
    tried = tried.withColumn("gain", F.when(allowed & (gain != 0), F.rint(gain * scale) / scale))
    order = F.struct(F.coalesce("gain", F.lit(float("-inf"))).alias("g"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("m"))
    picked = F.struct("n", "total", "gain", "feature", "bin", "missing_left", "left_n", "left_total")
    return tried.groupBy("node").agg(F.max_by(picked, order).alias("_best")).select("node", "_best.*")


def best_first(tree: Tree, gains: dict[int, float], most: int) -> Tree:
    """The tree that growing the leaf of the highest gain first, up to ``most`` leaves, would give.

    A cut's gain doesn't depend on when it is made, so the order is replayed on the whole tree and the rest is cut off.
    """
    kept, leaves = set(), 1
    queue = [(-gains[0], 0)] if 0 in gains else []
    while queue and (not most or leaves < most):
        _, node = heapq.heappop(queue)
        kept.add(node)
        leaves += 1
        for child in (int(tree.nodes[node][2]), int(tree.nodes[node][3])):
            if child in gains:
                heapq.heappush(queue, (-gains[child], child))
    out: list[list[float]] = []

    def copy(node: int) -> int:
        place = len(out)
        out.append(list(tree.nodes[node]))
        if node in kept:
            out[place][2], out[place][3] = copy(int(tree.nodes[node][2])), copy(int(tree.nodes[node][3]))
        else:
            out[place][:4] = [-1, 0, 0, 0]
        return place

    copy(0)
    return Tree(out)
