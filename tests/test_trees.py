"""Extra trees and histogram boosting against plain versions on one machine."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from yieldloom.operators import models, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] + 0.1 * rng.normal(size=240)
    x[::9, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row int, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(df).cache(), x, y


def plain_extra(x, y, seed, number, most, least):
    """The same draws on whole arrays; a dict of heap numbers."""
    found = {}

    def grow(name, rows, depth):
        part, label = x[rows], y[rows]
        live = sorted((trees.unit(seed, number, name, f, 1), f) for f in range(x.shape[1]) if part[:, f].min() < part[:, f].max())
        best = None
        if depth < most and len(rows) >= 2 * least:
            for _, f in live[: int(np.ceil(np.sqrt(x.shape[1])))]:
                low, high = part[:, f].min(), part[:, f].max()
                cut = low + (high - low) * trees.unit(seed, number, name, f, 2)
                left = part[:, f] <= cut
                if least <= left.sum() <= len(rows) - least:
                    gain = label[left].sum() ** 2 / left.sum() + label[~left].sum() ** 2 / (~left).sum() - label.sum() ** 2 / len(rows)
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = gain, f, cut, left
        if best is None:
            found[name] = label.mean()
            return
        grow(2 * name, rows[best[3]], depth + 1)
        grow(2 * name + 1, rows[~best[3]], depth + 1)

    grow(1, np.arange(len(y)), 0)
    return found


def named(tree):
    """Leaf values by heap number."""
    out, todo = {}, [(0, 1)]
    while todo:
        node, name = todo.pop()
        f, _, left, right, value, _ = tree.nodes[node]
        if f < 0:
            out[name] = value
        else:
            todo += [(int(left), 2 * name), (int(right), 2 * name + 1)]
    return out


def test_extra_trees(spark, data):
    rows, x, y = data
    full = rows.filter("b is not null")
    kept = ~np.isnan(x[:, 1])
    maker = trees.ExtraTreesRegressor(trees=2, maxDepth=4, minLeaf=3, seed=9).setLabelCol("y")
    one, many = maker.fit(full.coalesce(1)), maker.fit(full.repartition(8))
    for n, (a, b) in enumerate(zip(one.trees(), many.trees())):
        want = plain_extra(x[kept], y[kept], 9, n, 4, 3)
        assert named(a) == pytest.approx(want) and named(a) == named(b)
    again = many.transform(full).select("row", "prediction").collect()
    by_hand = np.mean([t.predict(x) for t in many.trees()], axis=0)
    assert all(r.prediction == pytest.approx(by_hand[r.row]) for r in again)
    assert maker.fit(full.limit(0)).trees()[0].nodes == [[-1, 0, 0, 0, 0, 0]]


def test_extra_trees_beside_a_forest(data):
    rows, _, _ = data
    full = rows.filter("b is not null")
    train, held = full.filter("row % 4 <> 0"), full.filter("row % 4 = 0")

    def r2(model):
        p = np.array([(r.y, r.prediction) for r in model.transform(held).select("y", "prediction").collect()])
        return 1 - ((p[:, 0] - p[:, 1]) ** 2).sum() / ((p[:, 0] - p[:, 0].mean()) ** 2).sum()

    forest = r2(RandomForestRegressor(labelCol="y", numTrees=8, maxDepth=5, seed=1).fit(train))
    assert r2(trees.ExtraTreesRegressor(trees=8, maxDepth=7, seed=1).setLabelCol("y").fit(train)) > forest - 0.15


def plain_boost(x, y, edges, rounds, depth, least, rate, leaves):
    """Best leaf first on whole arrays; predictions after all rounds."""
    total = np.full(len(y), y.mean())
    for _ in range(rounds):
        rest = y - total

        def best(rows):
            g, found = rest[rows], None
            for f in range(x.shape[1]):
                v = x[rows, f]
                gap = np.isnan(v)
                for cut in [*edges[f], np.inf]:
                    for left_gap in ([False, True] if gap.any() else [False]):
                        left = np.where(gap, left_gap, v <= cut)
                        if least <= left.sum() <= len(rows) - least:
                            gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(rows)
                            if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                                found = gain, left
            return found

        nodes = [(np.arange(len(y)), 0)]
        open_ = [(nodes[0], best(nodes[0][0]))]
        done = []
        while open_ and len(open_) + len(done) < leaves:
            open_.sort(key=lambda o: -(o[1][0] if o[1] and o[0][1] < depth else -1))
            (rows, level), cut = open_.pop(0)
            if cut is None or level >= depth:
                done.append(rows)
                continue
            for side in (rows[cut[1]], rows[~cut[1]]):
                open_.append(((side, level + 1), best(side)))
        for rows in [*done, *(o[0][0] for o in open_)]:
            total[rows] += rate * rest[rows].mean()
    return total


@pytest.mark.parametrize(("leaves", "depth"), [(0, 2), (4, 3)])
def test_boosting(data, leaves, depth):
    rows, x, y = data
    maker = trees.HistBoostingRegressor(trees=2, maxDepth=depth, minLeaf=5, rate=0.3, bins=8, maxLeaves=leaves).setLabelCol("y")
    model = maker.fit(rows.repartition(5))
    edges = [np.unique(np.nanquantile(x[:, f], [i / 8 for i in range(1, 8)])) for f in range(3)]
    want = plain_boost(x, y, edges, 2, depth, 5, 0.3, leaves or 10**9)
    assert all(r.prediction == pytest.approx(want[r.row]) for r in model.transform(rows).select("row", "prediction").collect())


def test_refresh_and_saving(data, tmp_path, monkeypatch):
    """Predictions written anew between rounds change nothing; a saved model predicts the same; empty input has no trees."""
    rows, _, _ = data
    maker = trees.HistBoostingRegressor(trees=3, maxDepth=1, minLeaf=5, bins=8).setLabelCol("y")
    plain = maker.fit(rows)
    monkeypatch.setattr(trees, "REFRESH", 1)
    assert [v for t in maker.fit(rows).trees() for n in t.nodes for v in n] == pytest.approx([v for t in plain.trees() for n in t.nodes for v in n])
    plain.write().overwrite().save(str(tmp_path / "m"))
    loaded = trees.HistBoostingModel.load(str(tmp_path / "m"))
    assert [r.prediction for r in loaded.transform(rows).collect()] == [r.prediction for r in plain.transform(rows).collect()]
    assert maker.fit(rows.limit(0)).trees() == []


def test_nine_regressors(data):
    """All nine candidates of the equipment study predict as pipeline stages."""
    rows, _, _ = data
    table = models.candidate_sets("equipment", "quick")
    assert len(table) == 9
    slim = models.indicator_columns(rows.drop("features").filter("row < 60"), ["a", "b", "c"])
    for name, (model, options) in table.items():
        if model.hasParam("trees"):
            model = model.copy({model.trees: 1, model.maxDepth: 2})
        fitted = models.pipeline(["a", "b", "c"], "y", model, **options).fit(slim.filter("row % 3 <> 0"))
        assert fitted.transform(slim.filter("row % 3 = 0")).filter(F.col("prediction").isNotNull()).count() == 20, name
