"""Ranking, metrics, thresholds, folds, models and importance."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from yieldloom.operators import components, folds, importance, metrics, models, ranking, sets


def test_dynamic_top_n_and_class_means(spark):
    rows = [("a", 0, 1, 0.7), ("a", 1, 0, 0.9), ("a", 2, 0, 0.1), ("b", 3, 1, 0.2), ("b", 4, 1, 0.8)]
    df = spark.createDataFrame(rows, "lot string, row int, actual_bad int, probability double")
    for hot in (None, 1):
        got = ranking.top_n_per_group_dynamic(df, hot_rows=hot).orderBy("row").collect()
        assert [r.selected for r in got] == [0, 1, 0, 1, 1]
    rows = [(0, 0.0, 0, 1), (1, 10.0, 1, 1), (2, 2.0, 0, 2), (3, 20.0, 1, 2)]
    df = spark.createDataFrame(rows, "row int, response double, actual_bad int, fold int").withColumn("predicted_bad", F.col("actual_bad"))
    assert [r.class_mean for r in ranking.class_mean_prediction(df).orderBy("row").collect()] == [2.0, 20.0, 0.0, 10.0]


def test_rank_average(spark):
    rows = [("a", 0, 0.2, 2.0), ("a", 1, 0.8, 80.0), ("b", 2, 10.0, -4.0), ("b", 3, 20.0, 7.0)]
    df = spark.createDataFrame(rows, "lot string, row int, p double, q double")
    for hot in (None, 1):
        got = ranking.percent_rank_avg(df, ["p", "q"], hot_rows=hot).orderBy("row").collect()
        assert [r.rank_average for r in got] == [0.5, 1.0, 0.5, 1.0]


@pytest.fixture(scope="module")
def guard(spark):
    rows = list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0.05, 0.1, 0.2, 0.4, 0.25, 0.45, 0.7, 0.9]))
    return spark.createDataFrame(rows, "actual_bad int, probability double")


@pytest.mark.parametrize("hot", [None, 2])
def test_auc_and_guardrail(guard, hot):
    scores = metrics.ranking_scores(guard, hot_rows=hot).first()
    assert scores.roc_auc == pytest.approx(0.9375) and scores.pr_auc == pytest.approx(0.95)
    best = metrics.recall_guardrail(guard, minimum_recall=0.75, hot_rows=hot).first()
    assert best.threshold == pytest.approx(0.45) and best.precision == 1.0 and best.recall == 0.75
    none = metrics.recall_guardrail(guard.withColumn("actual_bad", F.lit(0)), hot_rows=hot).first()
    assert none.threshold == 0.5


def test_classification_from_responses(spark):
    df = spark.createDataFrame([(0.40, 0.39), (1.00, 0.70), (0.42, 0.43), (1.10, 0.90)], "actual double, predicted double")
    c = metrics.response_then_classify(df, 0.75).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 0, 1, 1)
    r = metrics.regression_metrics(df).first()
    err = np.array([0.01, 0.30, -0.01, 0.20])
    assert r.mae == pytest.approx(np.abs(err).mean()) and r.rmse == pytest.approx(np.sqrt((err**2).mean()))


def test_folds_keep_groups_together(spark):
    rows = [(f"g{g}", i, int((g + i) % 3 == 0)) for g in range(12) for i in range(g + 2)]
    df = spark.createDataFrame(rows, "lot string, row int, bad int")
    for out in (folds.group_kfold(df, k=3), folds.stratified_group_kfold(df, "bad", k=3)):
        assert out.count() == df.count()
        assert out.groupBy("lot").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
        sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 6
    split = folds.group_shuffle_split(df, share=0.25)
    assert sets.disjoint_check(split.filter("is_test"), split.filter("NOT is_test"), ["lot"])
    assert split.filter("is_test").select("lot").distinct().count() == 3


def test_held_out_group_never_fits(spark):
    rows = [(i, float(v), float(v), g) for i, (v, g) in enumerate([(0, 1), (0, 1), (10, 2), (10, 2)])]
    df = spark.createDataFrame(rows, "row int, x double, y double, fold int")
    got = models.mean_baseline_ledger(df, ["row"], "y").orderBy("row").collect()
    assert [r.predicted for r in got] == [10.0, 10.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=60)
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 0), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row int, a double, b double, c double, y double, bad int, fold int")
    return df.withColumn("c", F.when(F.col("row") % 7 != 0, F.col("c")))


def test_ledger_benchmark_and_scoring(regression):
    ridge = {"ridge": (LinearRegression(regParam=0.001), {"scale": True})}
    ledger = models.oof_ledger(regression, ["row"], ["a", "b", "c"], "y", ridge)
    assert ledger.count() == 60 and metrics.regression_metrics(ledger).first().r2 > 0.95
    runs = models.benchmark_runs(regression, ["row"], {"all": ["a", "b", "c"], "broken": ["nothing"]}, "y", ridge)
    states = {r.feature_set: (r.status, r.r2) for r in runs.collect()}
    assert states["all"][0] == "ok" and states["all"][1] > 0.95 and states["broken"][0] == "failed"
    assert metrics.champion(runs).first().feature_set == "all"
    gated = metrics.quality_gate(runs.withColumnRenamed("r2", "holdout_r2"))
    assert gated.count() == 1


def test_classifier_stacking_and_hurdle(regression):
    logistic = {"logistic": models.classifiers("quick")["logistic"], "forest": models.classifiers("quick")["random_forest"]}
    ledger = models.oof_ledger(regression, ["row"], ["a", "b", "c"], "bad", logistic, classify=True)
    aucs = {r.model: r.roc_auc for r in models.oof_classification_scores(ledger).collect()}
    assert aucs["logistic"] > 0.9
    stacked = models.stacking(regression, ["row"], ["a", "b", "c"], "bad", {"logistic": logistic["logistic"]})
    scores = {r.row: r.predicted for r in stacked.collect()}
    assert len(scores) == 60 and metrics.ranking_scores(stacked, ["model"], actual="actual", score="predicted").first().roc_auc > 0.85
    # Labels of a held-out fold are never read: turning them over leaves its scores as they are.
    turned = regression.withColumn("bad", F.when(F.col("fold") == 1, 1 - F.col("bad")).otherwise(F.col("bad")))
    again = models.stacking(turned, ["row"], ["a", "b", "c"], "bad", {"logistic": logistic["logistic"]}).filter("fold = 1")
    assert all(r.predicted == pytest.approx(scores[r.row]) for r in again.collect())


def test_nested_tuning_searches_every_fold(regression):
    ledger = models.nested_tuning(regression, ["row"], ["a", "b", "c"], "y", LinearRegression(), models.search_grids("balanced")["ridge"], scale=True)
    assert ledger.count() == 60 and metrics.regression_metrics(ledger).first().r2 > 0.9
    assert {r.params for r in ledger.select("params").distinct().collect()} == {"regParam=0.1"}
    turned = regression.withColumn("y", F.when(F.col("fold") == 2, -F.col("y")).otherwise(F.col("y")))
    again = models.nested_tuning(turned, ["row"], ["a", "b", "c"], "y", LinearRegression(), {"regParam": [0.1]}, scale=True).filter("fold = 2")
    first = {r.row: r.predicted for r in ledger.collect()}
    assert all(r.predicted == pytest.approx(first[r.row]) for r in again.collect())


def test_input_names_follow_the_filters(regression):
    fitted = models.pipeline(["a", "b", "c"], "y", LinearRegression(), select=2).fit(models.indicator_columns(regression.withColumn("y", F.col("y").cast("double")), ["a", "b", "c"]))
    assert models.input_names(fitted, ["a", "b", "c"]) == ["a", "b"]
    assert [components.component_count(n) for n in (1, 10, 1000)] == [1, 7, 25]


def test_hurdle_means(regression):
    means = models.fold_class_means(regression, response="y", bad="bad")
    joined = regression.join(means, "fold")
    out = models.hurdle(joined, F.lit(0.5), F.col("good_mean"), F.col("bad_mean"), 1.0).first()
    assert out.hurdle == pytest.approx((out.good_mean + out.bad_mean) / 2)


def test_attribution_sums_to_prediction(regression):
    rows = regression.fillna(0.0)
    parts = importance.linear_attribution(rows, ["row"], ["a", "b"], [2.0, -1.0], 0.5)
    total = parts.groupBy("row").agg((F.sum("contribution") + F.first("base")).alias("p")).join(rows, "row")
    assert total.filter(F.abs(F.col("p") - (0.5 + 2 * F.col("a") - F.col("b"))) > 1e-9).isEmpty()
    w = importance.original_coefficients(np.array([1.0, 2.0]), components=np.array([[1.0, 0.0], [0.0, 1.0]]), scale=np.array([2.0, 4.0]))
    assert w.tolist() == [0.5, 0.5]

    def score(df):
        return metrics.regression_metrics(df.withColumn("p", 2 * F.col("a") - F.col("b")), actual="y", predicted="p").first().r2

    drops = {r.feature: r.importance for r in importance.permutation_importance(rows, ["a", "c"], score, order=["row"]).collect()}
    assert drops["a"] > 0.5 and drops["c"] == pytest.approx(0.0)


def test_repeated_permutation(regression):
    rows = regression.fillna(0.0)
    line = lambda c: 2 * c["a"] - c["b"] + 0 * c["c"]
    got = {r.feature: r for r in importance.repeated_permutation_importance(rows, ["a", "b", "c"], line, "y", order=["row"]).collect()}
    assert got["a"].importance_mean > got["b"].importance_mean > 0.1 and got["a"].importance_std > 0
    assert got["c"].importance_mean == pytest.approx(0.0) and got["c"].importance_std == pytest.approx(0.0)
    one = importance.repeated_permutation_importance(rows, ["a"], lambda c: 2 * c["a"] - F.col("b"), "y", order=["row"], repeats=1).first()
    assert one.importance_std == 0.0 and importance.repeated_permutation_importance(rows.limit(0), ["a"], lambda c: c["a"], "y", order=["row"]).count() == 0


@pytest.mark.parametrize("block", [10_000, 7])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=40)
    v = np.vstack([rng.normal(size=(9, 4)), x[3]])
    train = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(40)], "row int, vector array<double>, target double")
    valid = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)], "row int, vector array<double>")
    got = {r.row: r.predicted for r in importance.knn(train, valid, k=3, block=block).collect()}
    for i in range(9):
        d = np.sqrt(((x - v[i]) ** 2).sum(axis=1))
        near = np.argsort(d)[:3]
        assert got[i] == pytest.approx((y[near] / d[near]).sum() / (1 / d[near]).sum())
    assert got[9] == pytest.approx(y[3])


@pytest.mark.parametrize("clusters", [8, 16])
def test_knn_visits_few_blocks_of_clustered_rows(spark, clusters):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(clusters, 3)) * 1000
    x, v = np.repeat(centre, 50, axis=0) + rng.normal(size=(clusters * 50, 3)), np.repeat(centre, 10, axis=0) + rng.normal(size=(clusters * 10, 3))
    train = spark.createDataFrame([(i, x[i].tolist(), float(i)) for i in range(len(x))], "row int, vector array<double>, target double")
    valid = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "row int, vector array<double>")
    near, pairs = importance.nearest_rows(train, valid, key="row", vector="vector", target="target", k=3, block=10)
    got = {}
    for r in near.collect():
        got.setdefault(r["_id"], []).append(r["_dist"])
    for i, point in enumerate(v):
        assert sorted(got[i])[:3] == pytest.approx(np.sort(np.sqrt(((x - point) ** 2).sum(axis=1)))[:3])
    assert pairs.count() < clusters * 60  # linear in the clusters; all pairs of blocks are 5 * clusters**2 at least


def test_knn_of_few_equal_and_no_rows(spark):
    valid = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0, 5.0])], "row int, vector array<double>")
    train = spark.createDataFrame([(i, [1.0, 2.0], float(i)) for i in range(30)], "row int, vector array<double>, target double")
    assert importance.knn(train.limit(0), valid).collect() == [] and importance.knn(train, valid.limit(0)).collect() == []
    assert {r.row: r.predicted for r in importance.knn(train, valid, k=4, block=7).collect()} == {0: 1.5, 1: pytest.approx(1.5)}
    assert {r.row: r.neighbours for r in importance.knn(train.filter("row < 2"), valid, k=4, block=1).collect()} == {0: 2, 1: 2}


def test_bootstrap_interval(spark):
    counts = spark.createDataFrame([(f"l{i}", 5, 1, 2, 10 + i) for i in range(8)], "lot string, tp long, fp long, fn long, tn long")
    same = {r.metric: r for r in importance.bootstrap_ci(counts, counts, draws=200).collect()}
    assert same["f1"].ci_low == same["f1"].ci_high == 0.0 and same["f1"].draws == 200
    better = counts.withColumns({"tp": F.col("tp") + F.col("fn"), "fn": F.lit(0).cast("long")})
    gain = {r.metric: r for r in importance.bootstrap_ci(counts, better, draws=200).collect()}
    assert gain["accuracy"].ci_low > 0


def test_f_scores(spark):
    rows = [("x", 0, 1.0), ("x", 0, 2.0), ("x", 1, 5.0), ("x", 1, 6.0), ("flat", 0, 1.0), ("flat", 1, 1.0)]
    df = spark.createDataFrame(rows, "feature string, bad int, value double")
    got = {r.feature: (r.f_score, r.importance) for r in importance.f_score_importance(df).collect()}
    assert got["x"] == (pytest.approx(32.0), pytest.approx(1.0)) and got["flat"] == (0.0, 0.0)
