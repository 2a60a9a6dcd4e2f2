"""Ridge from sums of products against fitted pipelines; the median stage; stored bundles."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from yieldloom.operators import bundles, imputation, linear, metrics, models
from yieldloom.operators.contracts import ContractError

NAMES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 3)) * [1.0, 50.0, 1e-3] + [0.0, 1e6, 5.0]
    y = 2 * x[:, 0] - x[:, 1] / 50 + 300 * x[:, 2] + 0.1 * rng.normal(size=90)
    data = [(i, *map(float, x[i]), 7.0, float(y[i]), i % 4) for i in range(90)]
    df = spark.createDataFrame(data, "row int, a double, b double, c double, flat double, y double, fold int")
    gaps = df.withColumns({"a": F.when(F.col("row") % 7 != 0, F.col("a")), "c": F.when(F.col("row") % 5 != 0, F.col("c")).otherwise(F.when(F.col("row") % 2 == 0, float("nan")))})
    return gaps.withColumn("a", F.when((F.col("fold") != 2) | (F.col("row") > 40), F.col("a"))).cache()


def fitted(rows, k, model, **options):
    """One fold by the pipeline that is fitted to rows."""
    ready = models.indicator_columns(rows.withColumns({n: imputation.present(n) for n in NAMES}), NAMES)
    out = models.pipeline(NAMES, "y", model, **options).fit(ready.filter(F.col("fold") != k)).transform(ready.filter(F.col("fold") == k))
    return {r.row: r.prediction for r in out.select("row", "prediction").collect()}


@pytest.mark.parametrize(("penalty", "select"), [(0.01, None), (0.5, 2)])
def test_ledger_equals_fitted_pipelines(rows, penalty, select):
    got = {r.row: r.predicted for r in linear.ridge_ledger(rows, ["row"], NAMES, "y", {"m": penalty}, select=select).collect()}
    want = {}
    for k in range(4):
        want |= fitted(rows, k, LinearRegression(regParam=penalty), scale=True, select=select)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-8 * max(map(abs, want.values()))


def test_ledger_takes_the_short_way(rows, monkeypatch):
    called = []
    monkeypatch.setattr(models, "pipeline", lambda *a, **b: called.append(a))
    models.oof_ledger(rows, ["row"], NAMES, "y", {"m": (LinearRegression(regParam=1.0), {"scale": True})}).count()
    assert not called
    assert models.is_ridge(LinearRegression(regParam=1.0), {"scale": True}) and not models.is_ridge(RandomForestRegressor(), {})
    assert not models.is_ridge(LinearRegression(regParam=1.0, elasticNetParam=0.5), {}) and not models.is_ridge(LinearRegression(), {})


def test_partitions_and_odd_rows(spark, rows):
    """The same on any partitions; rows without a response or fold teach nothing; a fold of constant responses still fits."""
    one = linear.ridge_ledger(rows.coalesce(1), ["row"], NAMES, "y", {"m": 1.0}).orderBy("row").collect()
    extra = rows.limit(1).withColumns({"row": F.lit(-1), "y": F.lit(None).cast("double"), "a": F.lit(1e9)})
    extra = extra.unionByName(extra.withColumns({"row": F.lit(-2), "fold": F.lit(None).cast("int"), "y": F.lit(1e9)}))
    many = linear.ridge_ledger(rows.unionByName(extra).repartition(9), ["row"], NAMES, "y", {"m": 1.0}).orderBy("row").collect()
    assert many[0].row == -1 and many[0].actual is None and [r.row for r in many[1:]] == [r.row for r in one]
    assert all(x.predicted == pytest.approx(z.predicted, rel=1e-9) for x, z in zip(one, many[1:]))
    flat = linear.ridge_ledger(rows.withColumn("y", F.lit(3.0)), ["row"], NAMES, "y", {"m": 1.0})
    assert {r.predicted for r in flat.collect()} == {3.0}
    same = linear.ridge_ledger(rows, ["row"], ["flat"], "y", {"m": 1.0}).join(models.mean_baseline_ledger(rows, ["row"], "y").select("row", F.col("predicted").alias("mean")), "row")
    assert same.filter("abs(predicted - mean) > 1e-6").isEmpty()


def test_tuning_scores_from_sums(rows):
    """The chosen penalty is that of the best mean r2 of models fitted to rows."""
    grid = [0.1, 500.0]
    rows = rows.withColumn("fold", F.least("fold", F.lit(2)))
    got = {r.fold: r.params for r in linear.ridge_tuning(rows, ["row"], NAMES, "y", grid).select("fold", "params").distinct().collect()}
    actual = {r.row: (r.fold, r.y) for r in rows.collect()}
    for k in range(3):
        scores = []
        for penalty in grid:
            inner = []
            for j in set(range(3)) - {k}:
                p = fitted(rows.filter(F.col("fold") != k), j, LinearRegression(regParam=penalty), scale=True)
                y = np.array([actual[i][1] for i in p])
                inner.append(1 - sum((y - list(p.values())) ** 2) / sum((y - y.mean()) ** 2))
            scores.append(np.mean(inner))
        assert got[k] == f"regParam={grid[int(np.argmax(scores))]}"


def test_median_stage(spark, tmp_path):
    """Exact medians of odd and even numbers of values; the saved stage is loaded with its pipeline; hot columns are cut."""
    df = spark.createDataFrame([(1.0, 4.0), (None, 2.0), (9.0, float("nan")), (2.0, None), (5.0, 8.0)], "a double, `b.c` double")
    model = Pipeline(stages=[imputation.MedianImputer(inputCols=["a", "b.c"], outputCols=["x", "y"])]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        assert [tuple(r) for r in m.transform(df).select("x", "y").collect()] == [(1.0, 4.0), (3.5, 2.0), (9.0, 4.0), (2.0, 4.0), (5.0, 8.0)]
    values = np.random.default_rng(1).normal(size=5001)
    many = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    assert imputation.column_medians(many, ["v"], hot_rows=100) == [pytest.approx(np.median(values), abs=1e-15)]
    with pytest.raises(ValueError, match="without values"):
        imputation.MedianImputer(inputCols=["a"], outputCols=["x"]).fit(df.withColumn("a", F.lit(None).cast("double")))


CONTRACT = bundles.TraceContract(columns=("WAFER_ID", "STAGE", "TIMESTAMP", "P", "Q"))
FEATURES = ["P__mean", "P__max", "sample_count", "Q__mean"]


@pytest.fixture(scope="module")
def traces(spark):
    rng = np.random.default_rng(2)
    rows = [(w, s, float(t), float(w % 7 + rng.normal()), float(rng.normal()), 0) for w in range(30) for s in "AB" for t in range(3 + w % 4)]
    return spark.createDataFrame(rows, "WAFER_ID long, STAGE string, TIMESTAMP double, P double, Q double, _source_index long")


def learn(traces, root, candidates):
    facts = bundles.Facts("", "rate", tuple(FEATURES), "signals", CONTRACT)
    rows = bundles.batch_features(bundles.validate_traces(traces, CONTRACT), facts)
    rows = rows.withColumns({"rate": 5 * F.col("P__mean") + F.col("sample_count"), "fold": (F.col("WAFER_ID") % 3).cast("int")})
    return rows, bundles.publish_champion(rows, ["WAFER_ID", "STAGE"], FEATURES, "rate", candidates, root, recipe="signals", contract=CONTRACT)


def test_bundle_end_to_end(spark, traces, tmp_path, monkeypatch):
    root = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, root)
    candidates = {"strong": (LinearRegression(regParam=50.0), {"scale": True}), "weak": (LinearRegression(regParam=0.01), {"scale": True})}
    rows, made = learn(traces, root, candidates)
    loaded = bundles.load_bundle(spark, root)
    assert made.facts.name == "weak" and loaded.facts == made.facts and loaded.version == made.version
    # The reloaded model predicts what the fitted one does, and what a refit on all rows does.
    ready = bundles.prepared(rows, FEATURES, ["WAFER_ID", "STAGE", "rate"])
    want = {(r.WAFER_ID, r.STAGE): r.prediction for r in made.model.transform(ready).collect()}
    again = models.pipeline(FEATURES, "rate", LinearRegression(regParam=0.01), scale=True).fit(ready).transform(ready).collect()
    out = bundles.score_new_traces(traces.withColumn("STAGE", F.concat(F.lit(" "), F.lower("STAGE"))), loaded)
    got = {(r.WAFER_ID, r.STAGE): r.predicted for r in out.predictions.collect()}
    assert got == pytest.approx(want) and {(r.WAFER_ID, r.STAGE): r.prediction for r in again} == pytest.approx(want)
    report = out.report.first()
    assert (report.trace_rows, report.samples, report.stages, report.absent_features, report.target_in_input) == (traces.count(), 60, ["A", "B"], [], False)

    # A write that is interrupted before the switch leaves the old version.
    monkeypatch.setattr(bundles, "switch", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        learn(traces, root, {"strong": candidates["strong"]})
    assert bundles.load_bundle(spark, root).version == made.version
    monkeypatch.undo()
    _, second = learn(traces, root, {"strong": candidates["strong"]})
    assert bundles.load_bundle(spark, root, minimum_r2=-9.0).version == second.version != made.version
    with pytest.raises(ContractError, match="r2"):
        bundles.load_bundle(spark, root, minimum_r2=0.9999999)


def test_bundle_refuses_and_reports(spark, traces, tmp_path):
    _, bundle = learn(traces, str(tmp_path / "b"), {"m": (LinearRegression(regParam=0.01), {"scale": True})})
    for broken, words in ((traces.drop("Q"), "missing required columns"), (traces.withColumn("STAGE", F.lit("C")), "stage"), (traces.withColumn("STAGE", F.lit(None).cast("string")), "stage"), (traces.withColumn("TIMESTAMP", F.lit("x")), "key or the time")):
        with pytest.raises(ContractError, match=words):
            bundles.score_new_traces(broken, bundle)
    # A signal that is all missing or no number is imputed and listed; extra columns don't matter; the target is noticed.
    batch = traces.filter("WAFER_ID < 3").withColumns({"Q": F.lit("off"), "rate": F.lit(1.0), "feature": F.lit("x")}).drop("_source_index")
    out = bundles.score_new_traces(batch, bundle)
    assert out.predictions.count() == 6 and out.report.first().absent_features == ["Q__mean"] and out.report.first().target_in_input
    none = bundles.score_new_traces(traces.limit(0), bundle)
    assert none.predictions.count() == 0 and none.report.first().trace_rows == 0
    assert metrics.champion(spark.createDataFrame([("a", None), ("b", 0.2)], "model string, r2 double")).first().model == "b"
