"""Spark ML pipelines, out-of-fold ledgers and the benchmarks built from them."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    PCA,
    StandardScaler,
    UnivariateFeatureSelector,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.numeric import clip
from yieldloom.operators.components import RuledPCA
from yieldloom.operators.imputation import MedianImputer
from yieldloom.operators.importance import NeighbourRegressor
from yieldloom.operators.linear import ridge_ledger, ridge_tuning
from yieldloom.operators.metrics import ranking_scores, regression_metrics
from yieldloom.operators.sets import chronological_holdout
from yieldloom.operators.trees import ExtraTreesRegressor, HistBoostingRegressor
from yieldloom.plans import measured
from yieldloom.session import pin

PARALLEL_FITS = 4

# Regularisation and forest grids of the three search profiles.
SEARCH_PROFILES = {
    "quick": {"alpha": (1.0,), "trees": (20,), "depth": (6,)},
    "balanced": {"alpha": (0.1, 1.0, 10.0), "trees": (60,), "depth": (6, 8)},
    "thorough": {"alpha": (0.01, 0.1, 1.0, 10.0, 100.0), "trees": (120, 180), "depth": (6, 8, 12)},
}


def indicator_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds a 0/1 ``<feature>__missing`` column per feature."""
    return df.withColumns({f"{f}__missing": F.col(f"`{f}`").isNull().cast("double") for f in features})


def median_impute(features: Sequence[str]) -> MedianImputer:
    """Exact medians; an even number of values has the mean of its middle two."""
    return MedianImputer(inputCols=list(features), outputCols=[f"{f}__filled" for f in features])


def observed_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value; the others must not reach an imputer."""
    row = df.agg(*[F.count(F.col(f"`{f}`")).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if row[f"_{i}"]]


def input_names(model, features: Sequence[str]) -> list[str]:
    """Names of a fitted pipeline's model inputs, followed back through its variance filter and its selector."""
    names = [*features, *(f"{f}__missing" for f in features)]
    for stage in model.stages:
        if hasattr(stage, "selectedFeatures"):
            names = [names[i] for i in stage.selectedFeatures]
    return names


def preprocessing(features: Sequence[str], label: str, *, select: int | None = None, scale: bool = False, components: int | str | None = None, categorical_label: bool = False) -> list:
    """Imputation, missing indicators, zero-variance filter, F-test filter, scaling and PCA as stages.

    ``components`` may be "rule": then each fit chooses their number by its own rows.
    """
    stages: list = [
        median_impute(features),
        VectorAssembler(inputCols=[f"{f}__filled" for f in features] + [f"{f}__missing" for f in features], outputCol="_raw"),
        VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="_raw", outputCol="_varying"),
    ]
    last = "_varying"
    if select:
        kind = "categorical" if categorical_label else "continuous"
        best = UnivariateFeatureSelector(featuresCol=last, outputCol="_selected", labelCol=label, selectionMode="numTopFeatures")
        stages.append(best.setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(select))
        last = "_selected"
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=last, outputCol="_scaled"))
        last = "_scaled"
    if components:
        reduce_to = RuledPCA if components == "rule" else partial(PCA, k=components)
        stages.append(reduce_to(inputCol=last, outputCol="_components"))
        last = "_components"
    return [*stages, last]


def pipeline(features: Sequence[str], label: str, model: Estimator, **options) -> Pipeline:
    *stages, last = preprocessing(features, label, **options)
    last_stage = model.copy().setFeaturesCol(last).setLabelCol(label)
    if hasattr(last_stage, "setProbabilityCol"):
        last_stage = last_stage.setProbabilityCol("_probability").setRawPredictionCol("_raw_prediction")
    return Pipeline(stages=[*stages, last_stage])


def regressors(profile: str = "balanced", seed: int = 42) -> dict[str, tuple[Estimator, dict]]:
    """Named regressors with preprocessing options.

    ``hist_boosting`` keeps the best leaves first, ``level_boosting`` and ``leaf_boosting`` draw four fifths of rows and
    features for each tree with a small rate, the first without a limit of leaves and with a penalty.
    """
    grid = SEARCH_PROFILES[profile]
    trees, depth = grid["trees"][0], grid["depth"][0]
    linear, drawn = {"scale": True}, {"rate": 0.05, "rowShare": 0.8, "columnShare": 0.8, "maxDepth": 6, "seed": seed}
    return {
        "ridge": (LinearRegression(regParam=grid["alpha"][0], elasticNetParam=0.0), linear),
        "lasso": (LinearRegression(regParam=0.01, elasticNetParam=1.0), linear),
        "elastic_net": (LinearRegression(regParam=0.01, elasticNetParam=0.5), linear),
        "random_forest": (RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), {}),
        "gradient_boosting": (GBTRegressor(maxIter=max(trees // 3, 5), maxDepth=3, seed=seed), {}),
        "knn": (NeighbourRegressor(k=5), linear),
        "extra_trees": (ExtraTreesRegressor(trees=trees, maxDepth=depth, minLeaf=2, seed=seed), {}),
        "hist_boosting": (HistBoostingRegressor(trees=trees, maxDepth=min(depth, 8), minLeaf=10, seed=seed), {}),
        "level_boosting": (HistBoostingRegressor(trees=trees, minLeaf=1, maxLeaves=0, penalty=1.0, **drawn), {}),
        "leaf_boosting": (HistBoostingRegressor(trees=trees, minLeaf=20, maxLeaves=31, **drawn), {}),
    }


def classifiers(profile: str = "balanced", seed: int = 42, weight: str | None = None) -> dict[str, tuple[Estimator, dict]]:
    grid = SEARCH_PROFILES[profile]
    forest = RandomForestClassifier(numTrees=grid["trees"][0], maxDepth=grid["depth"][0], seed=seed)
    logistic = LogisticRegression(regParam=0.1)
    if weight:
        forest, logistic = forest.setWeightCol(weight), logistic.setWeightCol(weight)
    return {
        "random_forest": (forest, {"categorical_label": True}),
        "logistic": (logistic, {"scale": True, "categorical_label": True}),
        "boosting": (GBTClassifier(maxIter=10, maxDepth=3, seed=seed), {"categorical_label": True}),
    }


# Candidate names of each study, all drawn from the two tables above.
CANDIDATE_SETS = {
    "equipment": ("ridge", "lasso", "elastic_net", "knn", "extra_trees", "random_forest", "hist_boosting", "level_boosting", "leaf_boosting"),
    "cmp": ("ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"),
    "run_to_failure": ("ridge", "random_forest", "gradient_boosting"),
    "response_first": ("ridge", "elastic_net", "random_forest", "gradient_boosting"),
    "trace_shape": ("ridge", "random_forest"),
    "key_numbers": ("ridge", "lasso", "random_forest", "gradient_boosting"),
    "signal": ("ridge", "random_forest", "gradient_boosting"),
    "localized": ("ridge", "elastic_net", "random_forest"),
    "lot_context": ("ridge", "random_forest"),
}


def candidate_sets(name: str, profile: str = "balanced") -> dict[str, tuple[Estimator, dict]]:
    table = regressors(profile)
    return {model: table[model] for model in CANDIDATE_SETS[name]}


def component_candidates(name: str, profile: str = "balanced") -> dict[str, tuple[Estimator, dict]]:
    """``candidate_sets`` whose scaled models see principal components, as many as each fit's rows allow; trees see the features."""
    return {model: (e, options | {"components": "rule"} if options.get("scale") else options) for model, (e, options) in candidate_sets(name, profile).items()}


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (2 * class size), so both classes weigh the same."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_bad"))
    out = df.crossJoin(F.broadcast(counts))  # one row
    size = F.when(F.col(label) == 1, F.col("_bad")).otherwise(F.col("_n") - F.col("_bad"))
    return out.withColumn(name, F.col("_n") / (2.0 * size)).drop("_n", "_bad")


def _usable_features(df: DataFrame, features: Sequence[str], fold: str) -> dict[int, list[str]]:
    """Per fold, the features with a value outside it, from one count per fold (each fold is a model to be fitted)."""
    counts = [F.count(F.col(f"`{f}`")).alias(f"_{i}") for i, f in enumerate(features)]
    rows = df.groupBy(fold).agg(*counts).collect()
    total = [sum(r[f"_{i}"] for r in rows) for i in range(len(features))]
    return {r[fold]: [f for i, f in enumerate(features) if total[i] > r[f"_{i}"]] for r in rows}


def _folds(df: DataFrame, fold: str) -> list[int]:
    """Fold numbers, each of which is a model to be fitted."""
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def is_ridge(model: Estimator, options: Mapping, parameters: Sequence[str] = ()) -> bool:
    """Whether a candidate is plain ridge regression (or becomes one with these parameters set), which needs no fitting to rows."""
    if not isinstance(model, LinearRegression) or model.isDefined("weightCol") or set(options) - {"scale", "select"}:
        return False
    plain = model.getElasticNetParam() == 0.0 and model.getFitIntercept() and model.getStandardization() and model.getLoss() == "squaredError"
    return plain and set(parameters) <= {"regParam"} and ("regParam" in parameters or model.getRegParam() > 0)


def oof_ledger(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, candidates: Mapping[str, tuple[Estimator, dict]], *, fold: str = "fold", classify: bool = False) -> DataFrame:
    """(keys, fold, model, actual, predicted): each row predicted by a model that never saw its fold.

    Ridge candidates are solved from sums of products of the folds; all others are fitted to each fold's training rows.
    """
    linear = {} if classify else {n: c for n, c in candidates.items() if is_ridge(*c)}
    if linear:
        slim = pin(df.select(*dict.fromkeys([*keys, *features, target, fold])))
        parts = []
        for select in dict.fromkeys(options.get("select") for _, options in linear.values()):
            same = {n: model.getRegParam() for n, (model, options) in linear.items() if options.get("select") == select}
            parts.append(ridge_ledger(slim, keys, features, target, same, fold=fold, select=select))
        rest = {n: c for n, c in candidates.items() if n not in linear}
        if rest:
            parts.append(oof_ledger(slim, keys, features, target, rest, fold=fold))
        return reduce(DataFrame.unionByName, parts)
    ready = indicator_columns(df.withColumns({f: F.col(f"`{f}`").cast("double") for f in features}), features)
    # Every fold trains from the pinned table instead of recomputing the features.
    ready = pin(ready.withColumn(target, F.col(target).cast("double")))

    def one(job: tuple[int, str]) -> DataFrame:
        k, name = job
        model, options = candidates[name]
        train, held = ready.filter(F.col(fold) != k), ready.filter(F.col(fold) == k)
        fitted = pipeline(usable[k], target, model, **options).fit(train)
        score = vector_to_array("_probability")[1] if classify else F.col("prediction")
        return fitted.transform(held).select(
            *keys, F.col(fold).alias("fold"), F.lit(name).alias("model"), F.col(target).alias("actual"), score.alias("predicted")
        )

    usable = _usable_features(ready, features, fold)
    folds = sorted(usable)
    with ThreadPool(PARALLEL_FITS) as pool:  # independent fits share the cluster
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), [(k, name) for k in folds for name in candidates])
    return reduce(DataFrame.unionByName, parts)


def mean_baseline_ledger(df: DataFrame, keys: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """The ledger of predicting the mean of all other folds (totals minus own, no model)."""
    own = df.groupBy(fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = own.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    means = own.crossJoin(total).select(fold, ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("predicted"))
    joined = df.join(measured(means), fold)
    return joined.select(*keys, F.col(fold).alias("fold"), F.lit("mean").alias("model"), F.col(target).cast("double").alias("actual"), "predicted")


def search_grids(profile: str = "balanced") -> dict[str, dict[str, Sequence]]:
    """Parameter grids of a search profile by model name."""
    grid = SEARCH_PROFILES[profile]
    forest = {"numTrees": grid["trees"], "maxDepth": grid["depth"]}
    return {"ridge": {"regParam": grid["alpha"]}, "random_forest": forest}


def nested_tuning(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, model: Estimator, grid: Mapping[str, Sequence], *, fold: str = "fold", **options) -> DataFrame:
    """(keys, fold, params, actual, predicted): the whole grid is searched anew for each outer fold.

    The other outer folds serve as grouped inner folds; the parameters of the best mean r2 (the first wins ties) are
    refitted on all of them and predict the outer fold, whose rows no part of the search has seen.
    """
    if is_ridge(model, options, list(grid)) and all(v > 0 for v in grid["regParam"]):
        slim = pin(df.select(*dict.fromkeys([*keys, *features, target, fold])))
        return ridge_tuning(slim, keys, features, target, list(grid["regParam"]), fold=fold, select=options.get("select"))
    ready = pin(indicator_columns(df.withColumns({f: F.col(f"`{f}`").cast("double") for f in features}).withColumn(target, F.col(target).cast("double")), features))
    usable, parts = _usable_features(ready, features, fold), []
    for k in sorted(usable):
        others = [j for j in sorted(usable) if j != k]
        number = F.create_map(*[F.lit(x) for pair in ((j, i) for i, j in enumerate(others)) for x in pair])
        train = ready.filter(F.col(fold) != k).withColumn("_inner", number[F.col(fold)].cast("int"))
        pipe = pipeline(usable[k], target, model, **options)
        last = pipe.getStages()[-1]
        builder = ParamGridBuilder()
        for name, values in grid.items():
            builder = builder.addGrid(last.getParam(name), list(values))
        grids = builder.build()
        evaluator = RegressionEvaluator(labelCol=target, metricName="r2")
        search = CrossValidator(estimator=pipe, estimatorParamMaps=grids, evaluator=evaluator, numFolds=len(others), foldCol="_inner").fit(train)
        best = grids[max(range(len(grids)), key=lambda i: search.avgMetrics[i])]
        chosen = ", ".join(f"{p.name}={v}" for p, v in sorted(best.items(), key=lambda x: x[0].name))
        held = search.bestModel.transform(ready.filter(F.col(fold) == k))
        parts.append(held.select(*keys, F.col(fold).alias("fold"), F.lit(chosen).alias("params"), F.col(target).alias("actual"), F.col("prediction").alias("predicted")))
    return reduce(DataFrame.unionByName, parts)


def benchmark_runs(df: DataFrame, keys: Sequence[str], feature_sets: Mapping[str, Sequence[str]], target: str, candidates: Mapping[str, tuple[Estimator, dict]], *, fold: str = "fold") -> DataFrame:
    """One row per candidate and feature set: pooled metrics, fold range, seconds, status; failures are recorded."""
    rows, df = [], pin(df)
    for set_name, features in feature_sets.items():
        for name, candidate in candidates.items():
            start = time.monotonic()
            base = {"feature_set": set_name, "model": name, "status": "ok", "error": "", "r2": None, "rmse": None, "mae": None, "fold_r2_min": None, "fold_r2_max": None}
            try:
                ledger = pin(oof_ledger(df, keys, features, target, {name: candidate}, fold=fold))  # read twice below
                pooled = regression_metrics(ledger).first()
                spread = regression_metrics(ledger, ["fold"]).agg(F.min("r2").alias("lo"), F.max("r2").alias("hi")).first()
                base.update(r2=pooled["r2"], rmse=pooled["rmse"], mae=pooled["mae"], fold_r2_min=spread["lo"], fold_r2_max=spread["hi"])
            except (ValueError, IllegalArgumentException, AnalysisException) as problem:  # a candidate that doesn't fit the data; everything else is a fault
                base.update(status="failed", error=str(problem))
            rows.append({**base, "seconds": time.monotonic() - start})
    schema = "feature_set string, model string, status string, error string, r2 double, rmse double, mae double, fold_r2_min double, fold_r2_max double, seconds double"
    return df.sparkSession.createDataFrame(rows, schema)


def spatial_metrology(points: DataFrame, keys: Sequence[str], process: Sequence[str], coordinates: Sequence[str], targets: Sequence[str], candidates: Mapping[str, tuple[Estimator, dict]], fold: str = "fold") -> DataFrame:
    """Benchmark of three feature sets for every target."""
    sets = {"process": process, "coordinate": coordinates, "process_and_coordinate": [*process, *coordinates]}
    parts = [benchmark_runs(points, keys, sets, t, candidates, fold=fold).withColumn("target", F.lit(t)) for t in targets]
    return reduce(DataFrame.unionByName, parts)


def chronological_benchmark(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, candidates: Mapping[str, tuple[Estimator, dict]], *, campaign: str = "campaign", fold: str = "fold", last: int = 4) -> DataFrame:
    """Select on development folds, predict the last campaigns once, add a mean baseline; ledger with split label."""
    marked = pin(chronological_holdout(df, campaign, last))
    dev, hold = marked.filter("split = 'development'"), marked.filter("split = 'holdout'")
    ledger = oof_ledger(dev, keys, features, target, candidates, fold=fold)
    best = regression_metrics(ledger, ["model"]).orderBy(F.desc("r2"), "model").first()["model"]
    model, options = candidates[best]
    prep = lambda d: indicator_columns(d.withColumns({**{f: F.col(f).cast("double") for f in features}, target: F.col(target).cast("double")}), features)
    fitted = pipeline(observed_features(dev, features), target, model, **options).fit(prep(dev))
    final = fitted.transform(prep(hold)).select(*keys, F.lit(-1).alias("fold"), F.lit(best).alias("model"), F.col(target).alias("actual"), F.col("prediction").alias("predicted"))
    mean = dev.agg(F.avg(target).alias("predicted"))
    base = hold.crossJoin(F.broadcast(mean)).select(*keys, F.lit(-1).alias("fold"), F.lit("mean").alias("model"), F.col(target).cast("double").alias("actual"), "predicted")  # one row
    return ledger.withColumn("split", F.lit("development")).unionByName(final.unionByName(base).withColumn("split", F.lit("holdout")))


def fold_class_means(df: DataFrame, *, response: str, bad: str, fold: str = "fold") -> DataFrame:
    """(fold, good_mean, bad_mean) of the rows outside each fold."""
    own = df.groupBy(fold).agg(
        F.sum(F.when(F.col(bad) == 0, F.col(response))).alias("_gs"), F.count_if(F.col(bad) == 0).alias("_gn"),
        F.sum(F.when(F.col(bad) == 1, F.col(response))).alias("_bs"), F.count_if(F.col(bad) == 1).alias("_bn"),
    )
    total = own.agg(*[F.sum(c).alias("_t" + c) for c in ("_gs", "_gn", "_bs", "_bn")])
    outside = lambda s, n: (F.col("_t" + s) - F.coalesce(s, F.lit(0.0))) / F.nullif(F.col("_t" + n) - F.col(n), F.lit(0))
    return own.crossJoin(total).select(fold, outside("_gs", "_gn").alias("good_mean"), outside("_bs", "_bn").alias("bad_mean"))


def hurdle(df: DataFrame, probability: Column, good_mean: Column, bad_mean: Column, scale: float = 1.0, name: str = "hurdle") -> DataFrame:
    """Good mean plus the scaled risk times the distance between the class means."""
    return df.withColumn(name, good_mean + clip(scale * probability, 0.0, 1.0) * (bad_mean - good_mean))


def blend(df: DataFrame, a: Column, b: Column, weight: float, name: str = "blend") -> DataFrame:
    return df.withColumn(name, weight * a + (1 - weight) * b)


def blend_grid(df: DataFrame, weights: Sequence[float], *, a: str, b: str, actual: str = "actual") -> DataFrame:
    """Regression metrics of every blend weight in one pass."""
    grid = df.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    mixed = grid.withColumn("_p", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))
    return regression_metrics(mixed, ["weight"], actual=actual, predicted="_p")


def meta_features(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Row mean, population std, min and max over base-model scores."""
    cols = [F.col(s) for s in scores]
    mean = reduce(lambda a, b: a + b, cols) / len(cols)
    var = reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / len(cols)
    low, high = (F.least(*cols), F.greatest(*cols)) if len(cols) > 1 else (cols[0], cols[0])
    return df.withColumns({"meta_mean": mean, "meta_std": F.sqrt(var), "meta_min": low, "meta_max": high})


def calibrator(scores: DataFrame, score: str = "predicted", actual: str = "actual"):
    """A logistic model of the outcome on one score; use with ``calibrated``."""
    return LogisticRegression(featuresCol="_score", labelCol=actual, probabilityCol="_calibrated", rawPredictionCol="_raw", predictionCol="_class").fit(
        VectorAssembler(inputCols=[score], outputCol="_score").transform(scores)
    )


def calibrated(scores: DataFrame, model, score: str = "predicted") -> DataFrame:
    """``scores`` with ``score`` replaced by its calibrated probability."""
    out = model.transform(VectorAssembler(inputCols=[score], outputCol="_score").transform(scores))
    return out.withColumn(score, vector_to_array("_calibrated")[1]).drop("_score", "_calibrated", "_raw", "_class")


def stacking(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, candidates: Mapping[str, tuple[Estimator, dict]], *, fold: str = "fold") -> DataFrame:
    """(keys, fold, actual, predicted, model): a logistic meta model on calibrated base scores, fitted apart for each outer fold.

    For outer fold k the base models are cross-fitted over the other folds, one calibrator per base model is fitted to
    those scores, and so is the meta model. The base models are then refitted on all other folds and score fold k,
    whose labels are never read.
    """
    ready = pin(df.select(*dict.fromkeys([*keys, *features, target, fold])).withColumn(target, F.col(target).cast("double")))
    names = list(candidates)
    inputs = [*names, "meta_mean", "meta_std", "meta_min", "meta_max"]
    prepared = indicator_columns(ready.withColumns({f: F.col(f"`{f}`").cast("double") for f in features}), features)
    usable = _usable_features(ready, features, fold)

    def wide(ledger: DataFrame, scale: Mapping) -> DataFrame:
        parts = [calibrated(ledger.filter(F.col("model") == n), scale[n]).select(*keys, "fold", "actual", F.lit(n).alias("model"), "predicted") for n in names]
        table = reduce(DataFrame.unionByName, parts).groupBy(*keys, "fold", "actual").pivot("model", names).agg(F.first("predicted"))
        return VectorAssembler(inputCols=inputs, outputCol="_meta").transform(meta_features(table, names))

    parts = []
    for k in sorted(usable):
        inner = pin(oof_ledger(ready.filter(F.col(fold) != k), keys, features, target, candidates, fold=fold, classify=True))
        scale = {n: calibrator(inner.filter(F.col("model") == n)) for n in names}
        meta = LogisticRegression(featuresCol="_meta", labelCol="actual", regParam=0.01, probabilityCol="_probability", rawPredictionCol="_raw_prediction").fit(wide(inner, scale))
        held = []
        for n in names:
            model, options = candidates[n]
            fitted = pipeline(usable[k], target, model, **options).fit(prepared.filter(F.col(fold) != k))
            scored = fitted.transform(prepared.filter(F.col(fold) == k))
            held.append(scored.select(*keys, F.col(fold).alias("fold"), F.lit(n).alias("model"), F.col(target).alias("actual"), vector_to_array("_probability")[1].alias("predicted")))
        final = meta.transform(wide(reduce(DataFrame.unionByName, held), scale))
        parts.append(final.select(*keys, "fold", "actual", vector_to_array("_probability")[1].alias("predicted")))
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit("stacked"))


def lot_severity(train: DataFrame, validation: DataFrame, *, lot: str = "lot", response: str = "response", bad: str = "bad", context: Sequence[str] = ("p_mean", "p_std", "p_min", "p_max", "p_q25", "p_q75")) -> DataFrame:
    """A lot's bad-wafer mean regressed on its probability context, clipped to [0.75, 2.1]."""
    lots = lambda df: df.groupBy(lot).agg(*[F.max(c).alias(c) for c in context])  # noqa: E731 - constant within a lot
    severity = train.filter(F.col(bad) == 1).groupBy(lot).agg(F.avg(response).alias("severity"))
    stages = [VectorAssembler(inputCols=list(context), outputCol="_c"), StandardScaler(withMean=True, inputCol="_c", outputCol="_z")]
    model = Pipeline(stages=[*stages, LinearRegression(featuresCol="_z", labelCol="severity", regParam=0.1)]).fit(lots(train).join(severity, lot))
    return model.transform(lots(validation)).select(lot, clip(F.col("prediction"), 0.75, 2.1).alias("severity"))


def cleaning_ablation(variants: Mapping[str, DataFrame], keys: Sequence[str], features: Mapping[str, Sequence[str]], target: str, candidate: tuple[Estimator, dict], fold: str = "fold") -> DataFrame:
    """The same folds and model over differently cleaned feature tables."""
    parts = []
    for name, table in variants.items():
        ledger = oof_ledger(table, keys, features[name], target, {"model": candidate}, fold=fold)
        parts.append(regression_metrics(ledger).withColumn("variant", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def oof_classification_scores(ledger: DataFrame) -> DataFrame:
    return ranking_scores(ledger, ["model"], actual="actual", score="predicted")


