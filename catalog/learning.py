"""Model queries. Linear ones have SQL that solves the normal equations; the others are value-tested in pytest."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from catalog.base import SCORED, TRACE, query, r, scored, table, trace
from catalog.linear_sql import line, ridge
from yieldloom.functions.numeric import coordinate_columns
from yieldloom.operators import bundles, importance, metrics, models, ranking, trees
from yieldloom.session import scratch_path

FEATURES = ["probability", "p_mean", "p_std", "lot_size"]


def feature_table(spark, folder):
    """Customers with lot context as features, mean order value as response."""
    rows = scored(spark, folder)
    sizes = rows.groupBy("lot").agg(F.count(F.lit(1)).cast("double").alias("lot_size"))
    return ranking.probability_context(rows, hot_rows=None).join(sizes, "lot")


CONTEXT = ["p_mean", "p_std", "p_min", "p_max", "p_q25", "p_q75"]
FT = f"""{SCORED}, lots AS (SELECT lot, avg(probability) AS p_mean, coalesce(stddev_samp(probability), 0) AS p_std, min(probability) AS p_min, max(probability) AS p_max,
  quantile_cont(probability, 0.25) AS p_q25, quantile_cont(probability, 0.75) AS p_q75, CAST(count(*) AS DOUBLE) AS lot_size FROM scored GROUP BY lot),
ft AS (SELECT * FROM scored JOIN lots USING (lot))"""
#: Every row beside every fold: fold <> g are the training rows of g, fold = g those it predicts.
GRID = "grid AS (SELECT h.fold AS g, t.* FROM {rows} t CROSS JOIN (SELECT DISTINCT fold FROM {rows}) h)"
TRAIN = "SELECT * FROM grid WHERE fold <> g"


def _held(name: str, features: list[str], keep: str = "*", target: str = "response") -> str:
    """Held-out rows with actual a and prediction p by the lines of ``name``."""
    return f"SELECT {keep}, {target} AS a, {line(features)} AS p FROM grid JOIN {name} USING (g) WHERE fold = g"


METRICS = f"count(*) AS rows, {r('avg(abs(a - p))', 'mae')}, {r('sqrt(avg((a - p) ** 2))', 'rmse')}, {r('1 - sum((a - p) ** 2) / (var_pop(a) * count(*))', 'r2')}"


def _runs(ledgers: dict[str, str]) -> str:
    """One row per feature set from its held-out rows."""
    parts = []
    for name, ledger in ledgers.items():
        parts.append(f"""SELECT '{name}' AS feature_set, 'ridge' AS model, 'ok' AS status, '' AS error, {r('1 - sum((a - p) ** 2) / (var_pop(a) * count(*))', 'r2')}, {r('sqrt(avg((a - p) ** 2))', 'rmse')},
  {r('avg(abs(a - p))', 'mae')}, (SELECT {r('min(x)', 'x')} FROM (SELECT 1 - sum((a - p) ** 2) / (var_pop(a) * count(*)) AS x FROM ({ledger}) GROUP BY fold)) AS fold_r2_min,
  (SELECT {r('max(x)', 'x')} FROM (SELECT 1 - sum((a - p) ** 2) / (var_pop(a) * count(*)) AS x FROM ({ledger}) GROUP BY fold)) AS fold_r2_max FROM ({ledger})""")
    return " UNION ALL ".join(parts)


def _ridge():
    return {"ridge": models.regressors("quick")["ridge"]}


@query("oof_ledger", f"""WITH {FT}, {GRID.format(rows='ft')}, {ridge('m', TRAIN, FEATURES)}, h AS ({_held('m', FEATURES, 'wafer, fold')})
SELECT wafer, fold, 'ridge' AS model, {r('a', 'actual')}, {r('p', 'predicted')} FROM h""")
def oof_ledger(spark, folder):
    return models.oof_ledger(feature_table(spark, folder), ["wafer"], FEATURES, "response", _ridge())


@query("oof_ledger_forest")
def oof_ledger_forest(spark, folder):
    return models.oof_ledger(feature_table(spark, folder), ["wafer"], FEATURES, "response", {"random_forest": (RandomForestRegressor(numTrees=10, maxDepth=4, seed=42), {})})


BOOSTED = ["gappy", "lot_size", "p_std"]


@query("hist_boosting", f"""WITH {FT}, c AS (SELECT *, CASE WHEN wafer % 7 <> 0 THEN probability END AS gappy, response - avg(response) OVER () AS g, avg(response) OVER () AS base FROM ft),
f AS ({' UNION ALL '.join(f"SELECT wafer, {i} AS feature, {n} AS x, g, base FROM c" for i, n in enumerate(BOOSTED))}),
edges AS (SELECT DISTINCT feature, unnest(list_append(quantile_cont(x, [{', '.join(f'{k}/16.0' for k in range(1, 16))}]), 'infinity'::DOUBLE)) AS edge FROM f WHERE x IS NOT NULL GROUP BY feature),
tried AS (SELECT feature, edge, m, count(*) AS n, sum(g) AS t, count(*) FILTER (coalesce(x <= edge, m)) AS ln, sum(g) FILTER (coalesce(x <= edge, m)) AS lt, count(*) FILTER (x IS NULL) AS gaps
  FROM edges JOIN f USING (feature) CROSS JOIN (VALUES (false), (true)) AS s(m) GROUP BY ALL),
best AS (SELECT * FROM tried WHERE ln >= 10 AND n - ln >= 10 AND (gaps > 0 OR NOT m) ORDER BY round(lt ** 2 / ln + (t - lt) ** 2 / (n - ln) - t ** 2 / n, 3) DESC, feature, edge, m LIMIT 1)
SELECT f.wafer, {r('base + CASE WHEN coalesce(x <= edge, m) THEN lt / ln ELSE (t - lt) / (n - ln) END', 'predicted')} FROM f JOIN best USING (feature)""")
def hist_boosting(spark, folder):
    """The first tree's cut and leaves; a seventh of one feature is missing."""
    rows = feature_table(spark, folder).withColumn("gappy", F.when(F.col("wafer") % 7 != 0, F.col("probability")))
    rows = VectorAssembler(inputCols=BOOSTED, outputCol="features", handleInvalid="keep").transform(rows)
    model = trees.HistBoostingRegressor(trees=1, maxDepth=1, bins=16, rate=1.0, minLeaf=10).setLabelCol("response").fit(rows)
    return model.transform(rows).select("wafer", F.col("prediction").alias("predicted"))


@query("extra_trees")
def extra_trees(spark, folder):
    """Held-out predictions of a small forest of extremely randomised trees."""
    rows = feature_table(spark, folder).withColumn("fold", (F.col("fold") % 2).cast("int"))
    return models.oof_ledger(rows, ["wafer"], FEATURES, "response", {"extra_trees": (trees.ExtraTreesRegressor(trees=8, maxDepth=4), {})})


@query("classifier_ledger")
def classifier_ledger(spark, folder):
    logistic = {"logistic": models.classifiers("quick")["logistic"]}
    return models.oof_ledger(feature_table(spark, folder), ["wafer"], FEATURES, "actual_bad", logistic, classify=True)


@query("benchmark_runs", f"""WITH {FT}, {GRID.format(rows='ft')}, {ridge('m', TRAIN, FEATURES)}, {ridge('o', TRAIN, FEATURES[:1])}
{_runs({'context': _held('m', FEATURES, 'fold'), 'own': _held('o', FEATURES[:1], 'fold')})}""")
def benchmark_runs(spark, folder):
    sets = {"context": FEATURES, "own": ["probability"]}
    out = models.benchmark_runs(feature_table(spark, folder), ["wafer"], sets, "response", _ridge())
    return out.drop("seconds")


@query("chronological_benchmark", f"""WITH {FT}, c AS (SELECT *, CAST(floor(wafer / 20) AS INTEGER) AS campaign FROM ft), last AS (SELECT DISTINCT campaign FROM c ORDER BY 1 DESC LIMIT 3),
dev AS (SELECT * FROM c WHERE campaign NOT IN (FROM last)), {GRID.format(rows='dev')}, {ridge('m', TRAIN, FEATURES)}, {ridge('f', 'SELECT 0 AS g, * FROM dev', FEATURES)},
l AS (SELECT 'development' AS split, 'ridge' AS model, a, p FROM ({_held('m', FEATURES, 'fold')}) UNION ALL
  SELECT 'holdout', 'ridge', response, {line(FEATURES)} FROM c CROSS JOIN f WHERE campaign IN (FROM last) UNION ALL
  SELECT 'holdout', 'mean', response, (SELECT avg(response) FROM dev) FROM c WHERE campaign IN (FROM last))
SELECT split, model, {METRICS} FROM l GROUP BY split, model""")
def chronological_benchmark(spark, folder):
    rows = feature_table(spark, folder).withColumn("campaign", F.floor(F.col("wafer") / 20).cast("int"))
    ledger = models.chronological_benchmark(rows, ["wafer"], FEATURES, "response", _ridge(), last=3)
    return metrics.regression_metrics(ledger, ["split", "model"])


PLACES = ["coordinate__x", "coordinate__y", "coordinate__radius", "coordinate__radius2"]
POINTS = """xy AS (SELECT o_orderkey, o_totalprice, o_custkey % 3 AS fold, ln(o_totalprice) AS process, (o_orderkey % 200 - 100) * 1000 / 100000.0 AS coordinate__x, (o_custkey % 200 - 100) * 1000 / 100000.0 AS coordinate__y FROM orders),
points AS (SELECT *, sqrt(coordinate__x * coordinate__x + coordinate__y * coordinate__y) AS coordinate__radius, coordinate__x * coordinate__x + coordinate__y * coordinate__y AS coordinate__radius2 FROM xy)"""
SPOTS = {"process": ["process"], "coordinate": PLACES, "process_and_coordinate": ["process", *PLACES]}


@query("spatial_metrology", f"""WITH {POINTS}, {GRID.format(rows='points')}, {', '.join(ridge(f'm_{n}', TRAIN, fs, 'o_totalprice') for n, fs in SPOTS.items())},
runs AS ({_runs({n: _held(f'm_{n}', fs, 'fold', 'o_totalprice') for n, fs in SPOTS.items()})}) SELECT *, 'o_totalprice' AS target FROM runs""")
def spatial_metrology(spark, folder):
    orders = table(spark, folder, "orders").withColumn("X", (F.col("o_orderkey") % 200 - 100) * 1000).withColumn("Y", (F.col("o_custkey") % 200 - 100) * 1000)
    coords = coordinate_columns(F.col("X"), F.col("Y"))
    points = orders.withColumns(coords).withColumns({"fold": F.col("o_custkey") % 3, "process": F.log("o_totalprice"), "o_orderkey": F.col("o_orderkey")})
    out = models.spatial_metrology(points, ["o_orderkey"], ["process"], list(coords)[:4], ["o_totalprice"], _ridge())
    return out.drop("seconds")


@query("stacking")
def stacking(spark, folder):
    rows = feature_table(spark, folder)
    table = models.classifiers("quick")
    rows = rows.withColumn("fold", (F.col("fold") % 3).cast("int"))
    return models.stacking(rows, ["wafer"], FEATURES, "actual_bad", {n: table[n] for n in ("logistic", "random_forest")})


@query("lot_severity", f"""WITH {FT}, t AS (SELECT 0 AS g, lots.*, severity FROM (SELECT lot, avg(response) AS severity FROM scored WHERE fold <> 0 AND actual_bad = 1 GROUP BY lot) JOIN lots USING (lot)), {ridge('m', 'SELECT * FROM t', CONTEXT, 'severity', '0.1')}
SELECT DISTINCT lot, {r(f'least(greatest({line(CONTEXT)}, 0.75), 2.1)', 'severity')} FROM ft CROSS JOIN m WHERE fold = 0""")
def lot_severity(spark, folder):
    rows = ranking.probability_context(scored(spark, folder))
    return models.lot_severity(rows.filter("fold <> 0"), rows.filter("fold = 0"), bad="actual_bad")


NAIVE = ["probability", "p_mean", "filled", "lot_size", "missing"]


@query("cleaning_ablation", f"""WITH {FT}, n AS (SELECT * EXCLUDE (p_std), CASE WHEN lot % 3 <> 0 THEN p_std END AS gap FROM ft), clean_grid AS (SELECT h.fold AS g, t.* FROM ft t CROSS JOIN (SELECT DISTINCT fold FROM ft) h),
{ridge('m', 'SELECT * FROM clean_grid WHERE fold <> g', FEATURES)}, raw AS (SELECT h.fold AS g, t.* FROM n t CROSS JOIN (SELECT DISTINCT fold FROM n) h), middle AS (SELECT g, median(gap) AS middle FROM raw WHERE fold <> g GROUP BY g),
grid AS (SELECT raw.*, coalesce(gap, middle) AS filled, CAST(gap IS NULL AS INTEGER)::DOUBLE AS missing FROM raw JOIN middle USING (g)), {ridge('v', TRAIN, NAIVE)},
l AS (SELECT 'clean' AS variant, response AS a, {line(FEATURES)} AS p FROM clean_grid JOIN m USING (g) WHERE fold = g UNION ALL SELECT 'naive', a, p FROM ({_held('v', NAIVE, 'fold')}))
SELECT variant, {METRICS} FROM l GROUP BY variant""")
def cleaning_ablation(spark, folder):
    rows = feature_table(spark, folder)
    naive = rows.withColumn("p_std", F.when(F.col("lot") % 3 == 0, None).otherwise(F.col("p_std")))
    return models.cleaning_ablation({"clean": rows, "naive": naive}, ["wafer"], {"clean": FEATURES, "naive": FEATURES}, "response", _ridge()["ridge"])


SIGNALS = ["VALUE__mean", "VALUE__std", "sample_count", "HOUR__mean"]
CONTRACT = bundles.TraceContract(columns=("WAFER_ID", "STAGE", "TIMESTAMP", "VALUE", "HOUR"))


def stage_traces(spark, folder, new: bool):
    """Events as traces: a fifth of the users is the new batch, which lacks the HOUR signal; stages by event."""
    rows = trace(spark, folder).filter((F.col("user_id") % 5 == 0) if new else (F.col("user_id") % 5 != 0))
    stage = F.when(F.col("event_id") % 2 == 0, " a ").otherwise("B")
    hour = F.lit(None).cast("double") if new else F.floor(F.col("us") / 3_600_000_000) % 24
    return rows.select(
        F.col("user_id").alias("WAFER_ID"), stage.alias("STAGE"), (F.col("us") / 1e6).alias("TIMESTAMP"), F.col("value").alias("VALUE"),
        hour.cast("double").alias("HOUR"), F.col("event_id").alias("_source_index"),
    )


def published(spark, folder):
    """A bundle learned from the older users: three ridge penalties compete, the response is the highest value plus the count."""
    clean = bundles.validate_traces(stage_traces(spark, folder, False), CONTRACT)
    facts = bundles.Facts("", "highest", tuple(SIGNALS), "signals", CONTRACT)
    response = clean.groupBy("WAFER_ID", "STAGE").agg((4 * F.avg("VALUE") + F.count(F.lit(1)) + F.max("VALUE") / 10).alias("highest"))
    rows = bundles.batch_features(clean, facts).join(response, ["WAFER_ID", "STAGE"]).withColumn("fold", (F.col("WAFER_ID") % 5).cast("int"))
    penalties = {f"ridge_{a}": (LinearRegression(regParam=a), {"scale": True}) for a in (0.1, 1.0, 10.0)}
    root = scratch_path(spark, "bundle")
    bundles.publish_champion(rows, ["WAFER_ID", "STAGE"], SIGNALS, "highest", penalties, root, recipe="signals", contract=CONTRACT)
    return rows, bundles.load_bundle(spark, root, minimum_r2=0.5)


_ALPHAS = {"ridge_0.1": 0.1, "ridge_1.0": 1.0, "ridge_10.0": 10.0}
_SHORT = ["v_mean", "v_std", "n", "h_mean"]
CHAMPION = f"""{TRACE}, raw AS (SELECT user_id AS wafer, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS stage, value, (us // 3600000000) % 24 AS hour FROM trace),
old AS (SELECT wafer, stage, avg(value) AS v_mean, stddev_samp(value) AS v_std, CAST(count(*) AS DOUBLE) AS n, avg(hour) AS h_mean, 4 * avg(value) + count(*) + max(value) / 10 AS response, wafer % 5 AS fold
  FROM raw WHERE wafer % 5 <> 0 GROUP BY wafer, stage),
alphas AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}::DOUBLE)" for n, a in _ALPHAS.items())}) AS t(model, alpha)),
cases AS (SELECT row_number() OVER (ORDER BY model, held) AS g, * FROM alphas CROSS JOIN (SELECT DISTINCT fold AS held FROM old)),
tuned AS (SELECT cases.*, old.* FROM cases CROSS JOIN old), {ridge('t', 'SELECT * FROM tuned WHERE fold <> held', _SHORT, penalty='alpha')},
won AS (SELECT model, any_value(alpha) AS alpha, 1 - sum((response - ({line(_SHORT)})) ** 2) / (var_pop(response) * count(*)) AS r2 FROM tuned JOIN t USING (g) WHERE fold = held GROUP BY model ORDER BY r2 DESC, model LIMIT 1),
{ridge('f', 'SELECT 0 AS g, * FROM old CROSS JOIN won', _SHORT, penalty='alpha')}"""


@query("champion_refit", f"""WITH {CHAMPION} SELECT wafer AS WAFER_ID, stage AS STAGE, model, {r('r2', 'model_r2')}, {r(line(_SHORT), 'predicted')} FROM old CROSS JOIN f CROSS JOIN won""")
def champion_refit(spark, folder):
    rows, bundle = published(spark, folder)
    out = bundle.model.transform(bundles.prepared(rows, bundle.facts.features, ["WAFER_ID", "STAGE"]))
    return out.select(F.col("WAFER_ID").cast("long"), "STAGE", F.lit(bundle.facts.name).alias("model"), F.lit(bundle.facts.metrics["r2"]).alias("model_r2"), F.col("prediction").alias("predicted"))


_NEW = f"""new AS (SELECT wafer, stage, avg(value) AS v_mean, coalesce(stddev_samp(value), (SELECT median(v_std) FROM old)) AS v_std, CAST(count(*) AS DOUBLE) AS n, (SELECT median(h_mean) FROM old) AS h_mean FROM raw WHERE wafer % 5 = 0 GROUP BY wafer, stage)"""


@query("score_new_traces", f"""WITH {CHAMPION}, {_NEW} SELECT wafer AS WAFER_ID, stage AS STAGE, {r(line(_SHORT), 'predicted')}, {r('r2', 'model_r2')} FROM new CROSS JOIN f CROSS JOIN won""")
def score_new_traces(spark, folder):
    _, bundle = published(spark, folder)
    out = bundles.score_new_traces(stage_traces(spark, folder, True), bundle)
    return out.predictions.withColumn("WAFER_ID", F.col("WAFER_ID").cast("long"))


@query("score_report", f"""WITH {TRACE}, raw AS (SELECT user_id AS wafer, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS stage FROM trace WHERE user_id % 5 = 0)
SELECT count(*) AS trace_rows, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages, count(DISTINCT (wafer, stage)) AS samples, 'HOUR__mean' AS absent_features, false AS target_in_input FROM raw""")
def score_report(spark, folder):
    _, bundle = published(spark, folder)
    report = bundles.score_new_traces(stage_traces(spark, folder, True), bundle).report
    return report.withColumns({c: F.array_join(c, ",") for c in ("stages", "absent_features")})


@query("feature_importance", f"""WITH {FT}, {ridge('m', 'SELECT 0 AS g, * FROM ft', FEATURES)}, s AS (SELECT {', '.join(f'abs(x{i}) AS {f}' for i, f in enumerate(FEATURES))} FROM m_x)
SELECT feature, {r('v / sum(v) OVER ()', 'importance')}, 'absolute_standardized_coefficient' AS importance_method FROM (UNPIVOT s ON {', '.join(FEATURES)} INTO NAME feature VALUE v)""")
def feature_importance(spark, folder):
    rows = feature_table(spark, folder)
    model = models.pipeline(FEATURES, "response", LinearRegression(regParam=1.0), scale=True).fit(models.indicator_columns(rows, FEATURES))
    names = models.input_names(model, FEATURES)
    return importance.feature_importance(model.stages[-1], names, spark)


@query("nested_tuning", f"""WITH {FT}, t AS (SELECT * REPLACE (lot % 3 AS fold) FROM ft), alphas AS (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS alpha), folds AS (SELECT DISTINCT fold FROM t),
cases AS (SELECT row_number() OVER (ORDER BY k.fold, j.fold, alpha) AS g, k.fold AS k, j.fold AS j, alpha FROM folds k JOIN folds j ON k.fold <> j.fold CROSS JOIN alphas),
inner_rows AS (SELECT cases.*, t.* FROM cases JOIN t ON fold <> k AND fold <> j), {ridge('i', 'SELECT * FROM inner_rows', FEATURES, penalty='alpha')},
tried AS (SELECT k, j, alpha, 1 - sum((response - ({line(FEATURES)})) ** 2) / (var_pop(response) * count(*)) AS r2 FROM cases JOIN i USING (g) JOIN t ON fold = j GROUP BY ALL),
best AS (SELECT k AS g, alpha FROM (SELECT k, alpha, avg(r2) AS r2 FROM tried GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r2 DESC, alpha) = 1),
grid AS (SELECT best.*, t.* FROM best CROSS JOIN t), {ridge('o', TRAIN, FEATURES, penalty='alpha')}
SELECT wafer, fold, 'regParam=' || alpha AS params, {r('response', 'actual')}, {r(line(FEATURES), 'predicted')} FROM grid JOIN o USING (g) WHERE fold = g""")
def nested_tuning(spark, folder):
    rows = feature_table(spark, folder).withColumn("fold", (F.col("lot") % 3).cast("int"))
    return models.nested_tuning(rows, ["wafer"], FEATURES, "response", LinearRegression(), models.search_grids("balanced")["ridge"], scale=True)


@query("knn", f"""WITH e AS (SELECT vec_id AS row, embedding::DOUBLE[] AS v, label::DOUBLE AS y FROM embeddings), d AS (SELECT a.row, list_distance(a.v, b.v) AS d, b.y FROM e a JOIN e b ON a.row % 5 = 0 AND b.row % 5 <> 0),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, y) <= 5)
SELECT row, {r('coalesce(avg(y) FILTER (d = 0), sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)))', 'predicted')}, count(*) AS neighbours FROM k GROUP BY row""")
def knn(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("double").alias("target"))
    return importance.knn(e.filter("row % 5 <> 0"), e.filter("row % 5 = 0"))


# --- preprocessing steps ---------------------------------------------------------------
@query("median_impute", f"""WITH {SCORED}, g AS (SELECT wafer, CASE WHEN lot % 3 <> 0 THEN probability END AS a, response AS b FROM scored)
SELECT wafer, {r('coalesce(a, (SELECT median(a) FROM g))', 'a__filled')}, {r('b', 'b__filled')} FROM g""")
def median_impute(spark, folder):
    rows = scored(spark, folder).select("wafer", F.when(F.col("lot") % 3 != 0, F.col("probability")).alias("a"), F.col("response").alias("b"))
    return models.median_impute(["a", "b"]).fit(rows).transform(rows).select("wafer", "a__filled", "b__filled")


def _fitted(spark, folder, features, **options):
    rows = scored(spark, folder).withColumns({f: F.col(f).cast("double") for f in features})
    rows = models.indicator_columns(rows, features)
    *stages, last = models.preprocessing(features, "response", **options)
    return Pipeline(stages=stages).fit(rows), rows, last


@query("standardize", f"WITH {SCORED} SELECT wafer, {r('(probability - avg(probability) OVER ()) / stddev_samp(probability) OVER ()', 'scaled')} FROM scored")
def standardize(spark, folder):
    model, rows, last = _fitted(spark, folder, ["probability"], scale=True)
    return model.transform(rows).select("wafer", vector_to_array(last)[0].alias("scaled"))


@query("select_k_best", f"""WITH {SCORED}, c AS (SELECT abs(corr(probability, response)) AS probability, abs(corr(fold, response)) AS fold, abs(corr(lot, response)) AS lot FROM scored)
SELECT feature FROM (UNPIVOT c ON probability, fold, lot INTO NAME feature VALUE v) ORDER BY v DESC LIMIT 2""")
def select_k_best(spark, folder):
    features = ["probability", "fold", "lot"]
    model, _, _ = _fitted(spark, folder, features, select=2)
    return spark.createDataFrame([(n,) for n in models.input_names(model, features)], "feature string")


@query("pca", f"""WITH {SCORED}, c AS (SELECT abs(corr(probability, lot)) AS r FROM scored)
SELECT CAST(1 AS INTEGER) AS component, {r('(1 + r) / 2', 'explained')} FROM c UNION ALL SELECT 2, {r('(1 - r) / 2', 'explained')} FROM c""")
def pca(spark, folder):
    model, _, _ = _fitted(spark, folder, ["probability", "lot"], scale=True, components=2)
    shares = model.stages[-1].explainedVariance.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(shares, 1)], "component int, explained double")
