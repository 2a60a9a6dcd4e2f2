"""Lot context, ranking, metric and threshold queries on scored customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SCORED, query, r, scored
from yieldloom.operators import folds, importance, metrics, models, ranking


@query("group_transform", f"""WITH {SCORED}, m AS (SELECT *, avg(response) OVER w AS m, coalesce(stddev_samp(response) OVER w, 0) AS s FROM scored WINDOW w AS (PARTITION BY lot))
SELECT wafer, {r('m', 'lot_mean__response')}, {r('s', 'lot_std__response')}, {r('response - m', 'lot_delta__response')}, {r('CASE WHEN s > 1e-12 THEN (response - m) / s ELSE 0 END', 'lot_z__response')} FROM m""")
def group_transform(spark, folder):
    return ranking.group_transform(scored(spark, folder), ["response"]).drop("lot", "response", "probability", "actual_bad", "fold")


@query("probability_context", f"""WITH {SCORED}, m AS (SELECT lot, avg(probability) AS m, coalesce(stddev_samp(probability), 0) AS s, min(probability) AS lo, max(probability) AS hi, quantile_cont(probability, 0.25) AS a, quantile_cont(probability, 0.75) AS b FROM scored GROUP BY lot)
SELECT wafer, {r('m', 'p_mean')}, {r('s', 'p_std')}, {r('lo', 'p_min')}, {r('hi', 'p_max')}, {r('a', 'p_q25')}, {r('b', 'p_q75')} FROM scored JOIN m USING (lot)""")
def probability_context(spark, folder):
    return ranking.probability_context(scored(spark, folder)).select("wafer", "p_mean", "p_std", "p_min", "p_max", "p_q25", "p_q75")


def _pct(c: str) -> str:
    return f"(rank() OVER (PARTITION BY lot ORDER BY {c}) + (count(*) OVER (PARTITION BY lot, {c}) - 1) / 2) / count(*) OVER (PARTITION BY lot)"


@query("percent_rank_avg", f"WITH {SCORED}, k AS (SELECT wafer, {_pct('probability')} AS a, {_pct('response')} AS b FROM scored) SELECT wafer, {r('(a + b) / 2', 'rank_average')} FROM k")
def percent_rank_avg(spark, folder):
    return ranking.percent_rank_avg(scored(spark, folder), ["probability", "response"]).select("wafer", "rank_average")


TOPN = f"{SCORED}, sel AS (SELECT *, CAST(row_number() OVER (PARTITION BY lot ORDER BY probability DESC, wafer) <= sum(actual_bad) OVER (PARTITION BY lot) AS INTEGER) AS selected FROM scored)"


@query("top_n_per_group_dynamic", f"WITH {TOPN} SELECT wafer, selected FROM sel")
def top_n_per_group_dynamic(spark, folder):
    return ranking.top_n_per_group_dynamic(scored(spark, folder), tie=["wafer"]).select("wafer", "selected")


CLASS_MEANS = "cm AS (SELECT f.fold, a.actual_bad AS c, avg(a.response) AS m FROM (SELECT DISTINCT fold FROM scored) f JOIN scored a ON a.fold <> f.fold GROUP BY ALL)"


@query("class_mean_prediction", f"WITH {SCORED}, {CLASS_MEANS} SELECT wafer, {r('m', 'class_mean')} FROM scored s LEFT JOIN cm ON cm.fold = s.fold AND c = CAST(probability >= 0.5 AS INTEGER)")
def class_mean_prediction(spark, folder):
    rows = scored(spark, folder).withColumn("predicted_bad", (F.col("probability") >= 0.5).cast("int"))
    return ranking.class_mean_prediction(rows).select("wafer", "class_mean")


AUC = "(SELECT sum(rk) - n1 * (n1 + 1) / 2 FROM (SELECT rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS rk, actual_bad FROM scored) WHERE actual_bad = 1) / (n1 * n0)"
AP = "(SELECT sum(b * tp / al) FROM (SELECT b, sum(b) OVER w AS tp, sum(n) OVER w AS al FROM (SELECT probability, sum(actual_bad) AS b, count(*) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))) / n1"
CNT = "cnt AS (SELECT sum(actual_bad) AS n1, count(*) - sum(actual_bad) AS n0 FROM scored)"


@query("oracle_count_report", f"""WITH {TOPN}, {CNT}, {CLASS_MEANS}, pr AS (SELECT response, m FROM sel LEFT JOIN cm ON cm.fold = sel.fold AND c = selected)
SELECT count(*) AS rows, count(DISTINCT lot) AS lots, CAST(sum(actual_bad) AS BIGINT) AS bad_wafers, count(*) FILTER (selected = 1 AND actual_bad = 1) AS true_positives, count(*) FILTER (selected <> actual_bad) AS class_mistakes,
 {r('count(*) FILTER (selected = 1 AND actual_bad = 1) / sum(selected)', 'precision')}, {r('count(*) FILTER (selected = 1 AND actual_bad = 1) / sum(actual_bad)', 'recall')}, CAST(0 AS BIGINT) AS missing_scores,
 (SELECT {r(AUC, 'x').split(' AS x')[0]} FROM cnt) AS roc_auc, (SELECT {r(AP, 'x').split(' AS x')[0]} FROM cnt) AS pr_auc, (SELECT {r('1 - sum((response - m) ** 2) / (var_pop(response) * count(*))', 'x').split(' AS x')[0]} FROM pr) AS oracle_count_class_mean_r2 FROM sel""")
def oracle_count_report(spark, folder):
    return ranking.oracle_count_report(scored(spark, folder), tie=["wafer"])


@query("roc_auc", f"WITH {SCORED}, {CNT} SELECT {r(AUC, 'roc_auc')} FROM cnt")
def roc_auc(spark, folder):
    return metrics.roc_auc(scored(spark, folder))


@query("pr_auc", f"WITH {SCORED}, {CNT} SELECT {r(AP, 'pr_auc')} FROM cnt")
def pr_auc(spark, folder):
    return metrics.pr_auc(scored(spark, folder))


@query("recall_guardrail", f"""WITH {SCORED}, t AS (SELECT DISTINCT probability AS t FROM scored UNION SELECT i / 100.0 FROM range(1, 100) AS g(i)), e AS (SELECT t, count(*) FILTER (probability >= t AND actual_bad = 1) AS tp, count(*) FILTER (probability >= t) AS al, sum(actual_bad) AS n1 FROM t, scored GROUP BY t),
q AS (SELECT t, CASE WHEN al > 0 THEN tp / al ELSE 0 END AS p, tp / n1 AS rc FROM e) SELECT {r('t', 'threshold')}, {r('p', 'precision')}, {r('rc', 'recall')} FROM q WHERE rc >= 0.8 ORDER BY p DESC, t DESC LIMIT 1""")
def recall_guardrail(spark, folder):
    return metrics.recall_guardrail(scored(spark, folder))


RATES = f"""{r('tp / nullif(tp + fn, 0)', 'recall')}, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('fn / nullif(tp + fn, 0)', 'false_negative_rate')}, {r('tn / nullif(tn + fp, 0)', 'specificity')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')}, {r('(tp * tn - fp * fn) / sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc')},
 {r('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}"""


@query("classification_metrics", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (actual_bad = 1 AND probability >= 0.5) AS tp, count(*) FILTER (actual_bad = 0 AND probability >= 0.5) AS fp, count(*) FILTER (actual_bad = 1 AND probability < 0.5) AS fn, count(*) FILTER (actual_bad = 0 AND probability < 0.5) AS tn, avg((probability - actual_bad) ** 2) AS b FROM scored)
SELECT tp, fp, fn, tn, {r('b', 'brier')}, {RATES} FROM c""")
def classification_metrics(spark, folder):
    return metrics.classification_metrics(scored(spark, folder))


@query("response_then_classify", f"""WITH {SCORED}, p AS (SELECT response AS a, 200 + 100 * probability AS p FROM scored), c AS (SELECT count(*) FILTER (a > 250 AND p > 250) AS tp, count(*) FILTER (a <= 250 AND p > 250) AS fp, count(*) FILTER (a > 250 AND p <= 250) AS fn, count(*) FILTER (a <= 250 AND p <= 250) AS tn FROM p) SELECT tp, fp, fn, tn, {RATES} FROM c""")
def response_then_classify(spark, folder):
    rows = scored(spark, folder).select(F.col("response").alias("actual"), (200 + 100 * F.col("probability")).alias("predicted"))
    return metrics.response_then_classify(rows, 250.0)


REG = f"count(*) AS rows, {r('avg(abs(a - p))', 'mae')}, {r('sqrt(avg((a - p) ** 2))', 'rmse')}, {r('1 - sum((a - p) ** 2) / (var_pop(a) * count(*))', 'r2')}"


@query("regression_metrics", f"WITH {SCORED}, p AS (SELECT lot, response AS a, 200 + 100 * probability AS p FROM scored) SELECT lot, {REG} FROM p GROUP BY lot")
def regression_metrics(spark, folder):
    rows = scored(spark, folder).select("lot", F.col("response").alias("actual"), (200 + 100 * F.col("probability")).alias("predicted"))
    return metrics.regression_metrics(rows, ["lot"])


@query("conditional_diagnostics", f"WITH {SCORED}, p AS (SELECT CASE WHEN actual_bad = 1 THEN 'bad' ELSE 'good' END AS subset, response AS a, 200 + 100 * probability AS p FROM scored) SELECT subset, {REG} FROM p GROUP BY subset")
def conditional_diagnostics(spark, folder):
    rows = scored(spark, folder).select("actual_bad", F.col("response").alias("actual"), (200 + 100 * F.col("probability")).alias("predicted"))
    return metrics.conditional_diagnostics(rows)


@query("multi_output_r2", f"""WITH {SCORED}, p AS (SELECT lot AS t, response AS a, 200 + 100 * probability AS p FROM scored UNION ALL SELECT -1, 5.0, 4.0 FROM scored), g AS (SELECT t, sum((a - p) ** 2) AS e, var_pop(a) * count(*) AS s, var_pop(a) AS v, avg(abs(a - p)) AS mae, avg((a - p) ** 2) AS mse FROM p GROUP BY t)
SELECT count(*) FILTER (v > 1e-6) AS scored_targets, {r('avg(mae)', 'mae')}, {r('sqrt(avg(mse))', 'rmse')}, {r('1 - sum(e) FILTER (v > 1e-6) / sum(s) FILTER (v > 1e-6)', 'r2')} FROM g""")
def multi_output_r2(spark, folder):
    rows = scored(spark, folder).select(F.col("lot").alias("target"), F.col("response").alias("actual"), (200 + 100 * F.col("probability")).alias("predicted"))
    flat = scored(spark, folder).select(F.lit(-1).alias("target"), F.lit(5.0).alias("actual"), F.lit(4.0).alias("predicted"))
    return metrics.multi_output_r2(rows.unionByName(flat))


@query("champion", f"WITH {SCORED}, p AS (SELECT lot AS model, response AS a, 200 + 100 * probability AS p FROM scored), m AS (SELECT model, {REG} FROM p GROUP BY model) SELECT model, rows, mae, rmse, r2 FROM m ORDER BY r2 DESC, model LIMIT 1")
def champion(spark, folder):
    rows = scored(spark, folder).select(F.col("lot").alias("model"), F.col("response").alias("actual"), (200 + 100 * F.col("probability")).alias("predicted"))
    return metrics.champion(metrics.regression_metrics(rows, ["model"]))


@query("quality_gate", f"WITH {SCORED}, m AS (SELECT lot AS model, avg(probability) AS s FROM scored GROUP BY lot) SELECT model, {r('s', 'holdout_r2')} FROM m WHERE s > 0.5")
def quality_gate(spark, folder):
    rows = scored(spark, folder).groupBy(F.col("lot").alias("model")).agg(F.avg("probability").alias("holdout_r2"))
    return metrics.quality_gate(rows, 0.5)


# --- folds and ledgers without a model ---------------------------------------------
def _deal(order: str) -> str:
    return f"""WITH {SCORED}, z AS (SELECT lot, row_number() OVER (ORDER BY {order}, lot) - 1 AS p FROM scored GROUP BY lot)
SELECT lot, CAST(CASE WHEN p // 5 % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM z"""


@query("group_kfold", _deal("count(*) DESC"))
def group_kfold(spark, folder):
    return folds.group_kfold(scored(spark, folder).drop("fold")).select("lot", "fold").distinct()


@query("stratified_group_kfold", _deal("sum(actual_bad) DESC, count(*) DESC"))
def stratified_group_kfold(spark, folder):
    return folds.stratified_group_kfold(scored(spark, folder).drop("fold"), "actual_bad").select("lot", "fold").distinct()


@query("group_shuffle_split", f"""WITH {SCORED}, g AS (SELECT DISTINCT lot FROM scored)
SELECT lot, row_number() OVER (ORDER BY md5('42|' || lot), lot) <= ceil(count(*) OVER () * 0.2) AS is_test FROM g""")
def group_shuffle_split(spark, folder):
    return folds.group_shuffle_split(scored(spark, folder)).select("lot", "is_test").distinct()


@query("random_split_diagnostic", f"""WITH {SCORED}
SELECT CAST(CAST('0x' || substr(md5('42|' || lot || '|' || wafer), 1, 15) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS rows FROM scored GROUP BY 1""")
def random_split_diagnostic(spark, folder):
    return folds.random_split_diagnostic(scored(spark, folder).drop("fold"), ["lot", "wafer"]).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query("mean_baseline", f"WITH {SCORED}, o AS (SELECT f.fold, avg(a.response) AS p FROM (SELECT DISTINCT fold FROM scored) f JOIN scored a ON a.fold <> f.fold GROUP BY f.fold) SELECT wafer, fold, 'mean' AS model, {r('response', 'actual')}, {r('p', 'predicted')} FROM scored JOIN o USING (fold)")
def mean_baseline(spark, folder):
    return models.mean_baseline_ledger(scored(spark, folder), ["wafer"], "response")


HURDLE = f"{SCORED}, cm AS (SELECT f.fold, avg(a.response) FILTER (a.actual_bad = 0) AS g, avg(a.response) FILTER (a.actual_bad = 1) AS b FROM (SELECT DISTINCT fold FROM scored) f JOIN scored a ON a.fold <> f.fold GROUP BY f.fold), hu AS (SELECT wafer, response, g + least(greatest(0.75 * probability, 0), 1) * (b - g) AS h, 200 + 100 * probability AS base FROM scored JOIN cm USING (fold))"


def _hurdle(spark, folder):
    rows = scored(spark, folder)
    means = models.fold_class_means(rows, response="response", bad="actual_bad")
    joined = rows.join(means, "fold")
    out = models.hurdle(joined, F.col("probability"), F.col("good_mean"), F.col("bad_mean"), 0.75)
    return out.withColumn("base", 200 + 100 * F.col("probability"))


@query("hurdle", f"WITH {HURDLE} SELECT wafer, {r('h', 'hurdle')} FROM hu")
def hurdle(spark, folder):
    return _hurdle(spark, folder).select("wafer", "hurdle")


@query("blend", f"WITH {HURDLE} SELECT wafer, {r('0.7 * h + 0.3 * base', 'blend')} FROM hu")
def blend(spark, folder):
    return models.blend(_hurdle(spark, folder), F.col("hurdle"), F.col("base"), 0.7).select("wafer", "blend")


@query("blend_grid", f"WITH {HURDLE}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight), p AS (SELECT weight, response AS a, weight * h + (1 - weight) * base AS p FROM hu, w) SELECT weight, {REG} FROM p GROUP BY weight")
def blend_grid(spark, folder):
    return models.blend_grid(_hurdle(spark, folder), [0, 0.25, 0.5, 0.75, 1], a="hurdle", b="base", actual="response")


@query("meta_features", f"WITH {SCORED}, m AS (SELECT wafer, probability AS a, response / 1000 AS b FROM scored) SELECT wafer, {r('(a + b) / 2', 'meta_mean')}, {r('abs(a - b) / 2', 'meta_std')}, {r('least(a, b)', 'meta_min')}, {r('greatest(a, b)', 'meta_max')} FROM m")
def meta_features(spark, folder):
    rows = scored(spark, folder).select("wafer", F.col("probability").alias("a"), (F.col("response") / 1000).alias("b"))
    return models.meta_features(rows, ["a", "b"]).drop("a", "b")


@query("f_score_importance", f"""WITH {SCORED}, l AS (SELECT actual_bad AS bad, unnest(['p', 'f']) AS feature, unnest([probability, CAST(fold AS DOUBLE)]) AS value FROM scored), g AS (SELECT feature, bad, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL), t AS (SELECT feature, avg(value) AS gm FROM l GROUP BY feature),
s AS (SELECT feature, sum(n * (m - gm) ** 2) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g JOIN t USING (feature) GROUP BY feature) SELECT feature, {r('f', 'f_score')}, {r('f / (SELECT sum(f) FROM s)', 'importance')} FROM s""")
def f_score_importance(spark, folder):
    wide = scored(spark, folder).select(F.col("actual_bad").alias("bad"), F.col("probability").alias("p"), F.col("fold").cast("double").alias("f"))
    return importance.f_score_importance(wide.unpivot(["bad"], ["p", "f"], "feature", "value"))


@query("hurdle_forest_relevance", f"WITH {SCORED}, a AS (SELECT CAST(lot AS VARCHAR) AS feature, avg(probability) AS i FROM scored GROUP BY lot), b AS (SELECT CAST(lot AS VARCHAR) AS feature, avg(fold) AS i FROM scored WHERE lot % 2 = 0 GROUP BY lot), u AS (SELECT feature, 0.7 * i AS i FROM a UNION ALL SELECT feature, 0.3 * i FROM b) SELECT feature, {r('sum(i)', 'importance')} FROM u GROUP BY feature")
def hurdle_forest_relevance(spark, folder):
    rows = scored(spark, folder)
    side = lambda df, c: df.groupBy(F.col("lot").cast("string").alias("feature")).agg(F.avg(c).alias("importance"))
    return importance.hurdle_forest_relevance(side(rows, "probability"), side(rows.filter("lot % 2 = 0"), "fold"))


@query("group_confusion", f"WITH {SCORED} SELECT lot, count(*) FILTER (actual_bad = 1 AND probability >= 0.5) AS tp, count(*) FILTER (actual_bad = 0 AND probability >= 0.5) AS fp, count(*) FILTER (actual_bad = 1 AND probability < 0.5) AS fn, count(*) FILTER (actual_bad = 0 AND probability < 0.5) AS tn FROM scored GROUP BY lot")
def group_confusion(spark, folder):
    return importance.group_confusion(scored(spark, folder).withColumn("predicted_bad", (F.col("probability") >= 0.5).cast("int")))


RESAMPLED = """WITH {scored}, c AS (SELECT lot, {counts} FROM scored GROUP BY lot), g AS (SELECT *, row_number() OVER (ORDER BY lot) AS pos FROM c),
i AS (SELECT n, unnest(range(0, 2000 * n)) AS i FROM (SELECT count(*) AS n FROM g)), p AS (SELECT i // n AS draw, CAST('0x' || substr(md5('42|' || i), 1, 15) AS BIGINT) % n + 1 AS pos FROM i),
d AS (SELECT draw, {sums} FROM p JOIN g USING (pos) GROUP BY draw),
m AS (SELECT {diffs} FROM d), l AS (SELECT 'accuracy' AS metric, accuracy AS d FROM m UNION ALL SELECT 'f1', f1 FROM m)
SELECT metric, count(*) AS draws, {low}, {high} FROM l GROUP BY metric"""


def _resampled() -> str:
    cells = {"tp": "actual_bad = 1 AND probability >= {}", "fp": "actual_bad = 0 AND probability >= {}", "fn": "actual_bad = 1 AND probability < {}", "tn": "actual_bad = 0 AND probability < {}"}
    counts = ", ".join(f"count(*) FILTER ({c.format(t)}) AS {s}{n}" for s, t in (("b_", 0.5), ("a_", 0.3)) for n, c in cells.items())
    sums = ", ".join(f"sum({s}{n})::DOUBLE AS {s}{n}" for s in ("b_", "a_") for n in cells)
    accuracy = lambda s: f"({s}tp + {s}tn) / ({s}tp + {s}fp + {s}fn + {s}tn)"
    f1 = lambda s: f"coalesce(2 * {s}tp / nullif(2 * {s}tp + {s}fp + {s}fn, 0), 0)"
    diffs = f"{accuracy('a_')} - {accuracy('b_')} AS accuracy, {f1('a_')} - {f1('b_')} AS f1"
    return RESAMPLED.format(scored=SCORED, counts=counts, sums=sums, diffs=diffs, low=r("quantile_cont(d, 0.025)", "ci_low"), high=r("quantile_cont(d, 0.975)", "ci_high"))


@query("bootstrap_ci", _resampled())
def bootstrap_ci(spark, folder):
    rows = scored(spark, folder)
    at = lambda t: importance.group_confusion(rows.withColumn("predicted_bad", (F.col("probability") >= t).cast("int")))
    return importance.bootstrap_ci(at(0.5), at(0.3))


@query("linear_attribution", f"""WITH {SCORED}, m AS (SELECT *, avg(probability) OVER () AS pm, avg(fold) OVER () AS fm FROM scored) SELECT wafer, unnest(['fold', 'probability']) AS feature, unnest([{r('-2 * (fold - fm)', 'x').split(' AS x')[0]}, {r('3.5 * (probability - pm)', 'x').split(' AS x')[0]}]) AS contribution, {r('1 + 3.5 * pm - 2 * fm', 'base')} FROM m""")
def linear_attribution(spark, folder):
    return importance.linear_attribution(scored(spark, folder), ["wafer"], ["probability", "fold"], [3.5, -2.0], 1.0)


def _moved(probability: str, fold: str) -> str:
    return f"1 - sum((response - 200 - 100 * {probability} - {fold}) ** 2) / (var_pop(response) * count(*))"


@query("permutation_importance", f"""WITH {SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || wafer), wafer) AS pos, count(*) OVER () AS n FROM scored),
s AS (SELECT a.response, a.probability, a.fold, b.probability AS mp, b.fold AS mf FROM p a JOIN p b ON a.pos = b.pos % b.n + 1),
i AS (SELECT {_moved('probability', 'fold')} AS whole, {_moved('mp', 'fold')} AS without_p, {_moved('probability', 'mf')} AS without_f FROM s)
SELECT 'probability' AS feature, {r('whole - without_p', 'importance')} FROM i UNION ALL SELECT 'fold', {r('whole - without_f', 'importance')} FROM i""")
def permutation_importance(spark, folder):
    rows = scored(spark, folder).withColumn("fold", F.col("fold").cast("double"))

    def score(df):
        predicted = df.withColumn("predicted", 200 + 100 * F.col("probability") + F.col("fold"))
        return metrics.regression_metrics(predicted, actual="response").first()["r2"]

    return importance.permutation_importance(rows, ["probability", "fold"], score, order=["wafer"])


@query("repeated_permutation_importance", f"""WITH {SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || wafer), wafer) AS pos, count(*) OVER () AS n FROM scored),
k AS (SELECT r, CAST('0x' || substr(md5('42|' || r), 1, 15) AS BIGINT) % ((SELECT count(*) FROM scored) - 1) + 1 AS shift FROM range(1, 6) AS t(r)),
s AS (SELECT r, a.response AS y, 200 + 100 * a.probability + a.fold AS whole, 200 + 100 * b.probability + a.fold AS mp, 200 + 100 * a.probability + b.fold AS mf FROM p a CROSS JOIN k JOIN p b ON b.pos = (a.pos + shift - 1) % a.n + 1),
d AS (SELECT r, (sum((y - mp) ** 2) - sum((y - whole) ** 2)) / (var_pop(y) * count(*)) AS probability, (sum((y - mf) ** 2) - sum((y - whole) ** 2)) / (var_pop(y) * count(*)) AS fold FROM s GROUP BY r)
SELECT feature, {r('avg(v)', 'importance_mean')}, {r('stddev_pop(v)', 'importance_std')} FROM (UNPIVOT d ON probability, fold INTO NAME feature VALUE v) GROUP BY feature""")
def repeated_permutation_importance(spark, folder):
    rows = scored(spark, folder).withColumn("fold", F.col("fold").cast("double"))
    return importance.repeated_permutation_importance(rows, ["probability", "fold"], lambda c: 200 + 100 * c["probability"] + c["fold"], "response", order=["wafer"])
