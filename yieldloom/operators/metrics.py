"""Regression, classification and ranking metrics as aggregates; thresholds under a recall guardrail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.plans import running_totals


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(0.0)


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), *, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """rows, mae, rmse and r2 per key; r2 is NULL when the actual values do not vary."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.when(F.col("_sst") > 0, F.col("_sst")))
    return sums.withColumn("r2", r2).drop("_sse", "_sst")


def multi_output_r2(df: DataFrame, target: str = "target", *, actual: str = "actual", predicted: str = "predicted", floor: float = 1e-6) -> DataFrame:
    """Variance-weighted r2 over targets, those with nearly constant actual values left out."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    per = df.groupBy(target).agg(F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"), F.var_pop(y).alias("_var"), F.avg(F.abs(e)).alias("_mae"), F.avg(e * e).alias("_mse"))
    ok = F.col("_var") > floor
    sse, sst = F.sum(F.when(ok, F.col("_sse"))), F.sum(F.when(ok, F.col("_sst")))
    return per.agg(
        F.count_if(ok).alias("scored_targets"), F.avg("_mae").alias("mae"), F.sqrt(F.avg("_mse")).alias("rmse"),
        F.coalesce(F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)), F.lit(0.0)).alias("r2"),
    )


def classification_metrics(df: DataFrame, keys: Sequence[str] = (), *, actual: str = "actual_bad", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Confusion counts at a threshold and every rate derived from them."""
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    a, hit = F.col(actual) == 1, p >= threshold
    c = df.groupBy(*keys).agg(
        F.count_if(a & hit).alias("tp"), F.count_if(~a & hit).alias("fp"), F.count_if(a & ~hit).alias("fn"),
        F.count_if(~a & ~hit).alias("tn"), F.avg(F.pow(p - F.col(actual), 2)).alias("brier"),
    )
    return confusion_rates(c)


def confusion_rates(c: DataFrame) -> DataFrame:
    """Rates of tp, fp, fn, tn; a rate without cases is 0."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    recall, specificity = _share(tp, tp + fn), _share(tn, tn + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumns(
        {
            "recall": recall,
            "precision": _share(tp, tp + fp),
            "false_negative_rate": _share(fn, fn + tp),
            "specificity": specificity,
            "f1": _share(2 * tp, 2 * tp + fp + fn),
            "mcc": _share(tp * tn - fp * fn, spread),
            "accuracy": _share(tp + tn, tp + tn + fp + fn),
            "balanced_accuracy": (recall + specificity) / 2,
        }
    )


def _ladder(df: DataFrame, keys: Sequence[str], actual: str, score: str, hot_rows: int | None) -> DataFrame:
    """Distinct scores from the highest down with the bad and all rows at or above each."""
    rungs = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(actual).alias("_bad"), F.count(F.lit(1)).alias("_n"))
    return running_totals(
        rungs, keys, ["_s"], {"_tp": F.col("_bad"), "_all": F.col("_n")}, descending=["_s"], hot_rows=hot_rows
    )


def ranking_scores(df: DataFrame, keys: Sequence[str] = (), *, actual: str = "actual_bad", score: str = "probability", hot_rows: int | None = None) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision, no interpolation) per key."""
    ladder = _ladder(df, keys, actual, score, hot_rows)
    bad, good = F.sum("_bad"), F.sum(F.col("_n") - F.col("_bad"))
    # Each rung pairs its good rows with the bad rows above it, and half of those beside it.
    wins = F.sum((F.col("_n") - F.col("_bad")) * (F.col("_tp") - F.col("_bad") / 2))
    area = F.sum(F.col("_bad") * F.col("_tp") / F.col("_all"))
    return ladder.groupBy(*keys).agg(
        F.when((bad > 0) & (good > 0), wins / F.when((bad > 0) & (good > 0), bad * good)).alias("roc_auc"),
        F.when(bad > 0, area / F.when(bad > 0, bad)).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    return ranking_scores(df, keys, **options).drop("pr_auc")


def pr_auc(df: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    return ranking_scores(df, keys, **options).drop("roc_auc")


def recall_guardrail(df: DataFrame, *, actual: str = "actual_bad", score: str = "probability", minimum_recall: float = 0.80, hot_rows: int | None = None) -> DataFrame:
    """The most precise threshold that keeps the recall; the higher one on ties; 0.5 when none does.

    Candidates are every score and 0.01 to 0.99. The grid joins the score ladder as rows without weight,
    so all candidates are judged by one ordered running total.
    """
    grid = df.sparkSession.range(1, 100).select((F.col("id") / 100.0).alias("_s"), F.lit(0).alias("_a"), F.lit(0).alias("_w"))
    scores = df.select(F.col(score).cast("double").alias("_s"), F.col(actual).cast("int").alias("_a"), F.lit(1).alias("_w"))
    rungs = scores.unionByName(grid).groupBy("_s").agg(F.sum("_a").cast("long").alias("_bad"), F.sum("_w").cast("long").alias("_n"))
    ladder = running_totals(rungs, [], ["_s"], {"_tp": F.col("_bad"), "_all": F.col("_n")}, descending=["_s"], hot_rows=hot_rows)
    total = df.agg(F.sum(actual).alias("_total"))
    judged = ladder.crossJoin(F.broadcast(total)).select(  # one row
        F.col("_s").alias("threshold"), _share(F.col("_tp"), F.col("_all")).alias("precision"), _share(F.col("_tp"), F.col("_total")).alias("recall")
    )
    best = judged.filter(F.col("recall") >= minimum_recall).agg(
        F.max(F.struct("precision", "threshold", "recall")).alias("_best")
    )
    return best.select(
        F.coalesce("_best.threshold", F.lit(0.5)).alias("threshold"), F.col("_best.precision").alias("precision"), F.col("_best.recall").alias("recall")
    )


def response_then_classify(df: DataFrame, threshold: float, keys: Sequence[str] = (), *, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Both responses cut strictly at the threshold, then compared as classes."""
    bad, hit = F.col(actual) > threshold, F.col(predicted) > threshold
    c = df.groupBy(*keys).agg(
        F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn")
    )
    return confusion_rates(c)


def quality_gate(metrics: DataFrame, minimum_r2: float = 0.8, r2: str = "holdout_r2") -> DataFrame:
    """Models whose holdout r2 is above the minimum; a model without one is refused."""
    return metrics.filter(F.coalesce(F.col(r2) > minimum_r2, F.lit(False)))


def champion(results: DataFrame, score: str = "r2") -> DataFrame:
    """The best model by its pooled score, ties by name."""
    return results.orderBy(F.desc_nulls_last(score), "model").limit(1)


def conditional_diagnostics(ledger: DataFrame, *, bad: str = "actual_bad", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Regression metrics within the good and within the bad rows."""
    return regression_metrics(ledger.withColumn("subset", F.when(F.col(bad) == 1, "bad").otherwise("good")), ["subset"], actual=actual, predicted=predicted)
