"""Lot context and within-lot ranking; a lot may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.plans import group_stats, measured, row_index, running_totals


def group_transform(df: DataFrame, columns: Sequence[str], group: str = "lot") -> DataFrame:
    """Group mean and std of each column on every row, with the row's deviation and z (0 without spread).

    Group facts are aggregated and joined back instead of computed in a window, so a large group is not one task.
    """
    facts = df.groupBy(group).agg(
        *[F.avg(c).alias(f"lot_mean__{c}") for c in columns],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"lot_std__{c}") for c in columns],
    )
    out = df.join(measured(facts), group)
    for c in columns:
        mean, std = F.col(f"lot_mean__{c}"), F.col(f"lot_std__{c}")
        z = F.when(F.abs(std) > 1e-12, (F.col(c) - mean) / F.when(F.abs(std) > 1e-12, std))
        out = out.withColumns({f"lot_delta__{c}": F.col(c) - mean, f"lot_z__{c}": F.coalesce(z, F.lit(0.0))})
    return out


def probability_context(df: DataFrame, group: str = "lot", probability: str = "probability", hot_rows: int | None = None) -> DataFrame:
    """Lot mean, std, min, max, q25 and q75 of a probability on every row."""
    p = F.col(probability)
    aggs = [F.avg(p).alias("p_mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("p_std"), F.min(p).alias("p_min"), F.max(p).alias("p_max")]
    facts = group_stats(df, [group], probability, aggs, {"p_q25": 0.25, "p_q75": 0.75}, hot_rows=hot_rows)
    return df.join(measured(facts), group)


def average_ranks(df: DataFrame, group: Sequence[str], score: str, hot_rows: int | None = None) -> DataFrame:
    """(group, score, rank): the average 1-based rank of each distinct score within its group."""
    ladder = df.filter(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(ladder, group, [score], {"_upto": F.col("_n")}, hot_rows=hot_rows)
    return upto.select(*group, score, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def percent_rank_avg(df: DataFrame, scores: Sequence[str], group: str = "lot", hot_rows: int | None = None) -> DataFrame:
    """Mean over the scores of each row's average-method percentile rank within its lot."""
    out, parts = df, []
    for i, score in enumerate(scores):
        ranks = average_ranks(df, [group], score, hot_rows)
        sizes = df.groupBy(group).agg(F.count(score).alias(f"_n{i}"))
        table = ranks.join(sizes, group).select(group, score, (F.col("rank") / F.col(f"_n{i}")).alias(f"_pct{i}"))
        out = out.join(table, [group, score], "left")
        parts.append(F.col(f"_pct{i}"))
    mean = sum(parts[1:], parts[0]) / len(parts)
    return out.select(*df.columns, mean.alias("rank_average"))


def top_n_per_group_dynamic(df: DataFrame, group: str = "lot", *, bad: str = "actual_bad", probability: str = "probability", tie: Sequence[str] = ("row",), hot_rows: int | None = None) -> DataFrame:
    """Flags, per lot, as many of the most probable rows as the lot truly has bad ones; ties by row order."""
    ranked = row_index(df, [group], [probability, *tie], descending=[probability], name="_rank", hot_rows=hot_rows)
    counts = measured(df.groupBy(group).agg(F.sum(bad).alias("_bad")))
    return ranked.join(counts, group).select(
        *df.columns, (F.col("_rank") <= F.coalesce("_bad", F.lit(0))).cast("int").alias("selected")
    )


def class_mean_prediction(df: DataFrame, *, response: str = "response", bad: str = "actual_bad", fold: str = "fold", predicted: str = "predicted_bad") -> DataFrame:
    """Predicted class turned into the mean response of that class outside the row's fold."""
    cells = df.groupBy(fold, bad).agg(F.sum(response).alias("_s"), F.count(response).alias("_n"))
    totals = cells.groupBy(bad).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    grid = totals.crossJoin(df.select(fold).distinct())  # two classes by the folds
    outside = grid.join(cells, [fold, bad], "left")
    s = F.col("_ts") - F.coalesce("_s", F.lit(0.0))
    n = F.col("_tn") - F.coalesce("_n", F.lit(0))
    means = outside.select(fold, F.col(bad).alias(predicted), F.when(n > 0, s / F.when(n > 0, n)).alias("class_mean"))
    return df.join(measured(means), [fold, predicted], "left").select(*df.columns, "class_mean")


def oracle_count_report(reference: DataFrame, probability: str = "probability", *, group: str = "lot", tie: Sequence[str] = ("row",), hot_rows: int | None = None) -> DataFrame:
    """Metrics of selecting each lot's true bad count by a score; rows without a score are counted and left out."""
    from yieldloom.operators.metrics import ranking_scores, regression_metrics

    scored = reference.filter(F.col(probability).isNotNull())
    chosen = top_n_per_group_dynamic(scored, group, probability=probability, tie=tie, hot_rows=hot_rows)
    predicted = class_mean_prediction(chosen, predicted="selected")
    r2 = regression_metrics(predicted, [], actual="response", predicted="class_mean").select(F.col("r2").alias("oracle_count_class_mean_r2"))
    hit = (F.col("selected") == 1) & (F.col("actual_bad") == 1)
    sums = chosen.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("lots"), F.sum("actual_bad").alias("bad_wafers"),
        F.count_if(hit).alias("true_positives"), F.count_if(F.col("selected") != F.col("actual_bad")).alias("class_mistakes"),
        (F.count_if(hit) / F.nullif(F.sum("selected"), F.lit(0))).alias("precision"),
        (F.count_if(hit) / F.nullif(F.sum("actual_bad"), F.lit(0))).alias("recall"),
    )
    missing = reference.agg(F.count_if(F.col(probability).isNull()).alias("missing_scores"))
    auc = ranking_scores(scored, [], actual="actual_bad", score=probability, hot_rows=hot_rows)
    return sums.crossJoin(missing).crossJoin(auc).crossJoin(r2)  # one row each
