"""Golden-baseline comparison and wafer disposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions.grades import normalised_yield, zscore_closeness
from yieldloom.operators.die import lot_test_stats, test_columns
from yieldloom.operators.joins import golden_fallback, golden_overlap, limit_lookup


def top_lots(lot_yield: DataFrame, k: int, *, lot: str = "lot", yield_: str = "yield_pct") -> DataFrame:
    """The k lots with the highest yield, ties by lot name; a feature of the report, not a row cap."""
    return lot_yield.orderBy(F.desc(yield_), lot).limit(k)


def golden_baseline(dies: DataFrame, lot_yield: DataFrame, *, top_n: int = 3, lot: str = "lot", test: str = "test_id", value: str = "value", yield_: str = "yield_pct", hot_rows: int | None = None) -> DataFrame:
    """Pooled statistics of the best lots' passing dies per test with at least five values."""
    best = top_lots(lot_yield, top_n, lot=lot, yield_=yield_)
    pooled = test_columns(dies.join(best.select(lot), lot, "left_semi"), test)
    stats = lot_test_stats(pooled, [test], value, minimum=5, hot_rows=hot_rows)
    mean_yield = best.agg(F.avg(yield_).alias("golden_yield"))
    return stats.crossJoin(F.broadcast(mean_yield))  # one row


def prediction_baseline(dies: DataFrame, files: DataFrame, *, top_n: int = 5, lot: str = "lot", file: str = "source_file", test: str = "test_id", value: str = "value", yield_: str = "yield_pct", hot_rows: int | None = None) -> DataFrame:
    """Pooled statistics of the first file of each of the best lots."""
    first = Window.partitionBy(lot).orderBy(F.desc(yield_), file)
    one_file = files.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    best = one_file.orderBy(F.desc(yield_), lot).limit(top_n)
    pooled = test_columns(dies.join(best.select(file), file, "left_semi"), test)
    return lot_test_stats(pooled, [test], value, minimum=5, hot_rows=hot_rows)


def golden_comparison(current: DataFrame, golden: DataFrame, limits: DataFrame, actual: DataFrame | None = None, *, test: str = "test_id") -> DataFrame:
    """Deviation of each golden test in golden sigmas and its status against limits and sigmas."""
    actual = actual if actual is not None else current.limit(0)
    rows = limit_lookup(golden_fallback(golden, current, actual, test), limits, test)
    deviation = F.abs(F.col("mean") - F.col("golden_mean")) / (F.col("golden_std") + 1e-9)
    outside = F.coalesce(F.col("mean") < F.col("lsl"), F.lit(False)) | F.coalesce(F.col("mean") > F.col("usl"), F.lit(False))
    out = rows.withColumn("deviation_z", deviation)
    status = F.when(outside | (F.col("deviation_z") > 2), "Out of Spec").when(F.col("deviation_z") > 1, "Marginal").otherwise("Within Spec")
    return out.select(test, "lsl", "usl", "golden_mean", "golden_std", "mean", "std", "deviation_z", status.alias("status"))


def golden_correlation(candidate: DataFrame, golden: DataFrame, keys: Sequence[str] = (), *, test: str = "test_id") -> DataFrame:
    """Pearson r of test means against the golden means; NULL below two tests or without spread."""
    both = golden_overlap(candidate, golden, test).filter("mean IS NOT NULL AND golden_mean IS NOT NULL")
    a, b = F.col("mean"), F.col("golden_mean")
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    r = F.when((F.count(a) >= 2) & (spread > 0), F.covar_samp(a, b) / F.when(spread > 0, spread))
    clipped = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return both.groupBy(*keys).agg(F.count(a).alias("overlap"), clipped.alias("golden_correlation"))


def _z_rows(candidate: DataFrame, golden: DataFrame, test: str) -> DataFrame:
    both = golden_overlap(candidate, golden, test).filter((F.col("golden_std") > 1e-9) & F.col("mean").isNotNull())
    return both.withColumn("z", F.abs(F.col("mean") - F.col("golden_mean")) / F.col("golden_std"))


def golden_z_scores(candidate: DataFrame, golden: DataFrame, keys: Sequence[str] = (), *, test: str = "test_id") -> DataFrame:
    """Largest and mean absolute z over shared tests and the closeness score derived from them."""
    z = _z_rows(candidate, golden, test).groupBy(*keys).agg(F.max("z").alias("_max"), F.avg("z").alias("_mean"))
    return z.select(
        *keys,
        F.coalesce("_max", F.lit(0.0)).alias("max_z"),
        zscore_closeness(F.col("_mean"), F.col("_max")).alias("closeness"),
    )


def shifted_tests(candidate: DataFrame, golden: DataFrame, keys: Sequence[str] = ("wafer",), *, test: str = "test_id", shown: int = 5) -> DataFrame:
    """Names of tests beyond two golden sigmas: the first five by name and how many more."""
    far = _z_rows(candidate, golden, test).filter("z > 2").select(*keys, test).distinct()
    ranked = far.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(test)))
    counts = far.groupBy(*keys).agg(F.count(F.lit(1)).alias("shifted"))
    names = ranked.filter(F.col("_rank") <= shown).groupBy(*keys).agg(F.array_sort(F.collect_list(test)).alias("_names"))
    more = F.when(F.col("shifted") > shown, F.format_string(" (+%d more)", F.col("shifted") - shown)).otherwise("")
    listed = F.concat(F.array_join("_names", ", "), more)
    return names.join(counts, list(keys)).select(*keys, "shifted", listed.alias("tests"))


def radar_parameters(candidate: DataFrame, golden: DataFrame, keys: Sequence[str] = ("wafer",), *, test: str = "test_id", k: int = 8) -> DataFrame:
    """The k tests with the largest deviation, with their signed z."""
    signed = _z_rows(candidate, golden, test).withColumn(
        "signed_z", (F.col("mean") - F.col("golden_mean")) / (F.col("golden_std") + 1e-9)
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("z"), test)
    return signed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*keys, "rank", test, "signed_z")


def yield_ensemble(predictions: DataFrame, keys: Sequence[str] = ("wafer",), *, raw: str = "predicted", pass_share: str = "pass_share") -> DataFrame:
    """Mean of the models' normalised yields as a fraction."""
    share = normalised_yield(F.col(raw), F.col(pass_share)) / 100
    return predictions.groupBy(*keys).agg(F.avg(share).alias("yield_prediction"), F.count(raw).alias("models"))


def actual_yield_lookup(wafers: DataFrame, final_inventory: DataFrame, probe_inventory: DataFrame) -> DataFrame:
    """Yield in the file name, else the final-test inventory's, else the probe inventory's by SYN lot."""
    own = F.regexp_extract("filename", r"_(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    named = F.regexp_extract(F.upper("filename"), r"(SYN_\d{4})", 1)
    syn = F.when(named != "", named).otherwise(F.regexp_extract(F.upper("lot_id"), r"(SYN_\d{4})", 1))
    side = lambda df, n: df.groupBy(F.upper("lot_id").alias("_syn")).agg(F.max("yield_pct").alias(n))
    out = wafers.withColumns({"_own": own, "_syn": F.when(syn != "", syn)})
    out = out.join(side(final_inventory, "_final"), "_syn", "left").join(side(probe_inventory, "_probe"), "_syn", "left")
    return out.select(*wafers.columns, F.coalesce("_own", "_final", "_probe").alias("actual_yield"))


def baseline_yield(final_golden: Column, probe_golden: Column, historical: Column) -> Column:
    """Golden final-test yield, else golden probe yield (both in percent), else the historical fraction."""
    positive = lambda c: F.when(c > 0, c / 100)
    return F.coalesce(positive(final_golden), positive(probe_golden), historical)
