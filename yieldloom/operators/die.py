"""Die-test lane: passing dies, distribution features, spec proximity, lot features, die merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.text import normalize_colname
from yieldloom.plans import HotKeys, bounded, find_hot, group_stats, measured, row_index

OUTLIER_SPAN = 3.0
NEAR_SHARE = 0.05
NEAR_SIGMAS = 0.5

# Columns that describe a die rather than measure it.
META_COLUMNS = ("device_", "bin", "site", "x", "y", "fails", "alarms", "device_bin_site", "test_number")
# Name parts of coordinate and timing columns, which are no tests either.
NON_TEST_PARTS = (
    "x_die_location", "y_die_location", "timeline", "uph", "test_time_prior_", "index_time", "down_time_total_",
    "x_die", "y_die",
)

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
STAT_COLUMNS = ("mean", "std", "median", "iqr", "min", "max", "missing_rate", "outlier_rate", *PERCENTILES)


def _blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column.cast("string")) == "")


def passing_dies(df: DataFrame, bin_: str = "bin", fails: str = "fails", alarms: str = "alarms") -> DataFrame:
    """Dies in bin 1 without failing or alarming tests."""
    return df.filter((F.col(bin_).try_cast("double") == 1) & _blank(F.col(fails)) & _blank(F.col(alarms)))


def die_is_pass(bin_: Column, fails: Column, alarms: Column) -> Column:
    """The same rule as a flag; the text ``nan`` counts as blank, a missing bin fails."""
    clear = lambda c: _blank(c) | (F.trim(c.cast("string")) == "nan")
    return F.coalesce(bin_.try_cast("double") == 1, F.lit(False)) & clear(fails) & clear(alarms)


def valid_coordinates(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    typed = df.withColumns({x: F.col(x).try_cast("double"), y: F.col(y).try_cast("double")})
    return typed.dropna(subset=[x, y])


def test_columns(df: DataFrame, test: str = "test_id") -> DataFrame:
    """Long rows whose test is a measurement, not a die attribute, coordinate or timing.

    Each distinct name is judged once; rows without a name are no tests.
    """
    name = normalize_colname(F.col(test))
    refused = name.isin(*META_COLUMNS) | name.rlike("|".join(NON_TEST_PARTS))
    return df.filter(F.col(test).isNotNull()).join(measured(df.select(test).distinct().filter(refused)), test, "left_anti")


def col_stats(df: DataFrame, keys: Sequence[str], value: str = "value", *, limits: DataFrame | None = None, test: str = "test_id", hot: HotKeys | None = None, hot_rows: int | None = None) -> DataFrame:
    """Fifteen distribution statistics per key; with limits also the four spec-proximity shares.

    The outlier and proximity shares need the first pass' median, IQR and sigma,
    so a second mergeable aggregation runs over rows joined with those.
    """
    v = F.col(value)
    hot = find_hot(df, keys, hot_rows) if hot is None else hot
    first = group_stats(
        df, keys, value,
        [
            F.avg(v).alias("mean"),
            F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            (1 - F.count(v) / F.count(F.lit(1))).alias("missing_rate"),
        ],
        PERCENTILES, hot=hot,
    )
    first = first.withColumns({"median": F.col("p50"), "iqr": F.col("p75") - F.col("p25")})
    fences = first.select(*keys, F.col("median").alias("_mid"), F.col("iqr").alias("_iqr"), F.col("std").alias("_std"))
    # One fence row per key: small enough it is broadcast, so the rows are not shuffled again, else hashed, so they are not sorted.
    rows = df.join(bounded(fences, hot.groups, hashed=True), list(keys))
    reach = OUTLIER_SPAN * F.col("_iqr")
    outside = (v < F.col("_mid") - reach) | (v > F.col("_mid") + reach)
    shares = [F.avg(F.when(v.isNotNull(), (outside & (F.col("_iqr") > 0)).cast("double"))).alias("outlier_rate")]
    extra: list[str] = []
    if limits is not None:
        rows = rows.join(limits.select(test, F.col("lsl").alias("_lsl"), F.col("usl").alias("_usl")), test, "left")
        shares += spec_proximity_shares(v, F.col("_lsl"), F.col("_usl"), F.col("_std"))
        extra = ["near_lsl_pct", "near_usl_pct", "near_lsl_sigma", "near_usl_sigma"]
    second = rows.groupBy(*keys).agg(*shares)
    return first.join(bounded(second, hot.groups), list(keys)).select(*keys, *STAT_COLUMNS, *extra)


def spec_proximity_shares(v: Column, lsl: Column, usl: Column, sigma: Column) -> list[Column]:
    """Aggregates: share of values just inside each limit, by 5 % of the range and by half a sigma."""
    usable = v.isNotNull() & lsl.isNotNull() & usl.isNotNull() & (usl > lsl)
    inside_low = lambda margin: ((v >= lsl) & (v <= lsl + margin)).cast("double")
    inside_high = lambda margin: ((v <= usl) & (v >= usl - margin)).cast("double")
    part, sig = NEAR_SHARE * (usl - lsl), NEAR_SIGMAS * sigma
    has_sigma = usable & (sigma > 1e-9)
    return [
        F.avg(F.when(usable, inside_low(part))).alias("near_lsl_pct"),
        F.avg(F.when(usable, inside_high(part))).alias("near_usl_pct"),
        F.avg(F.when(has_sigma, inside_low(sig))).alias("near_lsl_sigma"),
        F.avg(F.when(has_sigma, inside_high(sig))).alias("near_usl_sigma"),
    ]


def spec_proximity(df: DataFrame, keys: Sequence[str], limits: DataFrame, *, value: str = "value", test: str = "test_id") -> DataFrame:
    """The four proximity shares per key from rows and limits, without the distribution statistics."""
    sigma = df.groupBy(*keys).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_std"))
    # One sigma per key is hashed, so rows are neither sorted by key nor held.
    rows = df.join(limits.select(test, "lsl", "usl"), test, "left").join(sigma.hint("shuffle_hash"), list(keys))
    return rows.groupBy(*keys).agg(*spec_proximity_shares(F.col(value), F.col("lsl"), F.col("usl"), F.col("_std")))


def wafer_features(dies: DataFrame, keys: Sequence[str] = ("lot", "wafer"), *, test: str = "test_id", value: str = "value", die: str = "die_id", limits: DataFrame | None = None, wide: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Distribution and proximity statistics of passing dies per wafer and test, with the pass count.

    Dies are counted on ``wide``, the table before it was made long, where there is one: each die is then shuffled
    once and not once per test.
    """
    stats = col_stats(test_columns(dies, test), [*keys, test], value, limits=limits, test=test, hot_rows=hot_rows)
    counts = (dies if wide is None else wide).select(*keys, die).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("pass_count"))
    return stats.join(counts, list(keys))


def lot_weighted_features(features: DataFrame, *, lot: str = "lot", feature: str = "feature", value: str = "value", weight: str = "pass_count") -> DataFrame:
    """Lot value of each feature: mean over wafers with a value, weighted by their pass counts."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    total = F.sum(known)
    mean = F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total)
    return features.groupBy(lot, feature).agg(mean.alias(value))


def common_features(features: DataFrame, *, feature: str = "feature", unit: Sequence[str] = ("lot", "wafer"), at_least: int = 3) -> DataFrame:
    """Rows of features present in at least min(at_least, number of units) units."""
    present = features.select(feature, *unit).distinct()
    counts = present.groupBy(feature).agg(F.count(F.lit(1)).alias("_n"))
    units = present.select(*unit).distinct().agg(F.count(F.lit(1)).alias("_units"))
    kept = counts.crossJoin(F.broadcast(units)).filter(F.col("_n") >= F.least(F.lit(at_least), F.col("_units")))  # one row
    # A feature may have most rows: few kept ones are broadcast, more are hashed, and rows are sorted by feature in neither case.
    return features.join(measured(kept.select(feature), hashed=True), feature, "left_semi")


def merge_dies(dies: DataFrame, keys: Sequence[str] = ("wafer", "x", "y"), *, is_pass: str = "is_pass", recency: Sequence[str] = ("created_ts",), keep: Sequence[str] = (), tests: Sequence[str] = ()) -> DataFrame:
    """One die per position: pass beats fail, then the newest; equal-status older rows fill missing tests.

    Everything is a mergeable aggregate, so a position measured any number of times costs one row per task.
    """
    age = F.struct(*recency)
    passed = F.col(is_pass)
    best = F.max_by(F.struct(*[F.col(c) for c in (is_pass, *recency, *keep)]), F.struct(passed, *recency))
    fills = []
    for t in tests:
        seen = F.col(t).isNotNull()
        fills.append(F.max_by(t, F.when(seen & passed, age)).alias(f"_p_{t}"))
        fills.append(F.max_by(t, F.when(seen & ~passed, age)).alias(f"_f_{t}"))
    merged = dies.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("sources"), *fills)
    chosen = [F.when(F.col(f"_best.{is_pass}"), F.col(f"_p_{t}")).otherwise(F.col(f"_f_{t}")).alias(t) for t in tests]
    return merged.select(*keys, *[f"_best.{c}" for c in (is_pass, *recency, *keep)], "sources", *chosen)


def lot_test_stats(dies: DataFrame, keys: Sequence[str] = ("lot", "test_id"), value: str = "value", minimum: int = 1, hot_rows: int | None = None) -> DataFrame:
    """mean, std, median, min, max and count of each test, for tests with enough values."""
    v = F.col(value)
    aggs = [
        F.avg(v).alias("mean"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("count"),
    ]
    out = group_stats(dies, keys, value, aggs, {"median": 0.5}, hot_rows=hot_rows).filter(F.col("count") >= minimum)
    return out.select(*keys, "mean", "std", "median", "min", "max", "count")


def current_param_stats(dies: DataFrame, test: str = "test_id", value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Statistics of the current wafer's tests that have at least five values."""
    return lot_test_stats(dies, [test], value, minimum=5, hot_rows=hot_rows)


def rename_to_test_ids(rows: DataFrame, test_dim: DataFrame, column: str = "column") -> DataFrame:
    """Long rows named by T-number where one is known, else by the normalised column name."""
    names = test_dim.groupBy(F.col("test_name").alias("_name")).agg(F.min("test_id").alias("_id"))
    joined = rows.join(names, F.col(column) == F.col("_name"), "left")
    return joined.withColumn("test_id", F.coalesce("_id", normalize_colname(F.col(column)))).drop("_name", "_id")


def device_renumber(dies: DataFrame, keys: Sequence[str] = ("wafer", "site"), order: Sequence[str] = ("x_text", "y_text")) -> DataFrame:
    """Running device number per site in the given order."""
    return row_index(dies, keys, order, name="device_no")
