"""Per-wafer, per-sensor temporal features and the trace grid they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.numeric import inf_to_null
from yieldloom.operators.cleaning import SAMPLES_PER_WAFER
from yieldloom.plans import HotKeys, group_stats, measured

TEMPORAL_STATS = (
    "mean", "std", "min", "max", "median", "q25", "q75", "range", "delta", "slope",
    "early_mean", "middle_mean", "late_mean", "missing_rate",
)


def first_last(value: str, order: Sequence[str]) -> tuple[Column, Column]:
    """First and last non-null reading along the order columns, as mergeable aggregates."""
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    seen = F.when(F.col(value).isNotNull(), rank)
    return F.min_by(value, seen), F.max_by(value, seen)


def temporal_features(
    df: DataFrame,
    keys: Sequence[str] = ("equipment", "lot", "wafer", "sensor"),
    *,
    value: str = "value",
    index: str = "ts_idx",
    order: Sequence[str] | None = None,
    samples: int = SAMPLES_PER_WAFER,
    phase_ends: tuple[int, int] = (58, 116),
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Fourteen statistics per key in one aggregation; NaN and infinities count as missing."""
    clean = df.withColumn(value, inf_to_null(F.col(value).cast("double")))
    v, i = F.col(value), F.col(index)
    first, last = first_last(value, order or [index])
    early, late = i <= phase_ends[0], i > phase_ends[1]
    aggs = [
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        first.alias("_first"),
        last.alias("_last"),
        F.avg(F.when(early, v)).alias("early_mean"),
        F.avg(F.when(~early & ~late, v)).alias("middle_mean"),
        F.avg(F.when(late, v)).alias("late_mean"),
        (1 - F.count(v) / F.count(F.lit(1))).alias("missing_rate"),
    ]
    stats = group_stats(
        clean, keys, value, aggs, {"median": 0.5, "q25": 0.25, "q75": 0.75}, hot=hot, hot_rows=hot_rows
    )
    delta = F.col("_last") - F.col("_first")
    stats = stats.withColumns({"range": F.col("max") - F.col("min"), "delta": delta, "slope": delta / (samples - 1)})
    return stats.select(*keys, *TEMPORAL_STATS)


def feature_rows(stats: DataFrame, keys: Sequence[str], parts: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Stat columns to long (keys, feature, value); the feature is the parts and the stat joined by ``__``."""
    names = [c for c in (columns or stats.columns) if c not in keys and c not in parts]
    doubles = stats.select(*keys, *parts, *[F.col(c).cast("double").alias(c) for c in names])
    long = doubles.unpivot([*keys, *parts], names, "_stat", "value")
    return long.select(*keys, F.concat_ws("__", *parts, "_stat").alias("feature"), "value")


def pivot_features(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long features to one row per key with exactly the named columns, absent ones NULL."""
    return features.groupBy(*keys).pivot("feature", list(names)).agg(F.first("value", ignorenulls=True))


def trace_grid(df: DataFrame, keys: Sequence[str], *, index: str = "ts_idx", value: str = "value") -> DataFrame:
    """At most one reading per key and index: repeated readings are averaged."""
    return df.groupBy(*keys, index).agg(F.avg(value).alias(value))


def trace_arrays(df: DataFrame, keys: Sequence[str], *, index: str = "ts_idx", value: str = "value", samples: int = SAMPLES_PER_WAFER) -> DataFrame:
    """Ordered readings per key, one slot per index, gaps NULL.

    A key holds at most ``samples`` cells because equal indices are reduced first; a reading without an index from
    0 to ``samples`` - 1 has no slot and fails the job.
    """
    refused = F.raise_error(F.concat(F.lit("reading outside the trace: index "), F.coalesce(F.col(index).cast("string"), F.lit("missing"))))
    placed = df.withColumn(index, F.when(F.col(index).between(0, samples - 1), F.col(index)).otherwise(refused.cast(df.schema[index].dataType)))
    grid = trace_grid(placed, keys, index=index, value=value)
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int"), F.col(value))))
    slots = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.try_element_at(F.col("_cells"), i))
    return grid.groupBy(*keys).agg(cells.alias("_cells")).select(*keys, slots.alias("readings"))


def raw_trace_matrix(df: DataFrame, keys: Sequence[str] = ("lot", "wafer"), *, sensor: str = "sensor", index: str = "ts_idx", value: str = "value") -> DataFrame:
    """Every (sensor, time) cell as a named feature row ``<sensor>__t000``."""
    name = F.concat(F.col(sensor), F.lit("__t"), F.lpad(F.col(index).cast("string"), 3, "0"))
    return df.select(*keys, name.alias("feature"), F.col(value).alias("value"))


def wafer_trace_view(wide: DataFrame, lot: str, wafer: str, sensors: Sequence[str]) -> DataFrame:
    """One wafer, selected sensors, as (timestamp, sensor, value)."""
    rows = wide.filter((F.col("lot") == lot) & (F.col("wafer") == wafer))
    return rows.select("timestamp", *sensors).unpivot(["timestamp"], list(sensors), "sensor", "value")


def trace_impute(df: DataFrame, train: Column, *, by: Sequence[str] = ("sensor",), value: str = "value", fallback: bool = True, hot_rows: int | None = None) -> DataFrame:
    """Missing readings become the training rows' median per ``by``, else their overall median, else 0."""
    medians = measured(group_stats(df.filter(train), by, value, [], {"_median": 0.5}, hot_rows=hot_rows))
    joined = df.join(medians, list(by), "left")
    if fallback:
        overall = group_stats(df.filter(train), [], value, [], {"_overall": 0.5}, hot_rows=hot_rows)
        joined = joined.crossJoin(F.broadcast(overall))  # one row
    else:
        joined = joined.withColumn("_overall", F.lit(0.0))
    filled = F.coalesce(F.col(value), "_median", "_overall", F.lit(0.0))
    return joined.withColumn(value, filled).select(*df.columns)


def trace_scale(df: DataFrame, train: Column, *, by: Sequence[str] = ("sensor",), value: str = "value") -> DataFrame:
    """(x - mean) / std with the training rows' population statistics; a tiny std counts as 1."""
    facts = measured(df.filter(train).groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")))
    spread = F.when(F.col("_std") < 1e-6, 1.0).otherwise(F.col("_std"))
    return df.join(facts, list(by), "left").withColumn(value, (F.col(value) - F.col("_mean")) / spread).select(*df.columns)
