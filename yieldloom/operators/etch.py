"""Plasma-etch lane: decoded process traces and wafer-average targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.numeric import coordinate_columns, inf_to_null
from yieldloom.operators.contracts import ContractError
from yieldloom.operators.die import STAT_COLUMNS, col_stats
from yieldloom.operators.traces import first_last
from yieldloom.plans import find_hot, measured, row_index


def decode_dictionary(codes: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Replaces codes by their dictionary values; unknown codes become NULL. Two values for one code are an error."""
    table = dictionary.distinct()
    if not table.groupBy(code).count().filter("count > 1").isEmpty():
        raise ContractError("the dictionary gives a code several values")
    return codes.join(measured(table), code, "left").drop(code)


def trace_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Least-squares slope over positions spread evenly on [-1, 1]; 0 below two values or without spread.

    With centred positions the slope is a ratio of mergeable sums once each row knows its position.
    """
    known = df.filter(F.col(value).isNotNull())
    hot = find_hot(known, keys, hot_rows)
    placed = row_index(known, keys, order, name="_pos", hot=hot)
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.regr_slope(F.col(value), F.col("_pos").cast("double")).alias("_per_row"),
    )
    slope = F.col("_per_row") * (F.col("_n") - 1) / 2
    flat = (F.col("_n") < 2) | (F.col("_lo") == F.col("_hi"))
    return sums.select(*keys, F.when(flat, 0.0).otherwise(F.coalesce(slope, F.lit(0.0))).alias("slope"))


def etch_process_features(df: DataFrame, keys: Sequence[str] = ("experiment_key", "signal"), *, time: str = "t", value: str = "value", order: Sequence[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Distribution statistics, quartiles, first, last and slope of each signal; missing readings are skipped."""
    order = list(order or [time])
    known = df.withColumn(value, inf_to_null(F.col(value))).filter(F.col(value).isNotNull())
    stats = col_stats(known, keys, value, hot_rows=hot_rows)
    first, last = first_last(value, order)
    ends = known.groupBy(*keys).agg(first.alias("first"), last.alias("last"))
    slope = trace_slope(known, keys, order, value, hot_rows)
    out = stats.join(ends, list(keys)).join(slope, list(keys))
    return out.select(*keys, *STAT_COLUMNS, F.col("p25").alias("q25"), F.col("p75").alias("q75"), "first", "last", "slope")


def etch_sample_stats(df: DataFrame, key: str = "experiment_key", time: str = "t") -> DataFrame:
    """Distinct sample times and the covered duration per wafer."""
    times = df.select(key, time).distinct()
    return times.groupBy(key).agg(
        F.count(F.lit(1)).alias("process__sample_count"), (F.max(time) - F.min(time)).alias("process__duration")
    )


def wafer_average_target(points: DataFrame, keys: Sequence[str] = ("experiment_key", "lot_number"), targets: Sequence[str] = ("si_etch", "oxide_etch")) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(t).alias(t) for t in targets], F.count(F.lit(1)).alias("points"))


def coordinate_features(points: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    return points.withColumns(coordinate_columns(F.col(x), F.col(y)))


def etch_map_view(points: DataFrame, key: str, target: str = "si_etch") -> DataFrame:
    """Position and measured value of one wafer."""
    return points.filter(F.col("experiment_key") == key).select("X", "Y", F.col(target).alias("value"))
