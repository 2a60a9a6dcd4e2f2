"""Polishing-trace features per (wafer, stage)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.numeric import inf_to_null
from yieldloom.operators.contracts import require_columns
from yieldloom.operators.traces import first_last
from yieldloom.plans import HotKeys, bounded, find_hot, group_stats, nearby_rows, row_index

KEYS = ("WAFER_ID", "STAGE")
# Signals with phase and chamber features.
CRITICAL_SIGNALS = (
    "PRESSURIZED_CHAMBER_PRESSURE", "MAIN_OUTER_AIR_BAG_PRESSURE", "CENTER_AIR_BAG_PRESSURE", "RETAINER_RING_PRESSURE",
    "RIPPLE_AIR_BAG_PRESSURE", "EDGE_AIR_BAG_PRESSURE", "SLURRY_FLOW_LINE_A", "SLURRY_FLOW_LINE_B",
    "SLURRY_FLOW_LINE_C", "WAFER_ROTATION", "STAGE_ROTATION", "HEAD_ROTATION",
)
# The columns of a raw polishing trace.
TRACE_COLUMNS = (
    "MACHINE_ID", "MACHINE_DATA", "TIMESTAMP", "WAFER_ID", "STAGE", "CHAMBER", "USAGE_OF_BACKING_FILM",
    "USAGE_OF_DRESSER", "USAGE_OF_POLISHING_TABLE", "USAGE_OF_DRESSER_TABLE", "PRESSURIZED_CHAMBER_PRESSURE",
    "MAIN_OUTER_AIR_BAG_PRESSURE", "CENTER_AIR_BAG_PRESSURE", "RETAINER_RING_PRESSURE", "RIPPLE_AIR_BAG_PRESSURE",
    "USAGE_OF_MEMBRANE", "USAGE_OF_PRESSURIZED_SHEET", "SLURRY_FLOW_LINE_A", "SLURRY_FLOW_LINE_B",
    "SLURRY_FLOW_LINE_C", "WAFER_ROTATION", "STAGE_ROTATION", "HEAD_ROTATION", "DRESSING_WATER_STATUS",
    "EDGE_AIR_BAG_PRESSURE",
)
IDENTITY = ("MACHINE_ID", "MACHINE_DATA", "TIMESTAMP", "WAFER_ID", "STAGE", "CHAMBER", "_source_index")


def long_signals(traces: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[str] = ("TIMESTAMP", "_source_index"), signals: Sequence[str] | None = None) -> DataFrame:
    """Wide trace to one row per (keys, time, signal)."""
    names = list(signals or [c for c in traces.columns if c not in IDENTITY and c not in keys])
    require_columns(traces, names)
    wide = traces.select(*keys, *extra, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([*keys, *extra], names, "signal", "value")


def cmp_signal_stats(long: DataFrame, keys: Sequence[str] = (*KEYS, "signal"), *, value: str = "value", order: Sequence[str] = ("TIMESTAMP", "_source_index"), hot: HotKeys | None = None, hot_rows: int | None = None) -> DataFrame:
    """mean, std, min, max, median, first, last, q25 and q75 per signal."""
    clean = long.withColumn(value, inf_to_null(F.col(value)))
    first, last = first_last(value, order)
    aggs = [
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        first.alias("first"), last.alias("last"),
    ]
    return group_stats(clean, keys, value, aggs, {"median": 0.5, "q25": 0.25, "q75": 0.75}, hot=hot, hot_rows=hot_rows)


def cmp_process_stats(traces: DataFrame, keys: Sequence[str] = KEYS, *, time: str = "TIMESTAMP", order: Sequence[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Sample count, duration, and mean and std of the gaps between successive timestamps."""
    order = list(order or [time])
    slim = traces.select(*dict.fromkeys([*keys, time, *order]))
    gaps = nearby_rows(
        slim, keys, order, lambda w: {"_gap": F.col(time) - F.lag(time).over(w)}, back=1, hot_rows=hot_rows
    )
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        (F.max(time) - F.min(time)).alias("process_duration"),
        F.avg("_gap").alias("timestamp_gap_mean"),
        F.stddev_samp("_gap").alias("timestamp_gap_std"),
    )


def phase_by_position(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("TIMESTAMP", "_source_index"), *, phases: int = 3, hot_rows: int | None = None) -> DataFrame:
    """Adds ``phase`` 0, 1, 2: thirds of the sequence by row position."""
    hot = find_hot(df, keys, hot_rows)
    placed = row_index(df, keys, order, name="_pos", hot=hot)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    third = F.floor(F.lit(phases) * (F.col("_pos") - 1) / F.col("_size"))
    joined = placed.join(bounded(sizes, hot.groups), list(keys))
    return joined.withColumn("phase", F.least(third, F.lit(phases - 1)).cast("int")).drop("_pos", "_size")


def cmp_phase_stats(traces: DataFrame, keys: Sequence[str] = KEYS, signals: Sequence[str] = CRITICAL_SIGNALS, *, order: Sequence[str] = ("TIMESTAMP", "_source_index"), hot_rows: int | None = None) -> DataFrame:
    """mean and std of each signal in each third, one column per (phase, signal, stat)."""
    slim = traces.select(*dict.fromkeys([*keys, *order, *signals]))
    phased = phase_by_position(slim, keys, order, hot_rows=hot_rows)
    aggs = []
    for s in signals:
        for p in range(3):
            inside = F.when(F.col("phase") == p, F.col(s))
            aggs += [F.avg(inside).alias(f"phase__{s}__mean__{p}"), F.stddev_samp(inside).alias(f"phase__{s}__std__{p}")]
    return phased.groupBy(*keys).agg(*aggs)


def cmp_chamber_stats(traces: DataFrame, keys: Sequence[str] = KEYS, signals: Sequence[str] = CRITICAL_SIGNALS, *, chamber: str = "CHAMBER", time: str = "TIMESTAMP") -> DataFrame:
    """Count, duration and signal means per chamber, long form (pivot at the model boundary)."""
    return traces.groupBy(*keys, chamber).agg(
        F.count(F.lit(1)).alias("chamber_count"),
        (F.max(time) - F.min(time)).alias("chamber_duration"),
        *[F.avg(s).alias(f"{s}__mean") for s in signals],
    )


def context_fractions(traces: DataFrame, keys: Sequence[str] = KEYS, columns: Sequence[str] = ("MACHINE_DATA", "CHAMBER")) -> DataFrame:
    """Share of samples per distinct context value, long form (keys, context, value, fraction)."""
    long = traces.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "context", "context_value"
    )
    counts = long.groupBy(*keys, "context", "context_value").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys, "context").agg(F.sum("_n").alias("_total"))
    joined = counts.filter("context_value IS NOT NULL").join(totals, [*keys, "context"])
    return joined.select(*keys, "context", "context_value", (F.col("_n") / F.col("_total")).alias("fraction"))


def stage_flag(traces: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 for stage B, 0 for stage A."""
    flag = F.when(F.col("STAGE") == "B", 1.0).when(F.col("STAGE") == "A", 0.0)
    return traces.select(*keys).distinct().withColumn("context__stage_b", flag)


def preston_proxy(traces: DataFrame, keys: Sequence[str] = KEYS, *, pressure: str = "PRESSURIZED_CHAMBER_PRESSURE", rotations: Sequence[str] = ("WAFER_ROTATION", "HEAD_ROTATION", "STAGE_ROTATION"), time: str = "TIMESTAMP") -> DataFrame:
    """Pressure times summed absolute rotation: mean, std, max and exposure over the duration."""
    speed = sum((F.abs(F.col(r)) for r in rotations), F.lit(0.0))
    p = F.col(pressure) * speed
    out = traces.groupBy(*keys).agg(
        F.avg(p).alias("preston_mean"), F.stddev_samp(p).alias("preston_std"), F.max(p).alias("preston_max"),
        (F.max(time) - F.min(time)).alias("_duration"),
    )
    return out.withColumn("pressure_speed_exposure", F.col("preston_mean") * F.col("_duration")).drop("_duration")


def campaign_id(traces: DataFrame, *, wafer: str = "WAFER_ID", stage: str = "STAGE", source: str = "_source_index", size: int = 10) -> DataFrame:
    """Campaign of a wafer from its earliest source file, shared by all its stages."""
    per_stage = traces.groupBy(wafer, stage).agg(F.min(source).alias("earliest_source"))
    per_wafer = per_stage.groupBy(wafer).agg(F.floor(F.min("earliest_source") / size).cast("int").alias("campaign"))
    return per_stage.join(per_wafer, wafer).select(wafer, stage, "earliest_source", "campaign")


def outlier_label_ceiling(labels: DataFrame, label: str = "AVG_REMOVAL_RATE", ceiling: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) labels; a label at or above the ceiling is kept as evidence only."""
    kept = F.coalesce(F.col(label) < ceiling, F.lit(False))
    return labels.filter(kept), labels.filter(~kept)


def cmp_features(traces: DataFrame, signals: Sequence[str] | None = None, critical: Sequence[str] = CRITICAL_SIGNALS, hot_rows: int | None = None) -> DataFrame:
    """All polishing features in long form (WAFER_ID, STAGE, feature, value)."""
    from yieldloom.operators.traces import feature_rows

    critical = [c for c in critical if c in traces.columns]
    signal = feature_rows(cmp_signal_stats(long_signals(traces, signals=signals), hot_rows=hot_rows), KEYS, ["signal"])
    general = feature_rows(cmp_process_stats(traces, order=["TIMESTAMP", "_source_index"], hot_rows=hot_rows), KEYS, [])
    phase = feature_rows(cmp_phase_stats(traces, signals=critical, hot_rows=hot_rows), KEYS, [])
    chamber = feature_rows(cmp_chamber_stats(traces, signals=critical).filter("CHAMBER IS NOT NULL"), KEYS, ["CHAMBER"])
    context = context_fractions(traces).select(
        *KEYS, F.concat_ws("__", F.lit("context"), "context", "context_value", F.lit("fraction")).alias("feature"),
        F.col("fraction").alias("value"),
    )
    physics = feature_rows(preston_proxy(traces), KEYS, [])
    stage = feature_rows(stage_flag(traces), KEYS, [])
    parts = [signal, general, phase, chamber, context, physics, stage]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
