"""Run-to-failure lane: failure cycles, causal samples and rolling health features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.plans import HotKeys, find_hot, nearby_rows, row_index, running_totals

# Health signals with lag and rolling features.
HEALTH_SIGNALS = (
    "IONGAUGEPRESSURE", "ETCHBEAMVOLTAGE", "ETCHBEAMCURRENT", "ETCHSUPPRESSORVOLTAGE", "ETCHSUPPRESSORCURRENT",
    "FLOWCOOLFLOWRATE", "FLOWCOOLPRESSURE", "ETCHGASCHANNEL1READBACK", "ETCHPBNGASREADBACK", "ACTUALROTATIONANGLE",
    "ETCHSOURCEUSAGE", "ETCHAUXSOURCETIMER", "ETCHAUX2SOURCETIMER", "ACTUALSTEPDURATION",
)


def failure_cycle_ids(df: DataFrame, keys: Sequence[str] = ("Tool",), order: Sequence[str] = ("time",), *, label: str = "ttf", name: str = "cycle", hot: HotKeys | None = None, hot_rows: int | None = None) -> DataFrame:
    """Counts label increases so far; a missing label keeps the current number."""
    hot = find_hot(df, keys, hot_rows) if hot is None else hot
    reset = lambda w: {"_reset": (F.col(label) > F.lag(label).over(w)).cast("int")}
    marked = nearby_rows(df, keys, order, reset, back=1, hot=hot)
    out = running_totals(marked, keys, order, {name: F.coalesce(F.col("_reset"), F.lit(0))}, hot=hot)
    return out.withColumn(name, F.col(name).cast("int")).drop("_reset")


def stride_sample(df: DataFrame, keys: Sequence[str] = ("Tool",), order: Sequence[str] = ("time",), *, labels: Sequence[str] = ("ttf",), stride: int = 100, hot_rows: int | None = None) -> DataFrame:
    """Every stride-th row, every row that starts a new failure cycle and every row at label zero."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    hot = find_hot(df, keys, hot_rows)
    placed = row_index(df, keys, order, name="_pos", hot=hot)
    resets = lambda w: {f"_r{i}": F.col(c) > F.lag(c).over(w) for i, c in enumerate(labels)}
    marked = nearby_rows(placed, keys, order, resets, back=1, hot=hot)
    keep = (F.col("_pos") - 1) % stride == 0
    for i, c in enumerate(labels):
        keep = keep | F.coalesce(F.col(f"_r{i}"), F.lit(False)) | F.coalesce(F.col(c) == 0, F.lit(False))
    return marked.filter(keep).select(*df.columns)


def lag_difference(df: DataFrame, keys: Sequence[str] = ("Tool",), order: Sequence[str] = ("time",), *, signals: Sequence[str] = HEALTH_SIGNALS, lags: Sequence[int] = (1, 5), time: str | None = None, hot: HotKeys | None = None, hot_rows: int | None = None) -> DataFrame:
    """x minus its value k rows earlier; with ``time`` also the time since the previous row, 0 at the start."""

    def build(w):
        out = {f"{s}__diff_{k}": F.col(s) - F.lag(s, k).over(w) for k in lags for s in signals}
        if time:
            out["time_since_previous"] = F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0)).cast("double")
        return out

    return nearby_rows(df, keys, order, build, back=max(lags), hot=hot, hot_rows=hot_rows)


def rolling_stats(df: DataFrame, keys: Sequence[str] = ("Tool",), order: Sequence[str] = ("time",), *, signals: Sequence[str] = HEALTH_SIGNALS, windows: Sequence[int] = (5, 25), hot: HotKeys | None = None, hot_rows: int | None = None) -> DataFrame:
    """Mean and standard deviation over the last n rows; a missing deviation counts as 0."""

    def build(w):
        out: dict[str, Column] = {}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            for s in signals:
                out[f"{s}__mean_{n}"] = F.avg(s).over(frame)
                out[f"{s}__std_{n}"] = F.coalesce(F.stddev_samp(s).over(frame), F.lit(0.0))
        return out

    return nearby_rows(df, keys, order, build, back=max(windows) - 1, hot=hot, hot_rows=hot_rows)


def one_hot(df: DataFrame, columns: Sequence[str], values: dict[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per listed category value."""
    flags = [
        F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"category__{c}_{v}")
        for c in columns
        for v in values[c]
    ]
    return df.select("*", *flags)


def even_sample(df: DataFrame, order: Sequence[str], maximum: int, hot_rows: int | None = None) -> DataFrame:
    """``maximum`` rows evenly spaced by position (all rows when there are not more).

    Position i * (n - 1) / (maximum - 1) of the sorted rows is kept, rounded down;
    a row is kept when some i maps to it, which its own position decides.
    """
    placed = row_index(df, [], order, name="_pos", hot_rows=hot_rows)
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.crossJoin(F.broadcast(size))  # one row
    p, n = F.col("_pos") - 1, F.col("_n")
    if maximum < 2:
        return joined.filter((n <= maximum) | (p < maximum)).select(*df.columns)
    step = (n - 1) / F.lit(float(maximum - 1))
    i = F.ceil(p / step)
    at = lambda k: F.when(k >= maximum - 1, n - 1).otherwise(F.floor(k * step))
    picked = (at(i) == p) | (at(i - 1) == p)
    return joined.filter((n <= maximum) | picked).select(*df.columns)


def expanding_splits(df: DataFrame, cycle: str = "cycle") -> DataFrame:
    """(split, test_cycle): each split trains on earlier cycles and tests the next one.

    The first test comes after three cycles when there are at least five, else after one.
    """
    cycles = df.select(cycle).distinct()
    placed = row_index(cycles, [], [cycle], name="_pos")
    total = cycles.agg(F.count(F.lit(1)).alias("_n"))
    start = F.when(F.col("_n") >= 5, 3).otherwise(1)
    out = placed.crossJoin(F.broadcast(total)).filter(F.col("_pos") > start)  # one row
    return out.select((F.col("_pos") - start).cast("int").alias("split"), F.col(cycle).alias("test_cycle"))
