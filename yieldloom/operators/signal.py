"""Signal features of bounded traces: a trace has one reading per index, at most ``samples`` of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("wafer", "sensor")
LAGS = (1, 2, 4, 8, 16, 32)
BANDS = ((1, 3), (3, 6), (6, 11), (11, 21), (21, 41), (41, None))


def distribution_stats(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Population moments, seven quantiles and RMS of each trace."""
    v = F.col(value)
    probs = {"median": 0.5, "q01": 0.01, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    flat = F.stddev_pop(v) <= 1e-12
    out = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.array(*[F.lit(p) for p in probs.values()])).alias("_q"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.when(flat, 0.0).otherwise(F.skewness(v)).alias("skew"),
        F.when(flat, -3.0).otherwise(F.kurtosis(v)).alias("kurtosis"),
    )
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)]).drop("_q")


def position_stats(df: DataFrame, keys: Sequence[str] = KEYS, index: str = "ts_idx", value: str = "value") -> DataFrame:
    """first, last, delta, relative positions of the extremes and the mean-crossing rate."""
    w = Window.partitionBy(*keys).orderBy(index)
    v = F.col(value)
    placed = df.select(
        *keys, index, value, (F.row_number().over(w) - 1).alias("_p"), F.lag(value).over(w).alias("_before"),
        F.avg(value).over(Window.partitionBy(*keys)).alias("_mean"),
    )
    crossed = ((v - F.col("_mean")) * (F.col("_before") - F.col("_mean")) < 0).cast("double")
    n = F.count(F.lit(1))
    # The first of equal extremes counts, as the smallest position.
    out = placed.groupBy(*keys).agg(
        F.min_by(value, index).alias("first"), F.max_by(value, index).alias("last"),
        F.min_by("_p", F.struct(v, F.col("_p"))).alias("_argmin"), F.max_by("_p", F.struct(v, -F.col("_p"))).alias("_argmax"),
        F.coalesce(F.avg(crossed), F.lit(0.0)).alias("mean_crossing_rate"), n.alias("_n"),
    )
    last = F.nullif(F.col("_n") - 1, F.lit(0))
    return out.select(
        *keys, "first", "last", (F.col("last") - F.col("first")).alias("delta"),
        (F.col("_argmin") / last).alias("argmin"), (F.col("_argmax") / last).alias("argmax"), "mean_crossing_rate",
    )


def difference_stats(df: DataFrame, keys: Sequence[str] = KEYS, index: str = "ts_idx", value: str = "value") -> DataFrame:
    """Mean, population std, mean and max absolute step between successive readings."""
    w = Window.partitionBy(*keys).orderBy(index)
    steps = df.select(*keys, (F.col(value) - F.lag(value).over(w)).alias("_d"))
    return steps.groupBy(*keys).agg(
        F.avg("_d").alias("diff_mean"), F.stddev_pop("_d").alias("diff_std"),
        F.avg(F.abs("_d")).alias("diff_abs_mean"), F.max(F.abs("_d")).alias("diff_abs_max"),
    )


def autocorrelation(df: DataFrame, keys: Sequence[str] = KEYS, index: str = "ts_idx", value: str = "value", lags: Sequence[int] = LAGS) -> DataFrame:
    """Correlation with the trace shifted by k rows, centred on the full mean; 0 without spread."""
    w = Window.partitionBy(*keys).orderBy(index)
    centred = df.select(*keys, index, (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).alias("_c"))
    shifted = centred.select("*", *[F.lead("_c", k).over(w).alias(f"_s{k}") for k in lags])
    columns = []
    for k in lags:
        x, y = F.when(F.col(f"_s{k}").isNotNull(), F.col("_c")), F.col(f"_s{k}")
        bottom = F.sqrt(F.sum(x * x) * F.sum(y * y))
        columns.append(F.coalesce(F.when(bottom > 1e-12, F.sum(x * y) / F.when(bottom > 1e-12, bottom)), F.lit(0.0)).alias(f"autocorr_lag_{k}"))
    return shifted.groupBy(*keys).agg(*columns)


def window_stats(df: DataFrame, keys: Sequence[str] = KEYS, index: str = "ts_idx", value: str = "value", windows: int = 16) -> DataFrame:
    """Mean and population std in equal windows, long form; the first n mod windows get one row more."""
    w = Window.partitionBy(*keys).orderBy(index)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = df.select(*keys, value, (F.row_number().over(w) - 1).alias("_p"), n.alias("_n"))
    base, extra = F.floor(F.col("_n") / windows), F.col("_n") % windows
    large = extra * (base + 1)
    number = F.when(F.col("_p") < large, F.floor(F.col("_p") / (base + 1))).otherwise(
        extra + F.floor((F.col("_p") - large) / F.greatest(base, F.lit(1)))
    )
    out = placed.withColumn("window", (number + 1).cast("int"))
    return out.groupBy(*keys, "window").agg(F.avg(value).alias("window_mean"), F.stddev_pop(value).alias("window_std"))


def sensor_correlation(df: DataFrame, sensors: Sequence[str], wafer: Sequence[str] = ("wafer",), *, sensor: str = "sensor", index: str = "ts_idx", value: str = "value") -> DataFrame:
    """Pearson r of every pair of the listed sensors within a wafer, 0 without spread.

    Sensors become columns first, so pairs are formed inside an aggregate and no pair rows are shuffled.
    """
    wide = df.groupBy(*wafer, index).pivot(sensor, list(sensors)).agg(F.avg(value))
    columns, names = [], []
    for i, a in enumerate(sensors):
        for b in sensors[i + 1 :]:
            both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
            x, y = F.when(both, F.col(f"`{a}`")), F.when(both, F.col(f"`{b}`"))
            spread = F.stddev_pop(x) * F.stddev_pop(y)
            columns.append(F.coalesce(F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread)), F.lit(0.0)).alias(f"_r{len(names)}"))
            names.append((a, b))
    one = wide.groupBy(*wafer).agg(*columns)
    pairs = F.array(
        *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(names)]
    )
    return one.select(*wafer, F.explode(pairs).alias("_p")).select(*wafer, F.col("_p.left").alias("sensor_a"), F.col("_p.right").alias("sensor_b"), F.col("_p.r").alias("correlation"))


def _spectra(values: np.ndarray) -> np.ndarray:
    """Power features of traces of one length (rows) around their means; shares are 0 without power."""
    power = np.abs(np.fft.rfft(values - values.mean(axis=1, keepdims=True), axis=1)) ** 2
    power[:, 0] = 0.0
    total = power.sum(axis=1)
    share = np.where(total[:, None] > 1e-12, power / np.where(total > 1e-12, total, 1.0)[:, None], 0.0)
    entropy = -np.sum(np.where(share > 0, share * np.log(share + 1e-12), 0.0), axis=1)
    bands = [share[:, a:b].sum(axis=1) for a, b in BANDS]
    return np.stack([np.log1p(total), share @ np.arange(power.shape[1]), share.argmax(axis=1), entropy, *bands], axis=1)


SPECTRAL = ("total_power", "centroid", "dominant_frequency", "entropy", *[f"band_{i}" for i in range(1, 7)])


def spectral_features(arrays: DataFrame, keys: Sequence[str] = KEYS, readings: str = "readings") -> DataFrame:
    """Spectral power features of each reading array (gaps must be filled before)."""
    fields = ", ".join(f"spectral_{n} double" for n in SPECTRAL)

    @F.pandas_udf(fields)
    def spectrum(column: pd.Series) -> pd.DataFrame:
        out, sizes = np.zeros((len(column), len(SPECTRAL))), np.array([len(v) for v in column])
        for n in np.unique(sizes):  # one transform for all traces of a length
            some = np.flatnonzero(sizes == n)
            out[some] = _spectra(np.stack([np.asarray(column.iloc[k], dtype=float) for k in some]))
        return pd.DataFrame(out, columns=[f"spectral_{n}" for n in SPECTRAL])

    return arrays.withColumn("_s", spectrum(readings)).select(*keys, "_s.*")


def _standardised(values: np.ndarray) -> np.ndarray:
    spread = values.std()
    return (values - values.mean()) / (spread if spread > 1e-10 else 1.0)


def _resampled(values, points: int, normalise: bool):
    vector = np.array([np.nan if v is None else v for v in values], dtype=float)
    known = np.isfinite(vector)
    if not known.any():
        return None
    source = np.linspace(0.0, 1.0, len(vector))
    filled = np.interp(source, source[known], vector[known])
    out = np.interp(np.linspace(0.0, 1.0, points), source, filled)
    return _standardised(out) if normalise else out


def interpolate_waveform(arrays: DataFrame, points: int = 256, *, readings: str = "readings", normalise: bool = False) -> DataFrame:
    """Gaps filled linearly and the trace resampled to ``points`` values; NULL when nothing was read."""

    @F.pandas_udf("array<double>")
    def resample(column: pd.Series) -> pd.Series:
        return column.map(lambda v: _resampled(v, points, normalise))

    return arrays.withColumn("waveform", resample(readings))


def resample_trace(df: DataFrame, keys: Sequence[str] = KEYS, points: int = 256, *, time: str = "t", value: str = "value") -> DataFrame:
    """(keys, waveform): values at ``points`` even times over each channel's own time range, linear between readings.

    Readings without time or value are left out and equal times averaged; a channel with one time keeps its value.
    """
    known = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col("_v").alias("v"))))
    traces = known.groupBy(*keys).agg(pairs.alias("_pairs"))

    @F.pandas_udf("array<double>")
    def resample(times: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([np.interp(np.linspace(t[0], t[-1], points), t, v) for t, v in zip(times, values)], dtype=object)

    return traces.select(*keys, resample(F.col("_pairs.t"), F.col("_pairs.v")).alias("waveform"))


def normalize_waveform(arrays: DataFrame, column: str = "waveform") -> DataFrame:
    """Z-score of each array with its population std (1 when that is tiny)."""

    @F.pandas_udf("array<double>")
    def standardise(values: pd.Series) -> pd.Series:
        out, sizes = [None] * len(values), np.array([-1 if v is None else len(v) for v in values])
        for n in np.unique(sizes[sizes >= 0]):  # all arrays of a length at once
            some = np.flatnonzero(sizes == n)
            x = np.stack([np.asarray(values.iloc[k], dtype=float) for k in some])
            spread = x.std(axis=1, keepdims=True)
            for k, row in zip(some, (x - x.mean(axis=1, keepdims=True)) / np.where(spread > 1e-10, spread, 1.0)):
                out[k] = row
        return pd.Series(out, dtype=object)

    return arrays.withColumn(column, standardise(column))


def waveform_bank(arrays: DataFrame, keys: Sequence[str] = KEYS, points: int = 64) -> DataFrame:
    """Normalised waveforms of all groups; a basis is fitted to every one of them."""
    shaped = interpolate_waveform(arrays, points, normalise=True).filter("waveform IS NOT NULL")
    return shaped.select(*keys, "waveform")


def waveform_pca(train: DataFrame, apply: DataFrame, components: int, column: str = "waveform") -> DataFrame:
    """Principal scores and reconstruction error of waveforms on a basis learned from ``train`` only."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda df: df.withColumn("_vec", array_to_vector(F.col(column)))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_vec", outputCol="_centred").fit(vec(train))
    basis = PCA(k=components, inputCol="_centred", outputCol="_scores").fit(centre.transform(vec(train)))
    scored = basis.transform(centre.transform(vec(apply)))
    sq = lambda c: F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda s, v: s + v * v)
    # The basis is orthonormal, so the lost energy is the centred energy minus the score energy.
    lost = F.greatest(sq("_centred") - sq("_scores"), F.lit(0.0))
    return scored.select(
        *apply.columns, vector_to_array(F.col("_scores")).alias("scores"), F.sqrt(lost / F.size(column)).alias("reconstruction_rmse")
    )


def signal_features(df: DataFrame, keys: Sequence[str] = KEYS, index: str = "ts_idx", value: str = "value") -> DataFrame:
    """Distribution, position, difference and autocorrelation features joined per trace."""
    parts = [
        distribution_stats(df, keys, value),
        position_stats(df, keys, index, value),
        difference_stats(df, keys, index, value),
        autocorrelation(df, keys, index, value),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys))
    return out
