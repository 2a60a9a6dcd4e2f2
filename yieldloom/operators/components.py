"""Principal axes of wide rows by a randomised range finder, waveform codes on them, and the rule for their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.operators.signal import normalize_waveform
from yieldloom.session import pin

#: Directions sought beyond the wanted ones, most passes over the rows, and the residual (of the largest variance) that ends them.
OVERSAMPLE, PASSES, TOLERANCE = 10, 12, 1e-9
SEED = 7


def component_count(rows: int, most: int = 25) -> int:
    """Principal components for a table of so many rows: seven tenths of them, at most ``most``, at least one."""
    return max(1, min(int(rows * 0.7), most))


@dataclass(frozen=True)
class Basis:
    """Mean, orthonormal axes (points by components), their variances, and the variance of all axes together."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float
    rows: int
    passes: int

    @property
    def explained(self) -> float:
        return float(self.variances.sum() / self.total) if self.total > 0 else 0.0


def _matrix(column: pa.Array, points: int) -> np.ndarray:
    if column.null_count or not (np.diff(column.offsets.to_numpy()) == points).all():
        raise ValueError(f"not all rows have {points} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, points)


def _summed(rows: DataFrame, width: int, run) -> tuple[np.ndarray, np.ndarray]:
    """Adds up what the tasks send, (place, cells) rows; the row of place -1 and the matrix of the others."""
    sent = rows.mapInArrow(run, "place long, cells array<double>")
    added = sent.groupBy("place").agg(F.array(*[F.sum(F.get("cells", F.lit(j))) for j in range(width)]).alias("cells")).orderBy("place").collect()
    return np.array(added[0]["cells"], float), np.array([r["cells"] for r in added[1:]], float)


def _handed(first: Sequence[float], cells: np.ndarray) -> pa.RecordBatch:
    width = cells.shape[1]
    head = np.zeros(width)
    head[: len(first)] = first
    flat = pa.array(np.vstack([head, cells]).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 2, dtype=np.int32) * width), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(cells))), lists], names=["place", "cells"])


def principal_axes(df: DataFrame, column: str, components: int, *, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE) -> Basis:
    """The first ``components`` principal axes of an array column, all of one length; rows without an array are left out.

    Each pass multiplies the covariance with a few seeded directions: tasks add up products of their rows, points by
    directions, and the driver gets that matrix only, so rows may be wide. Passes go on until the axes fit; as many
    directions as points need one pass. Signs: the largest entry of an axis is positive. Fewer axes come back where rows
    vary in fewer directions than wanted; a table without rows is refused.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    head = rows.select(F.size("v").alias("n")).first()
    if head is None:
        raise ValueError("no rows to learn axes from")
    points = head["n"]

    def mean_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((points, 1))
        for batch in batches:
            x = _matrix(batch.column(0), points)
            n, total = n + len(x), total + x.sum(axis=0)[:, None]
        yield _handed([n], total)

    count, sums = _summed(rows, 1, mean_of)
    n = int(count[0])
    mean = sums[:, 0] / n
    width = min(points, components + oversample)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((points, width)))[0]
    done = 0
    while True:

        def product(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            energy, total = 0.0, np.zeros((points, width))
            for batch in batches:
                x = _matrix(batch.column(0), points) - mean
                energy, total = energy + float((x * x).sum()), total + x.T @ (x @ q)
            yield _handed([energy], total)

        energy, z = _summed(rows, width, product)
        z, done = z / n, done + 1
        inner = q.T @ z
        variances, turn = np.linalg.eigh((inner + inner.T) / 2)
        variances, turn = variances[::-1][:components], turn[:, ::-1][:, :components]
        axes = q @ turn
        left = np.linalg.norm(z @ turn - axes * variances, axis=0).max()
        if width == points or done >= passes or left <= tolerance * max(variances[0], 1e-300):
            break
        q = np.linalg.qr(z)[0]
    kept = variances > 1e-12 * max(variances[0], 1e-300)
    kept[0] = True
    axes = axes[:, kept]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Basis(mean, axes * np.where(signs == 0, 1, signs), variances[kept], float(energy[0]) / n, n, done)


def amplitude_stats(column: str) -> dict[str, Column]:
    """Mean, population std, minimum, maximum, last less first value and root mean square of an array; NULL for an empty one."""
    v = F.col(column)
    n = F.nullif(F.size(v), F.lit(0))
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / n
    return {
        "mean": mean, "std": F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n), "min": F.array_min(v), "max": F.array_max(v),
        "change": F.get(v, n - 1) - F.get(v, F.lit(0)), "rms": F.sqrt(total(lambda x: x * x) / n),
    }


def _encoded(df: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray, back: np.ndarray) -> DataFrame:
    points = len(axes)

    @F.pandas_udf("scores array<double>, reconstruction_rmse double")
    def code(values: pd.Series) -> pd.DataFrame:
        scores, errors = [None] * len(values), [None] * len(values)
        known = [i for i, v in enumerate(values) if v is not None]
        if any(len(values.iloc[i]) != points for i in known):
            raise ValueError(f"a waveform has another number of values than the basis, {points}")
        if known:
            x = np.stack([np.asarray(values.iloc[i], float) for i in known]) - mean
            s = x @ axes
            rmse = np.sqrt(((x - s @ back) ** 2).mean(axis=1))
            for i, own, error in zip(known, s, rmse):
                scores[i], errors[i] = own, float(error)
        return pd.DataFrame({"scores": scores, "reconstruction_rmse": errors})

    typed = df.withColumn(column, F.col(column).cast("array<double>"))
    shaped = normalize_waveform(typed.withColumn("_shape", F.col(column)), "_shape").withColumn("_code", code("_shape"))
    return shaped.select(*df.columns, *[c.alias(name) for name, c in amplitude_stats(column).items()], "_code.scores", "_code.reconstruction_rmse")


def waveform_basis(train: DataFrame, components: int, *, external: DataFrame | None = None, column: str = "waveform") -> Basis:
    """Axes of the z-scored waveforms of ``train`` together with an external bank's, z-scored, too."""
    shaped = lambda df: normalize_waveform(df.select(F.col(column).cast("array<double>").alias("waveform")).filter("waveform IS NOT NULL"))
    bank = shaped(train) if external is None else shaped(train).unionByName(shaped(external))
    # Every pass reads the bank: it is built once.
    return principal_axes(pin(bank), "waveform", components)


def encode_waveforms(apply: DataFrame, basis: Basis, column: str = "waveform") -> DataFrame:
    """Six amplitude statistics of each waveform, and scores and reconstruction error of its z-scored form on a basis."""
    return _encoded(apply, column, basis.mean, basis.axes, basis.axes.T)


def project_waveforms(apply: DataFrame, projection: np.ndarray, column: str = "waveform") -> DataFrame:
    """The same on a frozen projection (points by components) that need not be orthonormal; its pseudo-inverse leads back."""
    projection = np.asarray(projection, float)
    return _encoded(apply, column, np.zeros(len(projection)), projection, np.linalg.pinv(projection))


class RuledPCA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """PCA whose number of components follows from the rows it is fitted to (``component_count``) and the vector's size."""

    most = Param(Params._dummy(), "most", "most components", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, most: int = 25):
        super().__init__()
        self._set(**self._input_kwargs)
        if not self.isSet(self.most):
            self._set(most=most)

    def _fit(self, dataset: DataFrame) -> PCAModel:
        first = dataset.select(self.getInputCol()).first()
        if first is None:
            raise ValueError("no rows to learn components from")
        k = min(component_count(dataset.count(), self.getOrDefault(self.most)), len(first[0]))
        return PCA(k=k, inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset)
