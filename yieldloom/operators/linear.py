"""Ridge models of all folds and penalties, solved from one table of sums of products."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.operators.imputation import long_values, present
from yieldloom.plans import bounded, group_stats

#: A column whose variance is below this share of its squared mean is constant but for rounding.
CONSTANT = 1e-18


@dataclass(frozen=True)
class Line:
    """A fitted line over filled features and missing indicators, in the order of the features."""

    intercept: float
    weights: np.ndarray
    indicators: np.ndarray
    medians: np.ndarray


class FoldSums:
    """Sums of products per fold over (1, values, missing indicators, response); missing values count as 0.

    Values are shifted by their means over all rows, so that variances lose no digits. A filled feature is its value
    plus the median times its indicator, a linear map: sums of any training set and any medians follow from the stored ones,
    and the sums of a training set are the totals less those of the folds left out.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, fold: str):
        self.df = df.filter(present(target).isNotNull())  # other rows teach nothing
        self.features, self.target, self.fold = list(features), target, fold
        columns = [*self.features, target]
        means = self.df.agg(*[F.avg(present(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
        self.shift = np.array([means[f"_{i}"] or 0.0 for i in range(len(columns))])
        self.sums = self._collect()
        if not self.sums:
            raise ValueError("no rows to learn from")
        self.total = sum(self.sums.values())
        self._medians: dict[tuple, np.ndarray] = {}

    def _collect(self) -> dict[int, np.ndarray]:
        p, shift = len(self.features), self.shift
        schema = pa.schema([("fold", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])
        upper = np.triu_indices(2 * p + 2)

        def products(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                folds = batch.column(0).to_numpy(zero_copy_only=False)
                cells = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(p + 1)])
                missing = np.isnan(cells[:, :p])
                cells = np.where(np.isnan(cells), 0.0, cells - shift)
                rows = np.column_stack([np.ones(len(cells)), cells[:, :p], missing, cells[:, p]])
                for k in np.unique(folds):
                    own = rows[folds == k]
                    held[int(k)] = held.get(int(k), 0.0) + own.T @ own
            for k, matrix in held.items():
                n = len(upper[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int64)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(matrix[upper])], schema=schema)

        known = self.df.select(F.col(self.fold).cast("long"), *[present(c).alias(f"_{i}") for i, c in enumerate([*self.features, self.target])])
        parts = known.mapInArrow(products, "fold long, i int, j int, value double").groupBy("fold", "i", "j").agg(F.sum("value").alias("value"))
        out: dict[int, np.ndarray] = {}
        for fold, i, j, value in parts.collect():  # one number per fold and pair of columns, however many rows
            matrix = out.setdefault(fold, np.zeros((2 * p + 2, 2 * p + 2)))
            matrix[i, j] = matrix[j, i] = value
        return out

    def training(self, out: Iterable[int] = ()) -> np.ndarray:
        return self.total - sum((self.sums[k] for k in out), np.zeros_like(self.total))

    def learn_medians(self, left_out: Sequence[tuple[int, ...]]) -> None:
        """Medians of the rows outside each of these sets of folds, of features that have missing values at all."""
        p = len(self.features)
        gaps = [i for i in range(p) if self.total[0, 1 + p + i] > 0]
        left_out = [s for s in left_out if s not in self._medians]
        for s in left_out:
            self._medians[s] = self.shift[:p].copy()
        if not gaps or not left_out:
            return
        sets = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(k) for k in s]).cast("array<long>").alias("folds")) for n, s in enumerate(left_out)]))
        rows = long_values(self.df.withColumn("_fold", F.col(self.fold).cast("long")), [self.features[i] for i in gaps], ["_fold"])
        rows = rows.select("*", sets.alias("_set")).filter(~F.array_contains("_set.folds", F.col("_fold")))
        found = group_stats(rows.select(F.col("_set.n").alias("set"), "feature", "value"), ["set", "feature"], "value", [], {"median": 0.5})
        for row in found.collect():  # one number per set and feature
            self._medians[left_out[row["set"]]][gaps[row["feature"]]] = row["median"]

    def filled(self, sums: np.ndarray, medians: np.ndarray) -> np.ndarray:
        """Sums over (1, filled features, indicators, response) from sums with missing values as 0."""
        p = len(self.features)
        change = np.eye(2 * p + 2)
        change[np.arange(1, p + 1), np.arange(p + 1, 2 * p + 1)] = medians - self.shift[:p]
        return change @ sums @ change.T

    def fit(self, penalties: Sequence[float], out: tuple[int, ...] = (), select: int | None = None) -> list[Line]:
        """A line for each penalty from all rows outside the folds ``out``.

        Features without a value there, constant columns and, with ``select``, all but the columns of the highest
        correlation get no weight. The penalty is that of Spark's linear regression: on standardised columns and response.
        """
        p = len(self.features)
        self.learn_medians([out])
        medians, sums = self._medians[out], self.training(out)
        n = sums[0, 0]
        if n < 1:
            raise ValueError("no rows to learn from")
        whole = self.filled(sums, medians)
        mean = whole[0] / n
        spread = whole / n - np.outer(mean, mean)
        variance = np.maximum(np.diag(spread), 0.0)
        size = np.r_[0.0, self.shift[:p] ** 2, np.ones(p), self.shift[p] ** 2]
        used = [c for c in range(1, 2 * p + 1) if variance[c] > CONSTANT * (1 + size[c]) and sums[0, 1 + p + (c - 1) % p] < n]
        y = 2 * p + 1
        deviation = np.sqrt(variance)
        lines, average = [], mean[y] + self.shift[p]
        flat = variance[y] <= CONSTANT * (1 + size[y])
        if used and not flat:
            link = spread[used, y] / (deviation[used] * deviation[y])
            if select and select < len(used):
                kept = sorted(np.argsort(-np.abs(link), kind="stable")[:select])
                used, link = [used[c] for c in kept], link[kept]
            matrix = spread[np.ix_(used, used)] / np.outer(deviation[used], deviation[used])
        for penalty in penalties:
            weights = np.zeros(2 * p + 2)
            if used and not flat:
                ridge = matrix + penalty / deviation[y] * np.eye(len(used))
                solved = np.linalg.solve(ridge, link) if penalty > 0 else np.linalg.lstsq(ridge, link, rcond=None)[0]
                weights[used] = solved * deviation[y] / deviation[used]
            centre = mean[1 : p + 1] + self.shift[:p]
            intercept = average - weights[1 : p + 1] @ centre - weights[p + 1 : y] @ mean[p + 1 : y]
            lines.append(Line(float(intercept), weights[1 : p + 1], weights[p + 1 : y], medians))
        return lines

    def held_out_r2(self, line: Line, fold: int) -> float | None:
        """r2 of a line on one fold, from that fold's sums alone; None when its response doesn't vary."""
        p = len(self.features)
        whole = self.filled(self.sums[fold], line.medians)
        # The error is a linear form of the columns: response less intercept less weighted features.
        form = np.r_[self.shift[p] - line.intercept - line.weights @ self.shift[:p], -line.weights, -line.indicators, 1.0]
        n, y = whole[0, 0], 2 * p + 1
        total = whole[y, y] - whole[0, y] ** 2 / n
        return 1.0 - float(form @ whole @ form) / total if total > 0 else None


def predicted(df: DataFrame, lines: Mapping[int, Line], features: Sequence[str], fold: str = "fold", name: str = "predicted") -> DataFrame:
    """Adds the prediction of the line of each row's fold; rows of other folds are left out."""
    rows = [(k, line.intercept, [*map(float, line.weights), *map(float, line.indicators)], [*map(float, line.medians)]) for k, line in lines.items()]
    table = df.sparkSession.createDataFrame(rows, "_fold long, _intercept double, _weights array<double>, _medians array<double>")
    joined = df.join(bounded(table, len(rows)), F.col(fold).cast("long") == F.col("_fold"))
    cells = F.array(*[F.coalesce(present(f), F.col("_medians")[i]) for i, f in enumerate(features)], *[present(f).isNull().cast("double") for f in features])
    shares = F.zip_with(cells, F.col("_weights"), lambda x, w: x * w)
    value = F.aggregate(shares, F.col("_intercept"), lambda total, x: total + x)
    return joined.withColumn(name, value).drop("_fold", "_intercept", "_weights", "_medians")


def ridge_ledger(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, penalties: Mapping[str, float], *, fold: str = "fold", select: int | None = None) -> DataFrame:
    """(keys, fold, model, actual, predicted): each row predicted by ridge models that never saw its fold.

    The table is read for the means, the sums of products and the predictions; no model is fitted to rows. The same
    as fitting imputation, variance filter, selection and ridge regression to each fold's training rows. Rows without
    a response teach nothing and are predicted; rows without a fold are left out.
    """
    df = df.filter(F.col(fold).isNotNull())
    sums = FoldSums(df, features, target, fold)
    folds = sorted(sums.sums)
    sums.learn_medians([(k,) for k in folds])
    fitted = {k: sums.fit(list(penalties.values()), (k,), select) for k in folds}
    parts = None
    for n, name in enumerate(penalties):
        out = predicted(df, {k: fitted[k][n] for k in folds}, features, fold)
        out = out.select(*keys, F.col(fold).alias("fold"), F.lit(name).alias("model"), F.col(target).cast("double").alias("actual"), "predicted")
        parts = out if parts is None else parts.unionByName(out)
    return parts


def ridge_tuning(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, penalties: Sequence[float], *, fold: str = "fold", select: int | None = None) -> DataFrame:
    """(keys, fold, params, actual, predicted): for each outer fold the penalty of the best mean r2 over the other folds.

    Inner training sets are totals less two folds and inner scores come from the held-out fold's sums, so the search
    reads no row.
    """
    sums = FoldSums(df, features, target, fold)
    folds = sorted(sums.sums)
    sums.learn_medians([(k,) for k in folds] + [tuple(sorted((k, j))) for k in folds for j in folds if j < k])
    parts = None
    for k in folds:
        scores = []
        for j in folds:
            if j != k:
                scores.append([sums.held_out_r2(line, j) for line in sums.fit(penalties, tuple(sorted((j, k))), select)])
        means = [np.mean([s[i] for s in scores if s[i] is not None] or [-np.inf]) for i in range(len(penalties))]
        best = penalties[int(np.argmax(means))]  # the first wins ties
        line = sums.fit([best], (k,), select)[0]
        out = predicted(df.filter(F.col(fold) == k), {k: line}, features, fold).select(
            *keys, F.col(fold).alias("fold"), F.lit(f"regParam={best}").alias("params"), F.col(target).cast("double").alias("actual"), "predicted"
        )
        parts = out if parts is None else parts.unionByName(out)
    return parts
