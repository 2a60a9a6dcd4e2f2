"""Median imputation as a pipeline stage that is fitted without gathering a column and can be saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.plans import find_hot, group_stats


def present(column: str) -> Column:
    """The value as a double; NaN counts as missing."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value): one row per observed value, ``feature`` being the column's position."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), present(c).alias("value")) for i, c in enumerate(columns)]))
    return df.select(*keep, cells.alias("_cell")).select(*keep, "_cell.feature", "_cell.value").filter("value IS NOT NULL")


def column_medians(df: DataFrame, columns: Sequence[str], hot_rows: int | None = None) -> list[float | None]:
    """Exact medians (the mean of the middle two of an even number); None for a column without values.

    Values are counted before they meet and a long column is cut into brackets, so no task and not the driver holds a column:
    one row per column is collected.
    """
    cells = long_values(df, columns)
    if find_hot(cells, ["feature"], hot_rows):
        found = group_stats(cells, ["feature"], "value", [], {"median": 0.5}, hot_rows=hot_rows)
    else:
        counted = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
        found = counted.groupBy("feature").agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias("median"))
    by_place = {row["feature"]: row["median"] for row in found.collect()}
    return [by_place.get(i) for i in range(len(columns))]


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the median of each input column; the model fills missing values with it."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianModel:
        names = self.getInputCols()
        medians = column_medians(dataset, names)
        empty = [n for n, m in zip(names, medians) if m is None]
        if empty:
            raise ValueError(f"no median of columns without values: {empty}")
        return self._copyValues(MedianModel(medians=medians))


class MedianModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values of the input columns with the stored medians."""

    medians = Param(Params._dummy(), "medians", "median of each input column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, medians: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))
        return dataset.withColumns({out: F.coalesce(present(name), F.lit(m)) for name, out, m in filled})
