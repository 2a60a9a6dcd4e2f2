"""Checks that stop a job early with a readable reason."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input data breaks a documented contract."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    return df


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with one example row when there is any violation."""
    example = violations.take(1)
    if example:
        raise ContractError(f"{message}; for example {example[0].asDict()}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def conflict_keys(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Keys for which any other column holds more than one value (NULL counts as a value)."""
    columns = [c for c in (columns or df.columns) if c not in keys]
    total = F.count(F.lit(1))
    differs = [
        ((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < total))).alias(f"_differs_{c}") for c in columns
    ]
    flags = df.groupBy(*keys).agg(*differs)
    names = F.array_compact(F.array(*[F.when(F.col(f"_differs_{c}"), F.lit(c)) for c in columns]))
    return flags.select(*keys, names.alias("conflicting")).filter(F.size("conflicting") > 0)


def validate_trace_contract(df: DataFrame, required: Sequence[str], keys: Sequence[str] = ("WAFER_ID", "STAGE", "TIMESTAMP"), stages: Sequence[str] = ("A", "B")) -> DataFrame:
    """One row of violation counts; raises at once when columns are missing."""
    require_columns(df, required)
    bad_stage = ~F.coalesce(F.col("STAGE").isin(*stages), F.lit(False))
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_stage).alias("unknown_stage_rows"),
        F.count_if(null_key).alias("null_key_rows"),
    )
