"""Leakage-safe splits: a group is never on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.plans import measured, row_index


def _dealt(df: DataFrame, sizes: DataFrame, group: str, k: int, *order: str) -> DataFrame:
    """Adds ``fold``: groups in falling order are dealt 0..k-1, then k-1..0 and so on.

    Each lap gives every fold one group of about the same size, so folds stay balanced whatever the number of groups,
    and places come from a distributed row index instead of a sequential scan.
    """
    placed = row_index(sizes, [], [*order, group], descending=list(order), name="_pos")
    lap, seat = F.floor((F.col("_pos") - 1) / k), (F.col("_pos") - 1) % k
    table = placed.select(group, F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int").alias("fold"))
    return df.join(measured(table), group)


def group_kfold(df: DataFrame, group: str = "lot", k: int = 5) -> DataFrame:
    """Adds ``fold``: groups by falling size, dealt back and forth (ties by group)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    return _dealt(df, sizes, group, k, "_rows")


def stratified_group_kfold(df: DataFrame, label: str, group: str = "lot", k: int = 5) -> DataFrame:
    """Adds ``fold`` balancing positives first, then sizes; a fold with one class is an error."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), F.sum(label).cast("double").alias("_bad"))
    out = _dealt(df, sizes, group, k, "_bad", "_rows")
    single = out.groupBy("fold").agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a = _b")
    if not single.isEmpty():
        raise ValueError("a fold holds a single class")
    return out


def seeded_md5(seed: int, *columns: str) -> Column:
    """A hash of the columns' texts that any engine can repeat: md5 of ``seed|a|b``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def seeded_number(seed: int, *columns: str) -> Column:
    """The first 15 hexadecimal digits of ``seeded_md5`` as a number."""
    return F.conv(F.substring(seeded_md5(seed, *columns), 1, 15), 16, 10).cast("long")


def group_shuffle_split(df: DataFrame, group: str = "lot", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: a seeded md5 orders the groups, the first share of them is held out."""
    groups = df.select(group).distinct().withColumn("_hash", seeded_md5(seed, group))
    placed = row_index(groups, [], ["_hash", group], name="_pos")
    total = groups.agg(F.ceil(F.count(F.lit(1)) * share).alias("_held"))
    table = placed.crossJoin(F.broadcast(total)).select(group, (F.col("_pos") <= F.col("_held")).alias("is_test"))  # one row
    return df.join(table, group)


def random_split_diagnostic(df: DataFrame, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Row-level folds; they leak groups and only serve as a diagnostic."""
    return df.withColumn("fold", (seeded_number(seed, *key) % k).cast("int"))
