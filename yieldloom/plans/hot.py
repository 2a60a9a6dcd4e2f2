"""Finding the keys whose rows must not meet in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.session import pin

# Rows of one key that a single task may sort or hold comfortably.
HOT_ROWS = 2_000_000
HOT_ROWS_SETTING = "spark.yieldloom.hotRows"
# Key tables up to this many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``limit`` rows; ``table`` is None when there are none.

    ``groups`` is the number of distinct keys, the checked size of any per-key table.
    """

    keys: tuple[str, ...]
    limit: int
    groups: int
    count: int = 0
    table: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.table is not None


def find_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> HotKeys:
    """One map-side combined count per key decides whether any key needs splitting."""
    limit = int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS))) if limit is None else limit
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    facts = sizes.agg(F.count_if(F.col("_rows") > limit).alias("over"), F.count(F.lit(1)).alias("groups")).first()
    over, groups = facts["over"], facts["groups"]
    if not over:
        return HotKeys(tuple(keys), limit, groups)
    renamed = [F.col(key).alias(f"_hot_{i}") for i, key in enumerate(keys)]
    table = pin(sizes.filter(F.col("_rows") > limit).select(*renamed))
    return HotKeys(tuple(keys), limit, groups, over, table)


def bounded(small: DataFrame, rows: int, hashed: bool = False) -> DataFrame:
    """Broadcast hint only when the row count is known and small; a larger table of unique keys may be hashed in parts."""
    if rows <= BROADCAST_ROWS:
        return F.broadcast(small)
    return small.hint("shuffle_hash") if hashed else small


def measured(small: DataFrame, hashed: bool = False) -> DataFrame:
    """Per-key facts computed once and counted, so the join with the rows can be a checked broadcast."""
    table = pin(small)
    return bounded(table, table.count(), hashed)


def same_keys(left: Sequence[str | Column], right: Sequence[str | Column]) -> Column:
    """Null-safe equality over two key lists."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    pairs = [as_col(a).eqNullSafe(as_col(b)) for a, b in zip(left, right)]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys); together they are all rows."""
    names = [f"_hot_{i}" for i in range(len(hot.keys))]
    table = bounded(hot.table, hot.count)
    on = same_keys(hot.keys, names)
    return df.join(table, on, "left_anti"), df.join(table, on, "left_semi")


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Null-safe join that keeps the left key columns; the right side is broadcast only if ``rows`` allows."""
    renamed = small.select(
        *[F.col(key).alias(f"_r_{key}") for key in keys],
        *[F.col(name) for name in small.columns if name not in keys],
    )
    if rows is not None:
        renamed = bounded(renamed, rows)
    on = same_keys(keys, [f"_r_{key}" for key in keys])
    return df.join(renamed, on, how).drop(*[f"_r_{key}" for key in keys])
