"""Ordered computations (position, running total, lag, rolling frame) over keys of any size.

Ordinary keys use one window. A hot key is cut into consecutive blocks of its
order columns that are written down once, so every attempt of every task sees
the same blocks, and block totals carry results across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from yieldloom.plans.hot import HotKeys, attach, find_hot, split_hot
from yieldloom.session import pin

def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: Sequence[str], hot: HotKeys) -> DataFrame:
    """Hot rows with ``__block`` and the number of rows of the key before it, ``__before``.

    Rows are dealt into ranges of (keys, all order columns), compared as the values themselves, about ``limit`` rows
    each. The cuts come from a sample and are written down with the rows (a checkpoint), so every later read sees the
    same blocks. Rows that are equal in all of these columns stay together.
    """
    parts = max(1, -(-df.count() // hot.limit))
    by_key = [F.col(k).asc() for k in keys]
    dealt = df.repartitionByRange(int(parts), *by_key, *_sort(order, descending))
    cut = pin(dealt.withColumn("__block", F.spark_partition_id().cast("long")))
    sizes = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(upto), F.lit(0))).drop("__size")
    return attach(cut, starts, [*keys, "__block"], rows=int(parts) + hot.count)


def _sort(order: Sequence[str], descending: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]


def _prepare(df, keys, hot, hot_rows):
    base = df if keys else df.withColumn("__group", F.lit(1))
    by = list(keys) or ["__group"]
    return base, by, (find_hot(base, by, hot_rows) if hot is None else hot)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    descending: Sequence[str] = (),
    name: str = "row_index",
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """1-based position of each row within its key."""
    base, by, hot = _prepare(df, keys, hot, hot_rows)
    ordering = _sort(order, descending)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering)).cast("long")
    if not hot:
        return base.withColumn(name, number).drop("__group")
    cold, heavy = split_hot(base, hot)
    cut = _blocks(heavy, by, order, descending, hot)
    inside = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(*ordering))
    numbered = cut.withColumn(name, (F.col("__before") + inside).cast("long")).drop("__block", "__before")
    return cold.withColumn(name, number).unionByName(numbered).drop("__group")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    *,
    descending: Sequence[str] = (),
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Sum of each measure from the first row of the key up to the current row."""
    base, by, hot = _prepare(df, keys, hot, hot_rows)
    for i, measure in enumerate(totals.values()):
        base = base.withColumn(f"__m{i}", measure)
    ordering = _sort(order, descending)
    frame = Window.partitionBy(*by).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    drop = [f"__m{i}" for i in range(len(totals))]

    def whole(part: DataFrame) -> DataFrame:
        sums = [F.sum(f"__m{i}").over(frame).alias(n) for i, n in enumerate(totals)]
        return part.select("*", *sums).drop(*drop)

    if not hot:
        return whole(base).drop("__group")
    cold, heavy = split_hot(base, hot)
    cut = _blocks(heavy, by, order, descending, hot)
    inner = Window.partitionBy(*by, "__block").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    block_sums = cut.groupBy(*by, "__block").agg(*[F.sum(m).alias(m) for m in drop])
    carried = block_sums.select(
        *by, "__block", *[F.coalesce(F.sum(m).over(prior), F.lit(0)).alias(f"__carry{m}") for m in drop]
    )
    joined = attach(cut, carried, [*by, "__block"])
    sums = [
        (F.col(f"__carry__m{i}") + F.coalesce(F.sum(f"__m{i}").over(inner), F.lit(0))).alias(n)
        for i, n in enumerate(totals)
    ]
    done = joined.select("*", *sums).drop(*drop, *[f"__carry{m}" for m in drop], "__block", "__before")
    return whole(cold).unionByName(done).drop("__group")


def nearby_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Window columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    Blocks of a hot key are given a margin of copied neighbour rows; the copies
    are dropped after the window ran, so each input row comes out exactly once.
    """
    base, by, hot = _prepare(df, keys, hot, hot_rows)

    def apply(part: DataFrame, spec: WindowSpec) -> DataFrame:
        return part.select("*", *[column.alias(n) for n, column in build(spec).items()])

    whole = Window.partitionBy(*by).orderBy(*[F.col(c) for c in order])
    if not hot:
        return apply(base, whole).drop("__group")
    cold, heavy = split_hot(base, hot)
    size = max(hot.limit, back + 1, ahead + 1)
    numbered = row_index(heavy, by, order, name="__pos", hot=hot)
    block = F.floor((F.col("__pos") - 1) / F.lit(size))
    offset = (F.col("__pos") - 1) % F.lit(size)
    homes = [F.struct(block.alias("block"), F.lit(True).alias("own"))]
    if back:
        homes.append(F.when(offset >= size - back, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    if ahead:
        homes.append(F.when(offset < ahead, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))))
    spread = numbered.withColumn("__home", F.explode(F.array_compact(F.array(*homes))))
    spread = spread.withColumn("__block", F.col("__home.block")).withColumn("__own", F.col("__home.own")).drop("__home")
    local = Window.partitionBy(*by, "__block").orderBy("__pos")
    done = apply(spread, local).filter("__own").drop("__own", "__block", "__pos")
    return apply(cold, whole).unionByName(done).drop("__group")
