"""Exact group statistics whose quantiles never gather a hot group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.plans.hot import HotKeys, attach, find_hot, split_hot
from yieldloom.session import pin

# Sketch accuracy for bracketing a quantile: the kept slice is about 4/ACCURACY of a hot group.
ACCURACY = 100_000


def _plain(df: DataFrame, keys, value, aggs, quantiles, groups: int) -> DataFrame:
    """Built-in aggregates in one hash aggregation; quantiles from counted distinct values.

    Counting (key, value) first keeps repeated readings out of the shuffle and spreads a large
    group over its values; the two small results are joined on the keys.
    """
    probs = F.array(*[F.lit(float(p)) for p in quantiles.values()])
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__weight"))
    chosen = counted.groupBy(*keys).agg(F.percentile(F.col(value), probs, F.col("__weight")).alias("__quantiles"))
    picks = [F.col("__quantiles")[i].alias(name) for i, name in enumerate(quantiles)]
    chosen = chosen.select(*keys, *picks)
    first = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    return attach(first, chosen, keys, "left", rows=groups)


def _bracketed(df: DataFrame, keys, value, quantiles: Mapping[str, float], hot: HotKeys) -> DataFrame:
    """Quantiles of hot groups: sketch a narrow bracket, count around it exactly, sort only inside it."""
    probs = [float(p) for p in quantiles.values()]
    edges = sorted({min(max(p + side * 2.0 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)})
    present = df.filter(F.col(value).isNotNull())
    # The sketch is pinned because both uses below must see the same edges.
    sketch = pin(
        present.groupBy(*keys).agg(
            F.count(value).alias("__n"),
            F.percentile_approx(value, [float(e) for e in edges], ACCURACY).alias("__edges"),
        )
    )
    distinct = present.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    slot = sum(((F.col("__v") > F.col("__edges")[i]).cast("int") for i in range(len(edges))), F.lit(0))
    placed = attach(distinct, sketch, keys, rows=hot.count).withColumn("__slot", slot)

    ranks = [F.floor((F.col("__n") - 1) * F.lit(p)) for p in probs]
    uppers = [F.ceil((F.col("__n") - 1) * F.lit(p)) for p in probs]
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.groupBy(*keys, "__slot").agg(F.sum("__c").alias("__size"), F.first("__n").alias("__n"))
    slots = slots.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    holds = F.lit(False)
    for rank in [*ranks, *uppers]:
        holds = holds | ((rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__size")))
    wanted = slots.filter(holds).select(*keys, "__slot", "__start")
    inside = attach(placed, wanted, [*keys, "__slot"], rows=hot.count * 2 * len(edges))

    order = Window.partitionBy(*keys, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed_rank = inside.withColumn("__upto", F.col("__start") + F.sum("__c").over(order))
    hit = lambda rank: (rank >= F.col("__upto") - F.col("__c")) & (rank < F.col("__upto"))
    picks = []
    for i, (low, high) in enumerate(zip(ranks, uppers)):
        picks.append(F.max(F.when(hit(low), F.col("__v"))).alias(f"__lo{i}"))
        picks.append(F.max(F.when(hit(high), F.col("__v"))).alias(f"__hi{i}"))
    found = placed_rank.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for i, (name, p) in enumerate(zip(quantiles, probs)):
        position = (F.col("__n") - 1) * F.lit(p)
        low, high = F.floor(position), F.ceil(position)
        mixed = (high - position) * F.col(f"__lo{i}") + (position - low) * F.col(f"__hi{i}")
        out.append(F.when(low == high, F.col(f"__lo{i}").cast("double")).otherwise(mixed).alias(name))
    return found.select(*keys, *out)


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    aggs: Sequence[Column],
    quantiles: Mapping[str, float],
    *,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Mergeable aggregates plus exact linear-interpolated quantiles per group.

    Without a hot key this is one aggregation. Otherwise ordinary keys keep that
    plan, and hot keys combine partial aggregates with bracketed selection.
    """
    base = df if keys else df.withColumn("__group", F.lit(1))
    by = list(keys) or ["__group"]
    if not quantiles:
        return base.groupBy(*by).agg(*aggs).drop("__group")
    if hot is None:
        hot = find_hot(base, by, hot_rows)
    if not hot:
        return _plain(base, by, value, aggs, quantiles, hot.groups).drop("__group")
    cold, heavy = split_hot(base, hot)
    ordinary = _plain(cold, by, value, aggs, quantiles, hot.groups)
    chosen = _bracketed(heavy, by, value, quantiles, hot)
    if aggs:
        split = attach(heavy.groupBy(*by).agg(*aggs), chosen, by, "left")
    else:
        split = attach(heavy.select(*by).distinct(), chosen, by, "left")
    return ordinary.unionByName(split.select(ordinary.columns)).drop("__group")
