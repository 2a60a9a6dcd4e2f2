"""Sorting, top-k, set operations and sampling of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions.text import natural_sort as natural_key
from yieldloom.functions.text import test_order
from yieldloom.plans import row_index


def order_by_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Total order for output; aggregations never need it."""
    return df.orderBy(*keys)


def natural_sort(df: DataFrame, name: str = "test_id") -> DataFrame:
    """T-numbers by (major, minor), then names with embedded numbers by value."""
    return df.orderBy(test_order(F.col(name)), natural_key(F.col(name)))


def severity_rank(status: Column) -> Column:
    return (
        F.when(status.isin("Major Shift", "Out of Spec"), 0).when(status.isin("Minor Shift", "Marginal"), 1).otherwise(2)
    )


def severity_sort(df: DataFrame, status: str = "psi_status", name: str = "test_id") -> DataFrame:
    return df.orderBy(severity_rank(F.col(status)), name)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The report's k best rows; Spark keeps k rows per task, never a full sort."""
    return df.orderBy(*order).limit(k)


def head_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows of an explicit order, so previews are repeatable."""
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in the given order; each task forwards one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


best_per_group = latest_per_key


def rank_models(results: DataFrame, slice_: Sequence[str] = ("task", "target"), score: str = "r2") -> DataFrame:
    """1..n by score within a slice, ties by name."""
    ranked = row_index(results, slice_, [score, "model"], descending=[score], name="rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def evidence_views(metrics: DataFrame, *, best_by: Sequence[str] = ("feature_set",), score: str = "r2", **filters: str) -> DataFrame:
    """Rows matching the filters, reduced to the best model per feature set."""
    rows = metrics
    for column, wanted in filters.items():
        rows = rows.filter(F.col(column) == wanted)
    return latest_per_key(rows, best_by, F.desc(score), F.asc("model"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_columns(current: DataFrame, history: DataFrame, test: str = "test_id") -> DataFrame:
    return current.select(test).intersect(history.select(test))


def except_keys(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).subtract(present.select(*keys))


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def disjoint_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group is on both sides of a split."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi").isEmpty()


def shared_groups(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups that occur on more than one side of a split."""
    return df.groupBy(group).agg(F.min(side).alias("_a"), F.max(side).alias("_b")).filter("_a <> _b").select(group)


def chronological_holdout(df: DataFrame, campaign: str = "campaign", last: int = 4) -> DataFrame:
    """Adds ``split``: the last n campaigns are the holdout, the rest is development."""
    names = df.select(F.col(campaign).alias("_held")).distinct().orderBy(F.desc("_held")).limit(last)
    marked = df.join(F.broadcast(names), F.col(campaign) == F.col("_held"), "left")  # at most `last` rows
    return marked.withColumn("split", F.when(F.col("_held").isNull(), "development").otherwise("holdout")).drop("_held")


def align_feature_schema(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the stored feature columns in stored order, absent ones NULL."""
    have = set(df.columns)
    pick = lambda f: F.col(f"`{f}`").cast("double") if f in have else F.lit(None).cast("double")
    return df.select(*keep, *[pick(f).alias(f) for f in features])


def absent_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Stored features the new data lacks."""
    return sorted(set(features) - set(df.columns))


def prefix_columns(features: DataFrame, prefix: str, feature: str = "feature") -> DataFrame:
    return features.withColumn(feature, F.concat(F.lit(prefix), F.col(feature)))


def sanitize_feature_names(names: DataFrame, position: str = "position", name: str = "name") -> DataFrame:
    """Cleaned identifiers; the n-th repetition of a name gets ``__n``."""
    from yieldloom.functions.text import sanitize_name

    cleaned = names.withColumn("clean", sanitize_name(F.col(name)))
    counted = row_index(cleaned, ["clean"], [position], name="_nth")
    return counted.withColumn("_seen", F.col("_nth") - 1).select(
        position, name, F.when(F.col("_seen") > 0, F.concat("clean", F.lit("__"), F.col("_seen"))).otherwise(F.col("clean")).alias("clean")
    )


def metric_summary(results: DataFrame, by: Sequence[str] = ("dataset", "variant"), metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def status_table(products: DataFrame, results: DataFrame, *, product: str = "product", keep: int = 3) -> DataFrame:
    """Best models per product with a flag for r2 above one half; products without models are listed too."""
    w = Window.partitionBy(product).orderBy(F.desc("r2"), "model")
    best = results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    out = products.select(product).distinct().join(best, product, "left")
    flag = F.when(F.col("model").isNull(), "N/A").when(F.col("r2") > 0.5, "Yes").otherwise("No")
    return out.select(product, "rank", "model", "r2", flag.alias("r2_above_half"))


def duration_summary(status: DataFrame) -> DataFrame:
    """Products, first-ranked models, how many are good and their percentage."""
    top = F.col("rank") == 1
    good, models = F.count_if(top & (F.col("r2_above_half") == "Yes")), F.count_if(top)
    return status.agg(
        F.countDistinct("product").alias("products"), models.alias("models"), good.alias("good_models"),
        F.when(models > 0, 100 * good / models).otherwise(0.0).alias("good_percent"),
    )
