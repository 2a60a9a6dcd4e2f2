"""Table profiles, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.functions.numeric import inf_to_null, to_number
from yieldloom.plans import group_stats, measured


def _numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def safe_corr(x: Column, y: Column, otherwise: float | None = None) -> Column:
    """Pearson r over rows with both values; ``otherwise`` when a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    r = F.when(spread > 0, F.covar_samp(a, b) / F.when(spread > 0, spread))
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric columns, missing cells and rate, duplicate rows."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing_cells"))
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    repeats = distinct.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    cells = F.col("rows") * len(df.columns)
    return facts.crossJoin(F.broadcast(repeats)).select(  # one row each
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(_numeric_names(df))).alias("numeric_columns"),
        "missing_cells", F.when(cells > 0, F.col("missing_cells") / cells).otherwise(0.0).alias("missing_rate"), "duplicate_rows",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, counts, distinct values and three example values (the smallest) per column.

    Values are counted per (column, value) first, so no column gathers in one task.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    counts = texts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.asc_nulls_last("value")))
    ranked = counts.withColumn("_rank", rank).filter("_rank <= 3 AND value IS NOT NULL")
    examples = ranked.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("_ex"))
    facts = counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("_n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique"),
    )
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return facts.join(examples, "column", "left").select(
        "column", kinds[F.col("column")].alias("source_type"), "non_null", "missing",
        (F.col("missing") / (F.col("missing") + F.col("non_null"))).alias("missing_rate"), "unique",
        F.coalesce(F.array_join("_ex", " | "), F.lit("")).alias("examples"),
    )


def value_counts(df: DataFrame, column: str, k: int = 25) -> DataFrame:
    """The k most frequent values, missing shown as ``(missing)``; ties by value."""
    label = F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))
    return df.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(k)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose every present value is a number (one aggregation)."""
    others = [c for c in df.columns if c not in _numeric_names(df)]
    if not others:
        return list(df.columns)
    checks = [(F.count(to_number(F.col(c).cast("string"))) == F.count(c)).alias(c) for c in others]
    row = df.agg(*checks).first()
    return [c for c in df.columns if c not in others or row[c]]


def analyzable_numeric(df: DataFrame, *, minimum: float = 0.8) -> DataFrame:
    """Mostly numeric, varying columns as doubles (comma read as point), judged on all rows."""
    typed = {
        c: F.col(c).cast("double") if c in _numeric_names(df) else to_number(F.replace(F.trim(F.col(c).cast("string")), F.lit(","), F.lit(".")))
        for c in df.columns
    }
    checks = []
    for c, v in typed.items():
        share = F.count(v) / F.when(F.count(c) > 0, F.count(c))
        checks.append(((share >= (0.0 if c in _numeric_names(df) else minimum)) & (F.min(v) < F.max(v))).alias(c))
    row = df.agg(*checks).first()
    return df.select(*[typed[c].alias(c) for c in df.columns if row[c]])


def sufficiently_observed(features: DataFrame, at_least: int = 20, feature: str = "feature", value: str = "value") -> DataFrame:
    """Long rows of features with enough non-null values."""
    kept = features.groupBy(feature).agg(F.count(value).alias("_n")).filter(F.col("_n") >= at_least)
    return features.join(kept.select(feature), feature, "left_semi")


def share_observed(features: DataFrame, key: Sequence[str], share: float = 0.2, floor: int = 5, feature: str = "feature", value: str = "value") -> DataFrame:
    """Long rows of features seen in at least max(floor, share of all keys)."""
    total = features.select(*key).distinct().agg(F.count(F.lit(1)).alias("_total"))
    kept = features.groupBy(feature).agg(F.count(value).alias("_n")).crossJoin(F.broadcast(total))  # one row
    kept = kept.filter(F.col("_n") >= F.greatest(F.lit(floor), F.col("_total") * share))
    return features.join(kept.select(feature), feature, "left_semi")


def fold_local_observed(features: DataFrame, folds: DataFrame, key: Sequence[str], at_least: int = 20, *, fold: str = "fold", feature: str = "feature", value: str = "value") -> DataFrame:
    """(fold, feature) pairs whose training rows - all other folds - hold enough values.

    Training counts are total minus own, so each row is counted once.
    """
    counts = features.join(folds.select(*key, fold), list(key)).groupBy(feature, fold).agg(F.count(value).alias("_own"))
    total = counts.groupBy(feature).agg(F.sum("_own").alias("_all"))
    grid = total.crossJoin(measured(folds.select(fold).distinct()))
    pairs = grid.join(counts, [feature, fold], "left")
    kept = pairs.withColumn("train_values", F.col("_all") - F.coalesce("_own", F.lit(0)))
    return kept.filter(F.col("train_values") >= at_least).select(fold, feature, "train_values")


def drop_constant(features: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Long rows of features with more than one distinct value."""
    kept = features.groupBy(feature).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a < _b")
    return features.join(kept.select(feature), feature, "left_semi")


def valid_target_rows(df: DataFrame, targets: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Rows with at least one numeric target; missing ones get their target's median, else 0."""
    typed = df.withColumns({t: inf_to_null(F.col(t).try_cast("double")) for t in targets})
    present = typed.filter(F.coalesce(*targets).isNotNull())
    if len(targets) == 1:
        return present
    long = present.select(*targets).unpivot([], list(targets), "_t", "_v")
    medians = group_stats(long, ["_t"], "_v", [], {"_median": 0.5}, hot_rows=hot_rows)
    one = medians.groupBy().agg(*[F.max(F.when(F.col("_t") == t, F.col("_median"))).alias(f"_m_{t}") for t in targets])
    filled = present.crossJoin(F.broadcast(one))  # one row
    return filled.withColumns({t: F.coalesce(t, f"_m_{t}", F.lit(0.0)) for t in targets}).select(*df.columns)


def target_correlations(df: DataFrame, target: str, columns: Sequence[str], k: int = 15) -> DataFrame:
    """Pearson r of each column with the target, the k strongest."""
    one = df.agg(*[safe_corr(F.col(c), F.col(target)).alias(f"_r{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_r{i}").alias("r")) for i, c in enumerate(columns)])
    flat = one.select(F.explode(pairs).alias("e")).select("e.feature", F.col("e.r").alias("pearson_r"))
    return flat.filter("pearson_r IS NOT NULL").orderBy(F.desc(F.abs("pearson_r")), "feature").limit(k)


def correlation_audit(rows: DataFrame, *, feature: str = "feature", value: str = "value", target: str = "response", bad: str = "bad", k: int = 100) -> DataFrame:
    """Pearson r of every feature with the response on all, good and bad rows; the k strongest of each."""
    subsets = F.array(F.lit("all"), F.when(F.col(bad) == 1, "bad").otherwise("good"))
    long = rows.withColumn("subset", F.explode(subsets))
    r = safe_corr(F.col(value), F.col(target), 0.0).alias("pearson_r")
    audit = long.groupBy("subset", feature).agg(r).withColumn("abs_pearson_r", F.abs("pearson_r"))
    w = Window.partitionBy("subset").orderBy(F.desc("abs_pearson_r"), feature)
    return audit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def histogram(df: DataFrame, value: str, bins: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the overall range with count and density per key."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    counts = rows.select(*keys, slot.cast("int").alias("bin"), "_lo", "_hi").groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy(*keys).agg(F.sum("rows").alias("_total"))
    joined = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))  # one row without keys
    return joined.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "rows",
        F.when(width > 0, F.col("rows") / (F.col("_total") * width)).alias("density"),
    )


def central_range(rows: DataFrame, keys: Sequence[str] = ("test_id",), value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """0.5 % to 99.5 % quantiles widened by 5 % of their distance."""
    q = group_stats(rows, keys, value, [], {"_lo": 0.005, "_hi": 0.995}, hot_rows=hot_rows)
    gap = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 0.05
    return q.select(*keys, (F.col("_lo") - gap).alias("low"), (F.col("_hi") + gap).alias("high"))


def target_structure(df: DataFrame, *, lot: str = "lot", target: str = "response", bad: str = "bad") -> DataFrame:
    """Spread of the response and R2 of predicting it by its class mean or its lot mean.

    Both R2 come from group sums: explained = sum(n * (group mean - mean)^2), no row is joined back.
    """
    y = F.col(target).cast("double")
    cells = df.groupBy(lot, bad).agg(
        F.count(y).alias("_n"), F.sum(y).alias("_s"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"), F.min(y).alias("_lo"), F.max(y).alias("_hi")
    )
    overall = cells.agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    joined = cells.crossJoin(F.broadcast(overall))  # one row
    joined = joined.withColumn("_sse", F.col("_n") * (F.col("_v") + F.pow(F.col("_m") - F.col("_mean"), 2)))
    sst = joined.agg(F.sum("_sse").alias("_sst"), F.min("_lo").alias("response_min"), F.max("_hi").alias("response_max"), F.sum("_n").alias("_total"))

    def explained(keys, name):
        g = joined.groupBy(*keys).agg(F.sum("_n").alias("_gn"), F.sum("_s").alias("_gs"), F.first("_mean").alias("_mean"))
        return g.agg(F.sum(F.col("_gn") * F.pow(F.col("_gs") / F.col("_gn") - F.col("_mean"), 2)).alias(name))

    per_class = joined.groupBy(bad).agg(F.sum("_n").alias("_cn"), F.sum("_s").alias("_cs"), F.sum("_sse").alias("_ce"), F.first("_mean").alias("_mean"))
    within = F.col("_ce") - F.col("_cn") * F.pow(F.col("_cs") / F.col("_cn") - F.col("_mean"), 2)
    std = F.sqrt(F.greatest(within, F.lit(0.0)) / F.when(F.col("_cn") > 1, F.col("_cn") - 1))
    classes = per_class.agg(
        F.max(F.when(F.col(bad) == 0, std)).alias("good_response_std"), F.max(F.when(F.col(bad) == 1, std)).alias("bad_response_std"),
        F.sum(F.when(F.col(bad) == 0, F.col("_cn")).otherwise(0)).alias("good_wafers"), F.sum(F.when(F.col(bad) == 1, F.col("_cn")).otherwise(0)).alias("bad_wafers"),
    )
    one = sst.crossJoin(explained([bad], "_by_class")).crossJoin(explained([lot], "_by_lot")).crossJoin(classes)  # one row each
    share = lambda c: F.when(F.col("_sst") > 0, F.col(c) / F.col("_sst"))
    return one.select(
        "response_min", "response_max", F.sqrt(F.col("_sst") / (F.col("_total") - 1)).alias("response_std"),
        share("_by_class").alias("class_mean_oracle_r2"), share("_by_lot").alias("lot_mean_oracle_r2"),
        "good_response_std", "bad_response_std", "good_wafers", "bad_wafers",
    )
