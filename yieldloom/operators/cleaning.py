"""Equipment-trace cleaning: typing, sensor quality, sequence and label checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions import numeric, text
from yieldloom.operators.contracts import conflict_keys, duplicate_keys, require_columns, require_empty

SAMPLES_PER_WAFER = 176


def long_trace(wide: DataFrame, equipment: str, prefix: str = "sensor_") -> DataFrame:
    """Wide text trace to (equipment, lot, wafer, ts_idx, sensor, raw)."""
    require_columns(wide, ["lot", "wafer", "timestamp"])
    sensors = [c for c in wide.columns if c.startswith(prefix)]
    if not sensors:
        require_columns(wide, [prefix + "*"])
    keyed = wide.select(
        F.trim(F.col("lot").cast("string")).alias("lot"),
        F.trim(F.col("wafer").cast("string")).alias("wafer"),
        text.timestamp_index(F.col("timestamp")).alias("ts_idx"),
        *[F.col(s).cast("string").alias(s) for s in sensors],
    )
    long = keyed.unpivot(["lot", "wafer", "ts_idx"], sensors, "sensor", "raw")
    return long.select(F.lit(equipment).alias("equipment"), "*")


def coerce_sensor(long: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds value, recovered and unresolved to raw cells."""
    return long.withColumn("_cell", numeric.coerce_sensor(F.col(raw))).select(
        *long.columns, "_cell.value", "_cell.recovered", "_cell.unresolved"
    )


def sequence_check(df: DataFrame, keys: Sequence[str] = ("lot", "wafer"), index: str = "ts_idx", expected: int = SAMPLES_PER_WAFER) -> DataFrame:
    """Keys whose sample count is not the expected one or whose indices repeat or are missing."""
    per_index = df.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("_n"))
    checked = per_index.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        F.sum(F.col("_n") - 1).alias("duplicate_timestamps"),
        F.coalesce(F.sum(F.when(F.col(index).isNull(), F.col("_n"))), F.lit(0)).alias("unparsed_timestamps"),
    )
    wrong = (F.col("samples") != expected) | (F.col("duplicate_timestamps") > 0) | (F.col("unparsed_timestamps") > 0)
    return checked.filter(wrong)


def sensor_quality(long: DataFrame, *, keys: Sequence[str] = ("equipment", "sensor"), raw: str = "raw", max_invalid_rate: float = 0.01) -> DataFrame:
    """One quality row per sensor.

    Cells are counted per distinct text first, so a sensor with most of the rows
    is spread over its values and each distinct text is parsed once.
    """
    cells = long.groupBy(*keys, raw).agg(F.count(F.lit(1)).alias("_n"))
    typed = coerce_sensor(cells, raw)
    formatted = F.col("recovered") | F.col("unresolved")
    count_of = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("_n"))), F.lit(0))
    per_value = typed.groupBy(*keys, "value").agg(
        F.sum("_n").alias("rows"),
        count_of(formatted).alias("source_formatted_count"),
        count_of(F.col("recovered")).alias("recovered_decimal_count"),
        count_of(F.col("unresolved")).alias("non_numeric_count"),
        count_of(F.col(raw).isNull()).alias("missing_count"),
    )
    sums = ["rows", "source_formatted_count", "recovered_decimal_count", "non_numeric_count", "missing_count"]
    facts = per_value.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("value").alias("numeric_unique"))

    def examples(flag, name):
        ranked = typed.filter(flag).withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), raw))
        )
        top = F.array_sort(F.collect_list(F.struct("_rank", raw)))
        return ranked.filter("_rank <= 5").groupBy(*keys).agg(
            F.array_join(F.transform(top, lambda e: e[raw]), " | ").alias(name)
        )

    out = facts.join(examples(F.col("unresolved"), "examples"), list(keys), "left")
    out = out.join(examples(formatted, "source_format_examples"), list(keys), "left")
    formatted_rate = F.col("source_formatted_count") / F.col("rows")
    dropped = (formatted_rate > max_invalid_rate) | (F.col("numeric_unique") == 0)
    return out.select(
        *keys, *sums, "numeric_unique",
        formatted_rate.alias("source_formatted_rate"),
        (F.col("non_numeric_count") / F.col("rows")).alias("non_numeric_rate"),
        F.when(dropped, "DROPPED").when(F.col("non_numeric_count") > 0, "IMPUTE_IN_MODEL")
        .when(F.col("recovered_decimal_count") > 0, "RECOVERED_SOURCE_FORMAT").otherwise("VALID").alias("status"),
        F.coalesce("examples", F.lit("")).alias("examples"),
        F.coalesce("source_format_examples", F.lit("")).alias("source_format_examples"),
        F.when(formatted_rate > max_invalid_rate, "HIGH_SOURCE_FORMAT_RATE").otherwise("").alias("exclusion_reason"),
    )


def sensor_retention(long: DataFrame, quality: DataFrame, keys: Sequence[str] = ("equipment", "sensor")) -> DataFrame:
    """Rows of sensors that passed the quality rules."""
    kept = quality.filter("status <> 'DROPPED'").select(*keys)
    return long.join(kept, list(keys), "left_semi")


def dedupe_labels(response: DataFrame, threshold: float = 0.75, keys: Sequence[str] = ("lot", "wafer")) -> DataFrame:
    """One label row per key; conflicting duplicates or classes against the threshold are refused."""
    require_columns(response, [*keys, "response", "class"])
    typed = response.select(
        *[F.trim(F.col(k).cast("string")).alias(k) for k in keys],
        numeric.to_number(F.col("response").cast("string")).alias("response"),
        F.lower(F.trim("class")).alias("class"),
    )
    require_empty(typed.filter("response IS NULL"), "missing or non-numeric response values")
    require_empty(conflict_keys(typed, keys), "conflicting duplicate response labels")
    labels = typed.dropDuplicates(list(keys))
    expected = F.when(F.col("response") > threshold, "bad").otherwise("good")
    require_empty(labels.filter(F.col("class") != expected), f"labels disagree with the threshold {threshold}")
    return labels


def label_summary(response: DataFrame, keys: Sequence[str] = ("lot", "wafer")) -> DataFrame:
    """Row, key and duplicate counts before labels are reduced to one per key."""
    rows = response.groupBy(*response.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_key = rows.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct"))
    return per_key.agg(
        F.sum("_rows").alias("raw_response_rows"),
        F.count(F.lit(1)).alias("unique_response_wafers"),
        F.sum(F.col("_rows") - F.col("_distinct")).alias("exact_duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("duplicate_key_rows"),
        F.count_if(F.col("_distinct") > 1).alias("conflicting_keys"),
    )


def duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated rows (or repeated keys) with how often they occur."""
    return duplicate_keys(df, list(keys or df.columns))


def dataset_summary(df: DataFrame, *, lot: str = "lot", wafer: str = "wafer", bad: str = "bad") -> DataFrame:
    """Rows, lots, wafers, class counts, single-class lots and bad rate in one row."""
    per_wafer = df.groupBy(lot, wafer).agg(F.count(F.lit(1)).alias("_rows"), F.sum(bad).alias("_bad"))
    per_lot = per_wafer.groupBy(lot).agg(
        F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_wafers"), F.sum("_bad").alias("_bad")
    )
    mixed = (F.col("_bad") > 0) & (F.col("_bad") < F.col("_rows"))
    return per_lot.agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("lots"),
        F.sum("_wafers").alias("wafers"),
        F.sum(F.col("_rows") - F.col("_bad")).alias("good"),
        F.sum("_bad").alias("bad"),
        F.count_if(~mixed).alias("single_class_lots"),
        (F.sum("_bad") / F.sum("_rows")).alias("bad_rate"),
    )


def source_audit(raw: DataFrame, cached: DataFrame, keys: Sequence[str] = ("lot", "wafer"), *, sensor: str = "sensor", index: str = "ts_idx", value: str = "value", cached_mean: str = "mean", tolerance: float = 1e-8) -> DataFrame:
    """Blank keys, index range, and how far cached sensor means are from means of the raw readings."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    means = raw.groupBy(*keys, sensor).agg(F.avg(value).alias("_raw"))
    gaps = means.join(cached.select(*keys, sensor, F.col(cached_mean).alias("_cached")), [*keys, sensor], "full_outer")
    gap = F.abs(F.col("_raw") - F.col("_cached"))
    one_sided = F.col("_raw").isNull() != F.col("_cached").isNull()
    facts = raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank_keys"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    checks = gaps.agg(
        F.count(F.lit(1)).alias("means_compared"), F.count_if(one_sided | (gap > tolerance)).alias("mean_mismatches"), F.max(gap).alias("max_mean_gap")
    )
    return facts.crossJoin(checks)  # one row each


def cleaning_variants(long: DataFrame, keys: Sequence[str] = ("equipment", "lot", "wafer", "sensor"), raw: str = "raw", max_invalid_rate: float = 0.01, **options) -> dict[str, DataFrame]:
    """Temporal features of three cleanings of the same cells, and the per-sensor formatted rates.

    naive reads plain numbers only, recovered also repairs damaged decimals, cleaned further drops
    sensors by the quality rules.
    """
    from yieldloom.operators.traces import temporal_features

    typed = coerce_sensor(long, raw)
    naive = typed.withColumn("value", F.when(~F.col("recovered"), F.col("value")))
    sensor_keys = [k for k in ("equipment", "sensor") if k in long.columns]
    quality = sensor_quality(long, keys=sensor_keys, raw=raw, max_invalid_rate=max_invalid_rate)
    return {
        "naive": temporal_features(naive, keys, **options),
        "recovered": temporal_features(typed, keys, **options),
        "cleaned": temporal_features(sensor_retention(typed, quality, sensor_keys), keys, **options),
        "formatted_rates": quality.select(*sensor_keys, "source_formatted_rate", "status"),
    }
