"""Trace cleaning, temporal, polishing, etch and run-to-failure queries on ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.base import HOUR_TRACE, HOURS, TRACE, hour_trace, query, r, table, trace
from yieldloom.functions import text
from yieldloom.functions.numeric import recover_spreadsheet_decimal
from yieldloom.operators import cleaning, cmp, components, etch, profile, rul, sets, signal, traces

UT = ["user_id", "event_type"]
TO = ["us", "event_id"]

TEMPORAL = f"""WITH {TRACE} SELECT user_id, event_type,
  {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
  {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.75)', 'q75')},
  {r('max(value) - min(value)', 'range')},
  {r('arg_max(value, (us, event_id)) - arg_min(value, (us, event_id))', 'delta')},
  {r('(arg_max(value, (us, event_id)) - arg_min(value, (us, event_id))) / 175', 'slope')},
  {r('avg(value) FILTER (ts_idx <= 58)', 'early_mean')}, {r('avg(value) FILTER (ts_idx > 58 AND ts_idx <= 116)', 'middle_mean')},
  {r('avg(value) FILTER (ts_idx > 116)', 'late_mean')}, {r('1 - count(value) / count(*)', 'missing_rate')}
FROM trace GROUP BY user_id, event_type"""


@query("temporal_features", TEMPORAL)
def temporal_features(spark, folder):
    return traces.temporal_features(trace(spark, folder), UT, order=TO)


@query("sequence_check", f"""WITH {TRACE}, cells AS (SELECT user_id, event_type, ts_idx, count(*) AS n FROM trace GROUP BY ALL)
SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(n - 1) AS BIGINT) AS duplicate_timestamps, CAST(0 AS BIGINT) AS unparsed_timestamps
FROM cells GROUP BY user_id, event_type HAVING sum(n) <> 12 OR sum(n - 1) > 0""")
def sequence_check(spark, folder):
    return cleaning.sequence_check(trace(spark, folder), UT, "ts_idx", expected=12)


RAW = """CASE WHEN event_id % 97 = 0 THEN '01.Sep' WHEN event_id % 89 = 0 THEN 'n/a' WHEN event_id % 83 = 0 THEN NULL
  WHEN event_id % 7 = 0 THEN replace(CAST(value AS VARCHAR), '.', ',') ELSE CAST(value AS VARCHAR) END"""


def raw_cells(spark, folder):
    """Readings as text, some of them damaged the way spreadsheets damage decimals."""
    e, v = F.col("event_id"), F.col("value").cast("string")
    raw = (
        F.when(e % 97 == 0, "01.Sep").when(e % 89 == 0, "n/a").when(e % 83 == 0, F.lit(None).cast("string"))
        .when(e % 7 == 0, F.replace(v, F.lit("."), F.lit(","))).otherwise(v)
    )
    return table(spark, folder, "events").select("event_id", F.lit("e1").alias("equipment"), F.col("event_type").alias("sensor"), raw.alias("raw"))


@query("sensor_quality", f"""WITH cells AS (SELECT event_type AS sensor, {RAW} AS raw FROM events),
typed AS (SELECT sensor, raw, try_cast(raw AS DOUBLE) AS num, CASE WHEN raw = '01.Sep' THEN 1.09 WHEN raw <> 'n/a' THEN try_cast(replace(raw, ',', '.') AS DOUBLE) END AS value FROM cells),
agg AS (SELECT sensor, count(*) AS n, count(*) FILTER (raw IS NOT NULL AND num IS NULL) AS f, count(*) FILTER (raw IS NOT NULL AND num IS NULL AND value IS NOT NULL) AS rec,
  count(*) FILTER (raw IS NOT NULL AND value IS NULL) AS bad, count(*) FILTER (raw IS NULL) AS miss, count(DISTINCT value) AS u FROM typed GROUP BY sensor)
SELECT 'e1' AS equipment, sensor, n AS rows, f AS source_formatted_count, rec AS recovered_decimal_count, bad AS non_numeric_count, miss AS missing_count, u AS numeric_unique,
 {r('f / n', 'source_formatted_rate')}, {r('bad / n', 'non_numeric_rate')},
 CASE WHEN f / n > 0.15 OR u = 0 THEN 'DROPPED' WHEN bad > 0 THEN 'IMPUTE_IN_MODEL' WHEN rec > 0 THEN 'RECOVERED_SOURCE_FORMAT' ELSE 'VALID' END AS status FROM agg""")
def sensor_quality(spark, folder):
    out = cleaning.sensor_quality(raw_cells(spark, folder), max_invalid_rate=0.15)
    return out.drop("examples", "source_format_examples", "exclusion_reason")


@query("sensor_retention", f"""WITH cells AS (SELECT event_id, event_type AS sensor, {RAW} AS raw FROM events),
rate AS (SELECT sensor, count(*) FILTER (raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL) / count(*) AS f FROM cells GROUP BY sensor)
SELECT sensor, count(*) AS rows FROM cells WHERE sensor IN (SELECT sensor FROM rate WHERE f <= 0.16) GROUP BY sensor""")
def sensor_retention(spark, folder):
    cells = raw_cells(spark, folder)
    kept = cleaning.sensor_retention(cells, cleaning.sensor_quality(cells, max_invalid_rate=0.16))
    return kept.groupBy("sensor").agg(F.count(F.lit(1)).alias("rows"))


@query("coerce_sensor", f"""WITH cells AS (SELECT event_id, {RAW} AS raw FROM events),
typed AS (SELECT event_id, raw, try_cast(raw AS DOUBLE) AS num, CASE WHEN raw = '01.Sep' THEN 1.09 WHEN raw <> 'n/a' THEN try_cast(replace(raw, ',', '.') AS DOUBLE) END AS value FROM cells)
SELECT event_id, {r('value', 'value')}, raw IS NOT NULL AND num IS NULL AND value IS NOT NULL AS recovered, raw IS NOT NULL AND value IS NULL AS unresolved FROM typed""")
def coerce_sensor(spark, folder):
    return cleaning.coerce_sensor(raw_cells(spark, folder)).select("event_id", "value", "recovered", "unresolved")


@query("recover_spreadsheet_decimal", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_size % 28 + 1) + 0.09 WHEN 1 THEN 3 + (p_size % 28) / 100.0 WHEN 2 THEN p_size + 0.5 WHEN 3 THEN NULL
  WHEN 4 THEN 12 + (p_size % 28) / 100.0 ELSE p_retailprice END::DOUBLE AS value FROM part""")
def recover_decimal(spark, folder):
    p = table(spark, folder, "part")
    k, s = F.col("p_partkey") % 6, F.col("p_size")
    day = lambda n: F.lpad(n.cast("string"), 2, "0")
    text = (
        F.when(k == 0, F.concat(day(s % 28 + 1), F.lit(".Sep"))).when(k == 1, F.concat(F.lit("Mär."), day(s % 28)))
        .when(k == 2, F.concat(s.cast("string"), F.lit(",5"))).when(k == 3, F.concat(s.cast("string"), F.lit("d")))
        .when(k == 4, F.concat(F.lit("dez."), (s % 28).cast("string"))).otherwise(F.col("p_retailprice").cast("string"))
    )
    return p.select("p_partkey", recover_spreadsheet_decimal(text).alias("value"))


# --- run to failure -----------------------------------------------------------
RUL = f"{TRACE}, w AS (SELECT *, row_number() OVER o AS rn, lag(value) OVER o AS before, lag(value, 5) OVER o AS before5, lag(us) OVER o AS us_before FROM trace WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))"


@query("lag_difference", f"""WITH {RUL} SELECT event_id, {r('value - before', 'value__diff_1')}, {r('value - before5', 'value__diff_5')}, CAST(coalesce(us - us_before, 0) AS DOUBLE) AS time_since_previous FROM w""")
def lag_difference(spark, folder):
    out = rul.lag_difference(trace(spark, folder), ["user_id"], TO, signals=["value"], time="us")
    return out.select("event_id", "value__diff_1", "value__diff_5", "time_since_previous")


@query("rolling_stats", f"""WITH {TRACE} SELECT event_id, {r('avg(value) OVER a', 'value__mean_5')}, {r('coalesce(stddev_samp(value) OVER a, 0)', 'value__std_5')},
 {r('avg(value) OVER b', 'value__mean_25')}, {r('coalesce(stddev_samp(value) OVER b, 0)', 'value__std_25')} FROM trace
 WINDOW a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, folder):
    out = rul.rolling_stats(trace(spark, folder), ["user_id"], TO, signals=["value"])
    return out.select("event_id", "value__mean_5", "value__std_5", "value__mean_25", "value__std_25")


@query("failure_cycle_ids", f"""WITH {RUL} SELECT event_id, CAST(coalesce(sum(CASE WHEN value > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS cycle FROM w""")
def failure_cycle_ids(spark, folder):
    return rul.failure_cycle_ids(trace(spark, folder), ["user_id"], TO, label="value").select("event_id", "cycle")


@query("stride_sample", f"""WITH {RUL} SELECT event_id FROM w WHERE (rn - 1) % 10 = 0 OR value > before OR value = 0""")
def stride_sample(spark, folder):
    return rul.stride_sample(trace(spark, folder), ["user_id"], TO, labels=["value"], stride=10).select("event_id")


@query("even_sample", f"""WITH {TRACE}, p AS (SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS p, count(*) OVER () AS n FROM trace),
idx AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 199.0) AS BIGINT) AS p FROM range(0, 200) AS g(i), (SELECT count(*) AS n FROM trace))
SELECT event_id FROM p JOIN idx USING (p)""")
def even_sample(spark, folder):
    return rul.even_sample(trace(spark, folder), TO, 200).select("event_id")


@query("expanding_splits", f"""WITH {TRACE}, c AS (SELECT DISTINCT CAST(us // 259200000000 AS BIGINT) AS cycle FROM trace), p AS (SELECT cycle, row_number() OVER (ORDER BY cycle) AS pos, count(*) OVER () AS n FROM c)
SELECT CAST(pos - CASE WHEN n >= 5 THEN 3 ELSE 1 END AS INTEGER) AS split, cycle AS test_cycle FROM p WHERE pos > CASE WHEN n >= 5 THEN 3 ELSE 1 END""")
def expanding_splits(spark, folder):
    rows = trace(spark, folder).select(F.floor(F.col("us") / 259_200_000_000).alias("cycle"))
    return rul.expanding_splits(rows)


@query("one_hot", """SELECT event_id, CAST(event_type = 'click' AS INTEGER)::DOUBLE AS category__event_type_click, CAST(event_type = 'view' AS INTEGER)::DOUBLE AS category__event_type_view FROM events""")
def one_hot(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "event_type")
    return rul.one_hot(ev, ["event_type"], {"event_type": ["click", "view"]}).drop("event_type")


# --- polishing ----------------------------------------------------------------
@query("phase_by_position", f"""WITH {TRACE}, p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM trace)
SELECT event_id, CAST(least(floor(3 * p / n), 2) AS INTEGER) AS phase FROM p""")
def phase_by_position(spark, folder):
    return cmp.phase_by_position(trace(spark, folder), ["user_id"], TO).select("event_id", "phase")


PHASED = f"{TRACE}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM trace), ph AS (SELECT *, CAST(least(floor(3 * p / n), 2) AS INTEGER) AS phase FROM p)"


@query("cmp_phase_stats", f"""WITH {PHASED} SELECT user_id, {', '.join(r(f'{fn}(value) FILTER (phase = {k})', f'phase__value__{n}__{k}') for k in range(3) for fn, n in (('avg', 'mean'), ('stddev_samp', 'std')))} FROM ph GROUP BY user_id""")
def cmp_phase_stats(spark, folder):
    return cmp.cmp_phase_stats(trace(spark, folder), ["user_id"], ["value"], order=TO)


@query("cmp_process_stats", f"""WITH {TRACE}, g AS (SELECT user_id, us / 1e6 AS t, us / 1e6 - lag(us / 1e6) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM trace)
SELECT user_id, count(*) AS sample_count, {r('max(t) - min(t)', 'process_duration', 3)}, {r('avg(gap)', 'timestamp_gap_mean', 3)}, {r('stddev_samp(gap)', 'timestamp_gap_std', 3)} FROM g GROUP BY user_id""", digits=3)
def cmp_process_stats(spark, folder):
    rows = trace(spark, folder).withColumn("t", F.col("us") / 1e6)
    return cmp.cmp_process_stats(rows, ["user_id"], time="t", order=TO)


@query("cmp_signal_stats", f"""WITH {TRACE} SELECT user_id, event_type, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
 {r('arg_min(value, (us, event_id))', 'first')}, {r('arg_max(value, (us, event_id))', 'last')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.75)', 'q75')}
FROM trace GROUP BY user_id, event_type""")
def cmp_signal_stats(spark, folder):
    return cmp.cmp_signal_stats(trace(spark, folder), UT, order=TO)


@query("cmp_chamber_stats", f"""WITH {TRACE} SELECT user_id, event_type, count(*) AS chamber_count, max(us) - min(us) AS chamber_duration, {r('avg(value)', 'value__mean')} FROM trace GROUP BY user_id, event_type""")
def cmp_chamber_stats(spark, folder):
    return cmp.cmp_chamber_stats(trace(spark, folder), ["user_id"], ["value"], chamber="event_type", time="us")


@query("context_fractions", """WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, 'event_type' AS context, event_type AS context_value, round(count(*) / any_value(n), 6) + 0.0 AS fraction FROM events JOIN t USING (user_id) GROUP BY user_id, event_type""")
def context_fractions(spark, folder):
    return cmp.context_fractions(table(spark, folder, "events"), ["user_id"], ["event_type"])


@query("preston_proxy", f"""WITH {TRACE}, p AS (SELECT user_id, us / 1e6 AS t, value * (abs(value - 50) + abs(ts_idx - 88)) AS p FROM trace)
SELECT user_id, {r('avg(p)', 'preston_mean', 3)}, {r('stddev_samp(p)', 'preston_std', 3)}, {r('max(p)', 'preston_max', 3)}, {r('avg(p) * (max(t) - min(t)) / 1e6', 'pressure_speed_exposure', 3)} FROM p GROUP BY user_id""", digits=3)
def preston_proxy(spark, folder):
    rows = trace(spark, folder).select("user_id", (F.col("us") / 1e6).alias("t"), "value", (F.col("value") - 50).alias("a"), (F.col("ts_idx") - 88).alias("b"))
    out = cmp.preston_proxy(rows, ["user_id"], pressure="value", rotations=["a", "b"], time="t")
    return out.withColumn("pressure_speed_exposure", F.col("pressure_speed_exposure") / 1e6)


@query("campaign_id", """WITH s AS (SELECT l_suppkey, l_returnflag, min(l_orderkey % 185) AS earliest_source FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, earliest_source, CAST(floor(min(earliest_source) OVER (PARTITION BY l_suppkey) / 10) AS INTEGER) AS campaign FROM s""")
def campaign_id(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("src", F.col("l_orderkey") % 185)
    return cmp.campaign_id(li, wafer="l_suppkey", stage="l_returnflag", source="src")


@query("outlier_label_ceiling", "SELECT o_orderkey, o_totalprice < 300000 AS kept FROM orders")
def outlier_label_ceiling(spark, folder):
    kept, removed = cmp.outlier_label_ceiling(table(spark, folder, "orders"), "o_totalprice", 300_000.0)
    pick = lambda df, flag: df.select("o_orderkey", F.lit(flag).alias("kept"))
    return pick(kept, True).unionByName(pick(removed, False))


# --- etch ---------------------------------------------------------------------
@query("decode_dictionary", """SELECT l_orderkey, l_partkey, l_linenumber, p_retailprice AS value, count(*) AS rows FROM lineitem LEFT JOIN (SELECT p_partkey, any_value(p_retailprice) AS p_retailprice FROM part GROUP BY p_partkey) ON l_partkey = p_partkey GROUP BY ALL""")
def decode_dictionary(spark, folder):
    codes = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_partkey").alias("code"))
    dictionary = table(spark, folder, "part").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("value"))
    out = etch.decode_dictionary(codes, dictionary)
    return out.groupBy("l_orderkey", "l_partkey", "l_linenumber", "value").agg(F.count(F.lit(1)).alias("rows"))


SLOPE = """x AS (SELECT *, 2.0 * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) - 1) / nullif(count(*) OVER (PARTITION BY user_id, event_type) - 1, 0) - 1 AS x FROM trace)"""


@query("trace_slope", f"""WITH {TRACE}, {SLOPE} SELECT user_id, event_type, {r('CASE WHEN count(*) < 2 OR min(value) = max(value) THEN 0 ELSE regr_slope(value, x) END', 'slope')} FROM x GROUP BY ALL""")
def trace_slope(spark, folder):
    return etch.trace_slope(trace(spark, folder), UT, TO)


PCT = ", ".join(r(f"quantile_cont(value, {q})", n) for n, q in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))


@query("etch_process_features", f"""WITH {TRACE}, {SLOPE}, q AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM trace GROUP BY ALL)
SELECT user_id, event_type, {r('avg(value)', 'mean')}, {r('CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END', 'std')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('any_value(iqr)', 'iqr')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
 0.0::DOUBLE AS missing_rate, {r('avg(CASE WHEN iqr > 0 AND abs(value - mid) > 3 * iqr THEN 1.0 ELSE 0.0 END)', 'outlier_rate')}, {PCT}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.75)', 'q75')},
 {r('arg_min(value, (us, event_id))', 'first')}, {r('arg_max(value, (us, event_id))', 'last')}, {r('CASE WHEN count(*) < 2 OR min(value) = max(value) THEN 0 ELSE regr_slope(value, x) END', 'slope')}
FROM x JOIN q USING (user_id, event_type) GROUP BY user_id, event_type""")
def etch_process_features(spark, folder):
    return etch.etch_process_features(trace(spark, folder), UT, order=TO)


@query("wafer_average_target", f"SELECT l_suppkey, l_returnflag, {r('avg(l_quantity)', 'l_quantity')}, {r('avg(l_discount)', 'l_discount')}, count(*) AS points FROM lineitem GROUP BY ALL")
def wafer_average_target(spark, folder):
    return etch.wafer_average_target(table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_discount"])


COORD = "SELECT o_orderkey, (o_orderkey % 200 - 100) * 1000 / 100000.0 AS u, (o_custkey % 200 - 100) * 1000 / 100000.0 AS v FROM orders"


@query("coordinate_features", f"""SELECT o_orderkey, {r('u', 'coordinate__x')}, {r('v', 'coordinate__y')}, {r('sqrt(u * u + v * v)', 'coordinate__radius')}, {r('u * u + v * v', 'coordinate__radius2')}, {r('u * v', 'coordinate__xy')}, {r('u * u - v * v', 'coordinate__x2_minus_y2')}, {r('sin(atan2(v, u))', 'coordinate__sin_angle')}, {r('cos(atan2(v, u))', 'coordinate__cos_angle')} FROM ({COORD.replace('100000.0', '1e5')})""")
def coordinate_features(spark, folder):
    points = table(spark, folder, "orders").select("o_orderkey", ((F.col("o_orderkey") % 200 - 100) * 1000).alias("X"), ((F.col("o_custkey") % 200 - 100) * 1000).alias("Y"))
    return etch.coordinate_features(points).drop("X", "Y")


# --- bounded traces -------------------------------------------------------------
@query("trace_arrays", f"""WITH {HOUR_TRACE}, keys AS (SELECT DISTINCT wafer, sensor FROM grid), slots AS (SELECT wafer, sensor, i FROM keys, range(0, {HOURS}) AS g(i))
SELECT s.wafer, s.sensor, CAST(count(value) AS INTEGER) AS present, {r('sum(value * (i + 1))', 'weighted')} FROM slots s LEFT JOIN grid g ON s.wafer = g.wafer AND s.sensor = g.sensor AND s.i = g.ts_idx GROUP BY ALL""")
def trace_arrays(spark, folder):
    arrays = traces.trace_arrays(hour_trace(spark, folder), ["wafer", "sensor"], samples=HOURS)
    known = F.filter("readings", lambda v: v.isNotNull())
    total = F.aggregate(F.transform("readings", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return arrays.select("wafer", "sensor", F.size(known).alias("present"), total.alias("weighted"))


@query("raw_trace_matrix", f"""WITH {HOUR_TRACE} SELECT wafer, sensor || '__t' || lpad(CAST(ts_idx AS VARCHAR), 3, '0') AS feature, {r('value', 'value')} FROM grid""")
def raw_trace_matrix(spark, folder):
    return traces.raw_trace_matrix(hour_trace(spark, folder), ["wafer"])


@query("trace_impute", f"""WITH {HOUR_TRACE}, keys AS (SELECT DISTINCT wafer, sensor FROM grid), slots AS (SELECT wafer, sensor, i AS ts_idx FROM keys, range(0, {HOURS}) AS g(i)),
full_grid AS (SELECT s.wafer, s.sensor, s.ts_idx, value FROM slots s LEFT JOIN grid USING (wafer, sensor, ts_idx)), med AS (SELECT sensor, quantile_cont(value, 0.5) AS m FROM full_grid WHERE wafer % 5 <> 0 GROUP BY sensor)
SELECT wafer, sensor, CAST(ts_idx AS INTEGER) AS ts_idx, {r('coalesce(value, m)', 'value')} FROM full_grid JOIN med USING (sensor)""")
def trace_impute(spark, folder):
    arrays = traces.trace_arrays(hour_trace(spark, folder), ["wafer", "sensor"], samples=HOURS)
    cells = arrays.select("wafer", "sensor", F.posexplode("readings").alias("ts_idx", "value"))
    return traces.trace_impute(cells, F.col("wafer") % 5 != 0)


@query("trace_scale", f"""WITH {HOUR_TRACE}, f AS (SELECT sensor, avg(value) AS m, stddev_pop(value) AS s FROM grid WHERE wafer % 5 <> 0 GROUP BY sensor)
SELECT wafer, sensor, ts_idx, {r('(value - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END', 'value')} FROM grid JOIN f USING (sensor)""")
def trace_scale(spark, folder):
    return traces.trace_scale(hour_trace(spark, folder), F.col("wafer") % 5 != 0)


@query("distribution_stats", f"""WITH {HOUR_TRACE}, m AS (SELECT wafer, sensor, avg(value) AS m, stddev_pop(value) AS s FROM grid GROUP BY ALL)
SELECT wafer, sensor, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('sqrt(avg(value * value))', 'rms')},
 {r('CASE WHEN any_value(s) <= 1e-12 THEN 0 ELSE avg(((value - m) / nullif(s, 0)) ** 3) END', 'skew')}, {r('CASE WHEN any_value(s) <= 1e-12 THEN -3 ELSE avg(((value - m) / nullif(s, 0)) ** 4) - 3 END', 'kurtosis')},
 {', '.join(r(f'quantile_cont(value, {q})', n) for n, q in (('median', 0.5), ('q01', 0.01), ('q05', 0.05), ('q25', 0.25), ('q75', 0.75), ('q95', 0.95), ('q99', 0.99)))}
FROM grid JOIN m USING (wafer, sensor) GROUP BY wafer, sensor""")
def distribution_stats(spark, folder):
    return signal.distribution_stats(hour_trace(spark, folder))


@query("position_stats", f"""WITH {HOUR_TRACE}, p AS (SELECT *, row_number() OVER w - 1 AS p, lag(value) OVER w AS b, avg(value) OVER (PARTITION BY wafer, sensor) AS m, count(*) OVER (PARTITION BY wafer, sensor) AS n FROM grid WINDOW w AS (PARTITION BY wafer, sensor ORDER BY ts_idx))
SELECT wafer, sensor, {r('arg_min(value, ts_idx)', 'first')}, {r('arg_max(value, ts_idx)', 'last')}, {r('arg_max(value, ts_idx) - arg_min(value, ts_idx)', 'delta')},
 {r('arg_min(p, (value, p)) / nullif(any_value(n) - 1, 0)', 'argmin')}, {r('arg_max(p, (value, -p)) / nullif(any_value(n) - 1, 0)', 'argmax')},
 {r('coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN (value - m) * (b - m) < 0 THEN 1.0 ELSE 0.0 END END), 0)', 'mean_crossing_rate')} FROM p GROUP BY wafer, sensor""")
def position_stats(spark, folder):
    return signal.position_stats(hour_trace(spark, folder))


@query("difference_stats", f"""WITH {HOUR_TRACE}, d AS (SELECT wafer, sensor, value - lag(value) OVER (PARTITION BY wafer, sensor ORDER BY ts_idx) AS d FROM grid)
SELECT wafer, sensor, {r('avg(d)', 'diff_mean')}, {r('stddev_pop(d)', 'diff_std')}, {r('avg(abs(d))', 'diff_abs_mean')}, {r('max(abs(d))', 'diff_abs_max')} FROM d GROUP BY wafer, sensor""")
def difference_stats(spark, folder):
    return signal.difference_stats(hour_trace(spark, folder))


def _acf(k: int) -> str:
    return r(f"coalesce(CASE WHEN sqrt(sum(c * c) FILTER (s{k} IS NOT NULL) * sum(s{k} * s{k})) > 1e-12 THEN sum(c * s{k}) / sqrt(sum(c * c) FILTER (s{k} IS NOT NULL) * sum(s{k} * s{k})) END, 0)", f"autocorr_lag_{k}")


@query("autocorrelation", f"""WITH {HOUR_TRACE}, c AS (SELECT wafer, sensor, ts_idx, value - avg(value) OVER (PARTITION BY wafer, sensor) AS c FROM grid),
s AS (SELECT *, {', '.join(f'lead(c, {k}) OVER w AS s{k}' for k in (1, 2, 4, 8, 16, 32))} FROM c WINDOW w AS (PARTITION BY wafer, sensor ORDER BY ts_idx))
SELECT wafer, sensor, {', '.join(_acf(k) for k in (1, 2, 4, 8, 16, 32))} FROM s GROUP BY wafer, sensor""")
def autocorrelation(spark, folder):
    return signal.autocorrelation(hour_trace(spark, folder))


@query("window_stats", f"""WITH {HOUR_TRACE}, p AS (SELECT *, row_number() OVER (PARTITION BY wafer, sensor ORDER BY ts_idx) - 1 AS p, count(*) OVER (PARTITION BY wafer, sensor) AS n FROM grid),
w AS (SELECT *, CAST(1 + CASE WHEN p < (n % 4) * (n // 4 + 1) THEN p // (n // 4 + 1) ELSE n % 4 + (p - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS INTEGER) AS win FROM p)
SELECT wafer, sensor, win AS "window", {r('avg(value)', 'window_mean')}, {r('stddev_pop(value)', 'window_std')} FROM w GROUP BY ALL""")
def window_stats(spark, folder):
    return signal.window_stats(hour_trace(spark, folder), windows=4)


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("sensor_correlation", f"""WITH {HOUR_TRACE}, p AS (SELECT a.wafer, a.sensor AS sensor_a, b.sensor AS sensor_b, a.value AS x, b.value AS y FROM grid a JOIN grid b ON a.wafer = b.wafer AND a.ts_idx = b.ts_idx AND a.sensor < b.sensor),
names AS (SELECT DISTINCT sensor FROM grid), wafers AS (SELECT DISTINCT wafer FROM grid), every AS (SELECT wafer, a.sensor AS sensor_a, b.sensor AS sensor_b FROM wafers, names a, names b WHERE a.sensor < b.sensor)
SELECT e.wafer, e.sensor_a, e.sensor_b, {r('coalesce(CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0)', 'correlation')} FROM every e LEFT JOIN p USING (wafer, sensor_a, sensor_b) GROUP BY ALL""")
def sensor_correlation(spark, folder):
    return signal.sensor_correlation(hour_trace(spark, folder), EVENT_TYPES)


def _filled(spark, folder):
    arrays = traces.trace_arrays(hour_trace(spark, folder), ["wafer", "sensor"], samples=HOURS)
    return signal.interpolate_waveform(arrays, HOURS).filter("waveform IS NOT NULL")


FILLED = f"""{HOUR_TRACE}, keys AS (SELECT DISTINCT wafer, sensor FROM grid), slots AS (SELECT wafer, sensor, i FROM keys, range(0, {HOURS}) AS g(i)),
v AS (SELECT s.wafer, s.sensor, i, value FROM slots s LEFT JOIN grid g ON s.wafer = g.wafer AND s.sensor = g.sensor AND s.i = g.ts_idx),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER back AS a, last_value(value IGNORE NULLS) OVER back AS va,
 first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS b, first_value(value IGNORE NULLS) OVER ahead AS vb FROM v
 WINDOW back AS (PARTITION BY wafer, sensor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY wafer, sensor ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT wafer, sensor, i, CASE WHEN value IS NOT NULL THEN value WHEN a IS NULL THEN vb WHEN b IS NULL THEN va ELSE va + (vb - va) * (i - a) / (b - a) END AS x FROM n WHERE a IS NOT NULL OR b IS NOT NULL)"""


@query("spectral_features", f"""WITH {FILLED}, c AS (SELECT wafer, sensor, i, x - avg(x) OVER (PARTITION BY wafer, sensor) AS x FROM filled),
f AS (SELECT wafer, sensor, k, CASE WHEN k = 0 THEN 0 ELSE sum(x * cos(2 * pi() * k * i / {HOURS})) ** 2 + sum(x * sin(2 * pi() * k * i / {HOURS})) ** 2 END AS p FROM c, range(0, {HOURS // 2 + 1}) AS g(k) GROUP BY wafer, sensor, k),
s AS (SELECT *, sum(p) OVER (PARTITION BY wafer, sensor) AS t FROM f), h AS (SELECT wafer, sensor, k, t, CASE WHEN t > 1e-12 THEN p / t ELSE 0 END AS s FROM s)
SELECT wafer, sensor, {r('ln(1 + max(t))', 'spectral_total_power')}, {r('sum(s * k)', 'spectral_centroid')}, CAST(arg_max(k, round(s, 9) * 1000 - k * 1e-9) AS DOUBLE) AS spectral_dominant_frequency, {r('-sum(s * ln(s + 1e-12))', 'spectral_entropy')},
 {', '.join(r(f'coalesce(sum(s) FILTER (k >= {a} AND k < {b}), 0)', f'spectral_band_{n}') for n, (a, b) in enumerate(((1, 3), (3, 6), (6, 11), (11, 21), (21, 41), (41, 999)), 1))} FROM h GROUP BY wafer, sensor""")
def spectral_features(spark, folder):
    return signal.spectral_features(_filled(spark, folder), readings="waveform")


@query("interpolate_waveform", f"WITH {FILLED} SELECT wafer, sensor, CAST(i AS INTEGER) AS point, {r('x', 'value')} FROM filled")
def interpolate_waveform(spark, folder):
    return _filled(spark, folder).select("wafer", "sensor", F.posexplode("waveform").alias("point", "value"))


@query("resample_trace", f"""WITH {TRACE}, v AS (SELECT user_id, event_type, us::DOUBLE AS t, avg(value) AS v FROM trace GROUP BY ALL), k AS (SELECT user_id, event_type, min(t) AS lo, max(t) AS hi FROM v GROUP BY ALL),
p AS (SELECT user_id, event_type, j, CASE WHEN j = 15 THEN hi ELSE lo + (hi - lo) / 15 * j END AS t FROM k, range(0, 16) AS g(j)),
a AS (SELECT p.user_id, p.event_type, j, p.t, v.t AS ta, v.v AS va FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.event_type = v.event_type AND p.t >= v.t),
b AS (SELECT a.*, v.t AS tb, v.v AS vb FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.event_type = v.event_type AND a.t <= v.t)
SELECT user_id, event_type, CAST(j AS INTEGER) AS point, {r('CASE WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END', 'value', 5)} FROM b""", digits=5)
def resample_trace(spark, folder):
    rows = trace(spark, folder)
    return signal.resample_trace(rows, UT, 16, time="us").select("user_id", "event_type", F.posexplode("waveform").alias("point", "value"))


@query("normalize_waveform", f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY vec_id)
SELECT vec_id, CAST(i AS INTEGER) AS point, {r('(x - m) / CASE WHEN s > 1e-10 THEN s ELSE 1 END', 'value', 5)} FROM v JOIN m USING (vec_id)""", digits=5)
def normalize_waveform(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("waveform"))
    return signal.normalize_waveform(rows).select("vec_id", F.posexplode("waveform").alias("point", "value"))


@query("waveform_bank", f"""WITH {FILLED}, p AS (SELECT wafer, sensor, j, j * {HOURS - 1} / 31.0 AS place FROM keys, range(0, 32) AS g(j)), q AS (SELECT *, least(CAST(floor(place) AS BIGINT), {HOURS - 2}) AS lo FROM p),
w AS (SELECT q.wafer, q.sensor, j, a.x + (b.x - a.x) * (place - lo) AS x FROM q JOIN filled a ON a.wafer = q.wafer AND a.sensor = q.sensor AND a.i = lo JOIN filled b ON b.wafer = q.wafer AND b.sensor = q.sensor AND b.i = lo + 1),
z AS (SELECT *, avg(x) OVER (PARTITION BY wafer, sensor) AS m, stddev_pop(x) OVER (PARTITION BY wafer, sensor) AS s FROM w)
SELECT wafer, sensor, CAST(j AS INTEGER) AS point, {r('(x - m) / CASE WHEN s > 1e-10 THEN s ELSE 1 END', 'value', 5)} FROM z""", digits=5)
def waveform_bank(spark, folder):
    arrays = traces.trace_arrays(hour_trace(spark, folder), ["wafer", "sensor"], samples=HOURS)
    bank = signal.waveform_bank(arrays, points=32)
    return bank.select("wafer", "sensor", F.posexplode("waveform").alias("point", "value"))


@query("waveform_pca")
def waveform_pca(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("waveform"))
    out = signal.waveform_pca(rows.filter("vec_id % 5 <> 0"), rows, 8)
    return out.select("vec_id", F.size("scores").alias("components"), "reconstruction_rmse")


def embedded(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("waveform"))


POINTS = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
AMPLITUDE = ", ".join(r(e, n) for e, n in (("avg(x)", "mean"), ("stddev_pop(x)", "std"), ("min(x)", "min"), ("max(x)", "max"), ("arg_max(x, i) - arg_min(x, i)", "change"), ("sqrt(avg(x * x))", "rms")))


@query("amplitude_stats", f"WITH {POINTS} SELECT vec_id, {AMPLITUDE} FROM v GROUP BY vec_id")
def amplitude_stats(spark, folder):
    return embedded(spark, folder).select("vec_id", *[c.alias(n) for n, c in components.amplitude_stats("waveform").items()])


@query("project_waveforms", f"""WITH {POINTS}, a AS (SELECT vec_id, {AMPLITUDE}, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY vec_id), z AS (SELECT vec_id, i // 16 AS block, (x - m) / CASE WHEN s > 1e-10 THEN s ELSE 1 END AS z FROM v JOIN a USING (vec_id)),
b AS (SELECT *, avg(z) OVER (PARTITION BY vec_id, block) AS mz FROM z), e AS (SELECT vec_id, {r('sqrt(avg((z - mz) * (z - mz)))', 'reconstruction_rmse')}, {r('sum(z) FILTER (block = 0)', 'first_score')}, {r('sum(z) FILTER (block = 3)', 'last_score')} FROM b GROUP BY vec_id)
SELECT vec_id, mean, std, min, max, change, rms, reconstruction_rmse, first_score, last_score FROM a JOIN e USING (vec_id)""")
def project_waveforms(spark, folder):
    """Onto four blocks of sixteen points: a score is a block's sum, the way back its mean."""
    out = components.project_waveforms(embedded(spark, folder), np.kron(np.eye(4), np.ones((16, 1))))
    return out.select(*[c for c in out.columns if c not in ("waveform", "scores")], F.col("scores")[0].alias("first_score"), F.col("scores")[3].alias("last_score"))


@query("encode_waveforms")
def encode_waveforms(spark, folder):
    """Vectors on a basis of those that are not of every fifth id, and of the sensors' waveforms as the external bank."""
    rows = embedded(spark, folder)
    external = signal.waveform_bank(traces.trace_arrays(hour_trace(spark, folder), ["wafer", "sensor"], samples=HOURS), points=64)
    basis = components.waveform_basis(rows.filter("vec_id % 5 <> 0"), 8, external=external)
    out = components.encode_waveforms(rows, basis)
    return out.select(*[c for c in out.columns if c not in ("waveform", "scores")], F.size("scores").alias("components"))


@query("principal_axes", f"""WITH c AS (SELECT var_pop(l_quantity) AS a, var_pop(l_tax * 100) AS b, covar_pop(l_quantity, l_tax * 100) AS ab FROM lineitem), e AS (SELECT (a + b) / 2 AS mid, sqrt((a - b) * (a - b) / 4 + ab * ab) AS reach FROM c)
SELECT CAST(1 AS INTEGER) AS component, {r('mid + reach', 'variance')} FROM e UNION ALL SELECT 2, {r('mid - reach', 'variance')} FROM e""")
def principal_axes(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double") * 100).alias("v"))
    basis = components.principal_axes(rows, "v", 2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(basis.variances, 1)], "component int, variance double")


@query("sufficiently_observed", f"""WITH {HOUR_TRACE}, f AS (SELECT wafer, sensor || '__t' || lpad(CAST(ts_idx AS VARCHAR), 3, '0') AS feature FROM grid), k AS (SELECT feature FROM f GROUP BY feature HAVING count(*) >= 40)
SELECT feature, count(*) AS rows FROM f JOIN k USING (feature) GROUP BY feature""")
def sufficiently_observed(spark, folder):
    features = traces.raw_trace_matrix(hour_trace(spark, folder), ["wafer"])
    return profile.sufficiently_observed(features, 40).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


@query("fold_local_observed", f"""WITH {HOUR_TRACE}, f AS (SELECT wafer, wafer % 5 AS fold, sensor || '__t' || lpad(CAST(ts_idx AS VARCHAR), 3, '0') AS feature FROM grid), t AS (SELECT feature, count(*) AS n FROM f GROUP BY feature),
k AS (SELECT DISTINCT wafer % 5 AS fold FROM grid), o AS (SELECT feature, fold, count(*) AS own FROM f GROUP BY ALL)
SELECT k.fold, t.feature, t.n - coalesce(own, 0) AS train_values FROM t CROSS JOIN k LEFT JOIN o ON o.feature = t.feature AND o.fold = k.fold WHERE t.n - coalesce(own, 0) >= 30""")
def fold_local_observed(spark, folder):
    grid = hour_trace(spark, folder)
    folds = grid.select("wafer").distinct().withColumn("fold", F.col("wafer") % 5)
    return profile.fold_local_observed(traces.raw_trace_matrix(grid, ["wafer"]), folds, ["wafer"], 30)


@query("drop_constant", f"""WITH v AS (SELECT p_partkey, unnest(['size', 'half', 'one']) AS feature, unnest([p_size, p_size % 2, 1])::DOUBLE AS value FROM part), k AS (SELECT feature FROM v GROUP BY feature HAVING min(value) < max(value))
SELECT p_partkey, feature, value FROM v JOIN k USING (feature)""")
def drop_constant(spark, folder):
    p = table(spark, folder, "part")
    s = F.col("p_size").cast("double")
    wide = p.select("p_partkey", s.alias("size"), (s % 2).alias("half"), F.lit(1.0).alias("one"))
    return profile.drop_constant(wide.unpivot(["p_partkey"], ["size", "half", "one"], "feature", "value"))


@query("chronological_holdout", """WITH s AS (SELECT l_orderkey, l_orderkey % 185 // 10 AS campaign FROM lineitem), k AS (SELECT DISTINCT campaign FROM s ORDER BY campaign DESC LIMIT 4)
SELECT CAST(campaign AS BIGINT) AS campaign, CASE WHEN campaign IN (SELECT campaign FROM k) THEN 'holdout' ELSE 'development' END AS split, count(*) AS rows FROM s GROUP BY ALL""")
def chronological_holdout(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.floor(F.col("l_orderkey") % 185 / 10).alias("campaign"))
    return sets.chronological_holdout(rows).groupBy("campaign", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("timestamp_index", "SELECT event_id, CAST(event_id % 176 AS INTEGER) AS ts_idx FROM events")
def timestamp_index(spark, folder):
    name = F.concat(F.lit("timestamp_"), (F.col("event_id") % 176).cast("string"))
    return table(spark, folder, "events").select("event_id", text.timestamp_index(name).alias("ts_idx"))


@query("wafer_trace_view", f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, unnest(['value', 'doubled']) AS sensor, unnest([{r('value', 'x').split(' AS x')[0]}, {r('value * 2', 'x').split(' AS x')[0]}]) AS value FROM events WHERE event_type = 'click' AND user_id = 7""")
def wafer_trace_view(spark, folder):
    wide = table(spark, folder, "events").select(
        F.col("event_type").alias("lot"), F.col("user_id").cast("string").alias("wafer"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "value", (F.col("value") * 2).alias("doubled")
    )
    return traces.wafer_trace_view(wide, "click", "7", ["value", "doubled"])


@query("etch_map_view", "SELECT l_orderkey AS \"X\", l_partkey AS \"Y\", l_quantity AS value FROM lineitem WHERE l_suppkey = 3")
def etch_map_view(spark, folder):
    points = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("experiment_key"), F.col("l_orderkey").alias("X"), F.col("l_partkey").alias("Y"), F.col("l_quantity").alias("si_etch"))
    return etch.etch_map_view(points, "3")


@query("source_audit", f"""WITH {TRACE}, m AS (SELECT user_id, event_type, avg(value) AS m FROM trace GROUP BY ALL) SELECT (SELECT count(*) FROM trace) AS rows, CAST(0 AS BIGINT) AS blank_keys, (SELECT min(ts_idx) FROM trace) AS first_index, (SELECT max(ts_idx) FROM trace) AS last_index,
 count(*) AS means_compared, count(*) FILTER (user_id % 10 = 0) AS mean_mismatches, 0.5::DOUBLE AS max_mean_gap FROM m""")
def source_audit(spark, folder):
    rows = trace(spark, folder)
    cached = rows.groupBy(*UT).agg((F.avg("value") + F.when(F.col("user_id") % 10 == 0, 0.5).otherwise(0.0)).alias("mean"))
    return cleaning.source_audit(rows, cached, ["user_id"], sensor="event_type")


@query("cleaning_variants", f"""WITH cells AS (SELECT event_type AS sensor, {RAW} AS raw FROM events), typed AS (SELECT sensor, try_cast(raw AS DOUBLE) AS num, CASE WHEN raw = '01.Sep' THEN 1.09 WHEN raw <> 'n/a' THEN try_cast(replace(raw, ',', '.') AS DOUBLE) END AS value FROM cells)
SELECT 'naive' AS variant, sensor, {r('avg(num)', 'mean')}, {r('1 - count(num) / count(*)', 'missing_rate')} FROM typed GROUP BY sensor UNION ALL SELECT 'recovered', sensor, {r('avg(value)', 'mean')}, {r('1 - count(value) / count(*)', 'missing_rate')} FROM typed GROUP BY sensor""")
def cleaning_variants(spark, folder):
    cells = raw_cells(spark, folder).withColumn("ts_idx", F.col("event_id"))
    tables = cleaning.cleaning_variants(cells, ["sensor"])
    part = lambda n: tables[n].select(F.lit(n).alias("variant"), "sensor", "mean", "missing_rate")
    return part("naive").unionByName(part("recovered"))
