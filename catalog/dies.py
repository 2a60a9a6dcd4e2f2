"""Die-test, monitoring, golden-baseline and wafer-map queries on ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DIES, LIMITS_SQL, TESTS, TESTS_SQL, die_tests, dies, is_current, limits, query, r, table
from yieldloom.functions import grades
from yieldloom.operators import die, golden, joins, monitor, profile, sets, spatial, traces
from yieldloom.session import pin

LT = ["lot", "test_id"]
P7 = (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))
FENCE = "fence AS (SELECT lot, test_id, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, coalesce(stddev_samp(value), 0) AS sd FROM tests GROUP BY ALL)"


def _near(cond: str, test: str, name: str) -> str:
    return r(f"avg(CASE WHEN {cond} THEN CASE WHEN {test} THEN 1.0 ELSE 0.0 END END)", name)


OK = "lsl IS NOT NULL AND usl > lsl"
SPEC = ", ".join(
    (
        _near(OK, "value >= lsl AND value <= lsl + 0.05 * (usl - lsl)", "near_lsl_pct"),
        _near(OK, "value <= usl AND value >= usl - 0.05 * (usl - lsl)", "near_usl_pct"),
        _near(OK + " AND sd > 1e-9", "value >= lsl AND value <= lsl + 0.5 * sd", "near_lsl_sigma"),
        _near(OK + " AND sd > 1e-9", "value <= usl AND value >= usl - 0.5 * sd", "near_usl_sigma"),
    )
)
STATS = f"""{r('avg(value)', 'mean')}, {r('CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END', 'std')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('any_value(iqr)', 'iqr')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
 {r('1 - count(value) / count(*)', 'missing_rate')}, {r('avg(CASE WHEN iqr > 0 AND (value < mid - 3 * iqr OR value > mid + 3 * iqr) THEN 1.0 ELSE 0.0 END)', 'outlier_rate')}, {', '.join(r(f'quantile_cont(value, {q})', n) for n, q in P7)}"""


@query("passing_dies", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F'")
def passing_dies(spark, folder):
    li = table(spark, folder, "lineitem")
    rows = li.withColumns({"bin": F.when(F.col("l_returnflag") != "R", 1).otherwise(2), "fails": F.when(F.col("l_linestatus") == "O", "T1.0").otherwise(" "), "alarms": F.lit(None).cast("string")})
    return die.passing_dies(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@query("die_is_pass", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag <> 'R' AND l_linestatus = 'F' AS is_pass FROM lineitem")
def die_is_pass(spark, folder):
    flag = die.die_is_pass(F.when(F.col("l_returnflag") != "R", 1).otherwise(2), F.when(F.col("l_linestatus") == "O", "T1.0").otherwise("nan"), F.lit(""))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("is_pass"))


@query("valid_coordinates", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey AS DOUBLE) AS y FROM part WHERE p_size % 3 <> 0")
def valid_coordinates(spark, folder):
    p = table(spark, folder, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "edge").otherwise(F.col("p_size").cast("string")).alias("x"), F.col("p_partkey").cast("string").alias("y"))
    return die.valid_coordinates(rows)


@query("test_columns", "SELECT 'quantity' AS test_id, count(*) AS rows FROM lineitem")
def test_columns(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("Site"), F.col("l_discount").alias("X DIE LOCATION"), F.col("l_extendedprice").alias("index time"))
    long = li.unpivot([], li.columns, "test_id", "value")
    return die.test_columns(long).groupBy("test_id").agg(F.count(F.lit(1)).alias("rows"))


@query("col_stats", f"WITH {TESTS_SQL}, {FENCE} SELECT lot, test_id, {STATS} FROM tests JOIN fence USING (lot, test_id) GROUP BY lot, test_id")
def col_stats(spark, folder):
    return die.col_stats(die_tests(spark, folder), LT)


@query("spec_proximity", f"WITH {TESTS_SQL}, {LIMITS_SQL}, {FENCE} SELECT lot, test_id, {SPEC} FROM tests JOIN fence USING (lot, test_id) LEFT JOIN limits USING (test_id) GROUP BY lot, test_id")
def spec_proximity(spark, folder):
    return die.spec_proximity(die_tests(spark, folder), LT, limits(spark))


WF = f"""{TESTS_SQL}, {LIMITS_SQL}, fence AS (SELECT lot, wafer, test_id, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, coalesce(stddev_samp(value), 0) AS sd FROM tests GROUP BY ALL),
pc AS (SELECT lot, wafer, count(DISTINCT (l_orderkey, l_partkey, l_linenumber)) AS pass_count FROM dies WHERE is_pass GROUP BY ALL)"""


@query("wafer_features", f"WITH {WF} SELECT lot, wafer, test_id, {STATS}, {SPEC}, any_value(pass_count) AS pass_count FROM tests JOIN fence USING (lot, wafer, test_id) LEFT JOIN limits USING (test_id) JOIN pc USING (lot, wafer) GROUP BY lot, wafer, test_id")
def wafer_features(spark, folder):
    wide = dies(spark, folder).filter("is_pass").withColumn("die_id", F.struct("l_orderkey", "l_partkey", "l_linenumber"))
    long = wide.select("lot", "wafer", "die_id", *TESTS).unpivot(["lot", "wafer", "die_id"], list(TESTS), "test_id", "value")
    return die.wafer_features(long, limits=limits(spark), wide=wide)


@query("lot_weighted_features", f"""WITH {WF}, f AS (SELECT lot, wafer, test_id, any_value(pass_count) AS w, unnest(['max', 'mean', 'min']) AS s, unnest([max(value), avg(value), min(value)]) AS v FROM tests JOIN pc USING (lot, wafer) GROUP BY lot, wafer, test_id)
SELECT lot, test_id || '__' || s AS feature, {r('sum(v * w) / sum(w)', 'value')} FROM f GROUP BY ALL""")
def lot_weighted_features(spark, folder):
    tests = die_tests(spark, folder)
    wafers = dies(spark, folder).filter("is_pass").select("lot", "wafer", "l_orderkey", "l_partkey", "l_linenumber").distinct()
    counts = wafers.groupBy("lot", "wafer").agg(F.count(F.lit(1)).alias("pass_count"))
    stats = tests.groupBy("lot", "wafer", "test_id").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    features = traces.feature_rows(stats, ["lot", "wafer"], ["test_id"]).join(counts, ["lot", "wafer"])
    return die.lot_weighted_features(features)


@query("common_features", f"""WITH {TESTS_SQL}, f AS (SELECT lot, wafer, test_id || CASE WHEN lot % 50 = 0 THEN '_rare' || lot ELSE '' END AS feature FROM tests), u AS (SELECT feature, count(DISTINCT (lot, wafer)) AS n FROM f GROUP BY feature),
t AS (SELECT count(DISTINCT (lot, wafer)) AS n FROM f) SELECT feature, count(*) AS rows FROM f WHERE feature IN (SELECT feature FROM u, t WHERE u.n >= least(8, t.n)) GROUP BY feature""")
def common_features(spark, folder):
    rare = F.when(F.col("lot") % 50 == 0, F.concat(F.lit("_rare"), F.col("lot").cast("string"))).otherwise("")
    f = die_tests(spark, folder).select("lot", "wafer", F.concat("test_id", rare).alias("feature"))
    return die.common_features(f, at_least=8).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


ORDER = "(l_shipdate, l_orderkey, l_partkey, l_linenumber, price)"
MERGE = f"""{DIES}, g AS (SELECT *, lot AS wafer_key, l_orderkey % 20 AS x, l_partkey % 20 AS y, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE quantity END AS t1, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE price END AS t2 FROM dies),
best AS (SELECT wafer_key, x, y, bool_or(is_pass) AS ok, count(*) AS sources FROM g GROUP BY ALL)"""


@query("merge_dies", f"""WITH {MERGE} SELECT wafer_key AS wafer, x, y, any_value(ok) AS is_pass, arg_max(l_orderkey, {ORDER}) FILTER (is_pass = ok) AS l_orderkey, any_value(sources) AS sources,
 {r(f'arg_max(t1, {ORDER}) FILTER (is_pass = ok AND t1 IS NOT NULL)', 't1')}, {r(f'arg_max(t2, {ORDER}) FILTER (is_pass = ok AND t2 IS NOT NULL)', 't2')} FROM g JOIN best USING (wafer_key, x, y) GROUP BY ALL""")
def merge_dies(spark, folder):
    d = dies(spark, folder)
    grid = d.select(
        F.col("lot").alias("wafer"), (F.col("l_orderkey") % 20).alias("x"), (F.col("l_partkey") % 20).alias("y"), "is_pass",
        "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "price",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("quantity")).alias("t1"), F.when(F.col("l_linenumber") % 2 != 0, F.col("price")).alias("t2"),
    )
    out = die.merge_dies(grid, recency=["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "price"], tests=["t1", "t2"])
    return out.select("wafer", "x", "y", "is_pass", "l_orderkey", "sources", "t1", "t2")


LTS = f"{r('avg(value)', 'mean')}, {r('CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END', 'std')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, count(value) AS \"count\""


@query("lot_test_stats", f"WITH {TESTS_SQL} SELECT lot, test_id, {LTS} FROM tests GROUP BY lot, test_id")
def lot_test_stats(spark, folder):
    return die.lot_test_stats(die_tests(spark, folder))


@query("current_param_stats", f"WITH {TESTS_SQL} SELECT test_id, {LTS} FROM tests WHERE lot % 10 = 0 GROUP BY test_id HAVING count(value) >= 5")
def current_param_stats(spark, folder):
    return die.current_param_stats(die_tests(spark, folder).filter(is_current()))


@query("device_renumber", f"WITH {DIES} SELECT lot, l_orderkey, l_partkey, l_linenumber, price, row_number() OVER (PARTITION BY lot ORDER BY l_orderkey, l_partkey, l_linenumber, price, l_shipdate) AS device_no FROM dies")
def device_renumber(spark, folder):
    out = die.device_renumber(dies(spark, folder), ["lot"], ["l_orderkey", "l_partkey", "l_linenumber", "price", "l_shipdate"])
    return out.select("lot", "l_orderkey", "l_partkey", "l_linenumber", "price", "device_no")


@query("rename_to_test_ids", f"WITH {TESTS_SQL} SELECT CASE test_id WHEN 'quantity' THEN 'T1.0' WHEN 'price' THEN 'T1.1' ELSE test_id END AS test_id, count(*) AS rows FROM tests GROUP BY 1")
def rename_to_test_ids(spark, folder):
    dim = spark.createDataFrame([("T1.0", "quantity"), ("T1.1", "price")], "test_id string, test_name string")
    rows = die_tests(spark, folder).withColumnRenamed("test_id", "column")
    return die.rename_to_test_ids(rows, dim).groupBy("test_id").agg(F.count(F.lit(1)).alias("rows"))


# --- monitoring -----------------------------------------------------------------
SPLIT = TESTS_SQL + ", cur AS (SELECT * FROM tests WHERE lot % 10 = 0), hist AS (SELECT * FROM tests WHERE lot % 10 <> 0)"
BINNED = "least(" + " + ".join(f"CAST(value >= lo + {i} * ((hi - lo) / 10) AS INTEGER)" for i in range(1, 10)) + ", 9)"


def _psi(c: str, b: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN 1e-4 ELSE {c} END - CASE WHEN {b} = 0 THEN 1e-4 ELSE {b} END) * ln(CASE WHEN {c} = 0 THEN 1e-4 ELSE {c} END / CASE WHEN {b} = 0 THEN 1e-4 ELSE {b} END)"


def _cur_hist(spark, folder):
    rows = die_tests(spark, folder)
    return rows.filter(is_current()), rows.filter(~is_current())


@query("psi", f"""WITH {SPLIT}, span AS (SELECT test_id, min(value) AS lo, max(value) AS hi, count(*) FILTER (lot % 10 = 0) AS nc, count(*) FILTER (lot % 10 <> 0) AS nb FROM tests GROUP BY test_id),
b AS (SELECT test_id, {BINNED} AS b, count(*) FILTER (lot % 10 = 0) / any_value(nc) AS c, count(*) FILTER (lot % 10 <> 0) / any_value(nb) AS h FROM tests JOIN span USING (test_id) GROUP BY ALL),
s AS (SELECT test_id, sum({_psi('c', 'h')}) AS psi FROM b GROUP BY test_id) SELECT test_id, {r('psi', 'psi')}, CASE WHEN psi >= 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_minor, CASE WHEN psi > 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_major FROM s""")
def psi(spark, folder):
    return monitor.psi(*_cur_hist(spark, folder))


PAIR = f"""cs AS (SELECT test_id, min(value) AS clo, max(value) AS chi, count(*) AS nc FROM cur GROUP BY test_id), sp AS (SELECT lot, test_id, least(min(value), any_value(clo)) AS lo, greatest(max(value), any_value(chi)) AS hi, count(*) AS nh, any_value(nc) AS nc FROM hist JOIN cs USING (test_id) GROUP BY ALL),
cb AS (SELECT sp.lot, test_id, {BINNED} AS b, count(*) AS n FROM cur JOIN sp USING (test_id) GROUP BY ALL), hb AS (SELECT lot, test_id, {BINNED} AS b, count(*) AS n FROM hist JOIN sp USING (lot, test_id) GROUP BY ALL),
j AS (SELECT sp.lot, sp.test_id, lo, hi, coalesce(cb.n, 0) / nc AS c, coalesce(hb.n, 0) / nh AS h FROM sp CROSS JOIN range(0, 10) AS g(b) LEFT JOIN cb ON cb.lot = sp.lot AND cb.test_id = sp.test_id AND cb.b = g.b LEFT JOIN hb ON hb.lot = sp.lot AND hb.test_id = sp.test_id AND hb.b = g.b),
pl AS (SELECT lot, test_id, CASE WHEN any_value(lo) = any_value(hi) THEN 0 ELSE sum({_psi('c', 'h')}) END AS psi FROM j GROUP BY lot, test_id), pmin AS (SELECT test_id, min(psi) AS psi, count(*) AS lots FROM pl GROUP BY test_id)"""
STATUS = "CASE WHEN psi > 0.25 THEN 'Major Shift' WHEN psi >= 0.1 THEN 'Minor Shift' ELSE 'Normal' END AS psi_status"


@query("psi_pairwise_min", f"WITH {SPLIT}, {PAIR} SELECT test_id, {r('psi', 'psi')}, lots, {STATUS} FROM pmin")
def psi_pairwise_min(spark, folder):
    return monitor.psi_pairwise_min(*_cur_hist(spark, folder))


@query("spc_mean_shift", f"""WITH {SPLIT}, h AS (SELECT test_id, avg(value) AS m, stddev_samp(value) AS s FROM hist GROUP BY test_id), c AS (SELECT test_id, avg(value) AS cm FROM cur GROUP BY test_id)
SELECT test_id, {r('m', 'cl')}, {r('m + 3 * s', 'ucl')}, {r('m - 3 * s', 'lcl')}, {r('cm', 'current_mean')}, {r('abs(cm - m) / s', 'mean_shift')}, CASE WHEN cm > m + 3 * s OR cm < m - 3 * s THEN 1.0 ELSE 0.0 END::DOUBLE AS is_shift FROM h JOIN c USING (test_id)""")
def spc_mean_shift(spark, folder):
    return monitor.spc_mean_shift(*_cur_hist(spark, folder))


@query("spc_median_shift", f"""WITH {SPLIT}, h AS (SELECT test_id, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM hist GROUP BY test_id), c AS (SELECT test_id, quantile_cont(value, 0.5) AS cm FROM cur GROUP BY test_id)
SELECT test_id, {r('cm', 'current_median')}, {r('m', 'history_median')}, {r('iqr', 'history_iqr')}, iqr > 0 AND abs(cm - m) > 1.5 * iqr AS spc_shift FROM h JOIN c USING (test_id)""")
def spc_median_shift(spark, folder):
    return monitor.spc_median_shift(*_cur_hist(spark, folder))


@query("ft_z_alert", f"""WITH {SPLIT}, h AS (SELECT test_id, avg(value) AS m, stddev_samp(value) AS s FROM hist GROUP BY test_id), c AS (SELECT test_id, avg(value) AS cm FROM cur GROUP BY test_id)
SELECT test_id, {r('abs(cm - m) / s', 'ft_deviation')}, abs(cm - m) / s > 2 AS ft_alert FROM h JOIN c USING (test_id)""")
def ft_z_alert(spark, folder):
    return monitor.ft_z_alert(*_cur_hist(spark, folder))


@query("lot_stability", f"""WITH {TESTS_SQL}, span AS (SELECT test_id, min(value) AS lo, max(value) AS hi, count(*) AS n, avg(value) AS g FROM tests GROUP BY test_id),
own AS (SELECT lot, test_id, count(*) AS n, sum(value - g) AS s, sum((value - g) ** 2) AS q FROM tests JOIN span USING (test_id) GROUP BY ALL), tot AS (SELECT test_id, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM own GROUP BY test_id),
loo AS (SELECT own.lot, own.test_id, own.n, g + own.s / own.n AS cm, tot.n - own.n AS bn, g + (tot.s - own.s) / (tot.n - own.n) AS bm, sqrt(((tot.q - own.q) - (tot.s - own.s) ** 2 / (tot.n - own.n)) / (tot.n - own.n - 1)) AS bs FROM own JOIN tot USING (test_id) JOIN span USING (test_id)),
ob AS (SELECT lot, test_id, {BINNED} AS b, count(*) AS n FROM tests JOIN span USING (test_id) GROUP BY ALL), tb AS (SELECT test_id, b, sum(n) AS n FROM ob GROUP BY ALL),
d AS (SELECT loo.lot, loo.test_id, coalesce(ob.n, 0) / loo.n AS c, (tb.n - coalesce(ob.n, 0)) / loo.bn AS h FROM loo JOIN tb USING (test_id) LEFT JOIN ob ON ob.lot = loo.lot AND ob.test_id = loo.test_id AND ob.b = tb.b),
p AS (SELECT lot, test_id, sum({_psi('c', 'h')}) AS psi FROM d GROUP BY ALL)
SELECT lot, test_id, {r('bm', 'cl')}, {r('bm + 3 * bs', 'ucl')}, {r('bm - 3 * bs', 'lcl')}, {r('cm', 'current_mean')}, {r('abs(cm - bm) / bs', 'mean_shift')}, CASE WHEN cm > bm + 3 * bs OR cm < bm - 3 * bs THEN 1.0 ELSE 0.0 END::DOUBLE AS is_shift,
 {r('psi', 'psi')}, CASE WHEN psi >= 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_minor, CASE WHEN psi > 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_major FROM loo JOIN p USING (lot, test_id)""")
def lot_stability(spark, folder):
    return monitor.lot_stability(die_tests(spark, folder))


@query("leave_one_out_baseline", f"""WITH {TESTS_SQL}, t AS (SELECT test_id, count(*) AS n, avg(value) AS g FROM tests GROUP BY test_id), o AS (SELECT lot, test_id, count(*) AS n, sum(value - g) AS s, sum((value - g) ** 2) AS q, any_value(g) AS g FROM tests JOIN t USING (test_id) GROUP BY ALL), a AS (SELECT test_id, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM o GROUP BY test_id)
SELECT lot, test_id, CAST(a.n - o.n AS BIGINT) AS baseline_n, {r('g + (a.s - o.s) / (a.n - o.n)', 'baseline_mean')}, {r('sqrt(((a.q - o.q) - (a.s - o.s) ** 2 / (a.n - o.n)) / (a.n - o.n - 1))', 'baseline_std')} FROM o JOIN a USING (test_id)""")
def leave_one_out_baseline(spark, folder):
    return monitor.leave_one_out_baseline(die_tests(spark, folder))


CPK = "least((usl - {m}) / (3 * greatest({s}, 1e-9)), ({m} - lsl) / (3 * greatest({s}, 1e-9)))"


@query("cpk", f"WITH {TESTS_SQL}, {LIMITS_SQL}, s AS (SELECT lot, test_id, avg(value) AS m, stddev_samp(value) AS sd FROM tests GROUP BY ALL) SELECT lot, test_id, {r(CPK.format(m='m', s='sd'), 'cpk')} FROM s JOIN limits USING (test_id)")
def cpk(spark, folder):
    s = die_tests(spark, folder).groupBy(*LT).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).join(limits(spark), "test_id")
    return s.select("lot", "test_id", grades.cpk(F.col("m"), F.col("sd"), F.col("lsl"), F.col("usl")).alias("cpk"))


SHIFT = f"""h AS (SELECT test_id, avg(value) AS hm, stddev_samp(value) AS hs, quantile_cont(value, 0.5) AS hmed, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM hist GROUP BY test_id), c AS (SELECT test_id, avg(value) AS cm, stddev_samp(value) AS cs, quantile_cont(value, 0.5) AS cmed FROM cur GROUP BY test_id)
SELECT test_id, lsl, usl, {r('psi', 'psi')}, {STATUS}, iqr > 0 AND abs(cmed - hmed) > 1.5 * iqr AS spc_shift, {r('abs(cm - hm) / hs', 'ft_deviation')}, abs(cm - hm) / hs > 2 AS ft_alert, {r('cm', 'current_mean')}, {r('cs', 'current_std')}, {r(CPK.format(m='cm', s='cs'), 'current_cpk')},
 {r('hm', 'history_mean')}, {r('hs', 'history_std')}, {r(CPK.format(m='hm', s='hs'), 'history_cpk')} FROM h JOIN c USING (test_id) JOIN limits USING (test_id) JOIN pmin USING (test_id)"""


@query("shift_summary", f"WITH {SPLIT}, {LIMITS_SQL}, {PAIR.replace('cs AS', 'cspan AS').replace('JOIN cs USING', 'JOIN cspan USING')}, {SHIFT}")
def shift_summary(spark, folder):
    return sets.severity_sort(monitor.shift_summary(*_cur_hist(spark, folder), limits(spark)))


SELECTED = SPLIT.replace("WHERE lot % 10 <> 0", "WHERE lot % 10 = 3")


@query("distribution_shift", f"WITH {SELECTED}, {LIMITS_SQL}, {PAIR.replace('cs AS', 'cspan AS').replace('JOIN cs USING', 'JOIN cspan USING')}, {SHIFT}")
def distribution_shift(spark, folder):
    cur, hist = _cur_hist(spark, folder)
    lots = table(spark, folder, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("lot"))
    return monitor.distribution_shift(cur, hist, limits(spark), lots)


@query("central_range", f"WITH {TESTS_SQL}, q AS (SELECT test_id, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM tests GROUP BY test_id) SELECT test_id, {r('lo - 0.05 * (hi - lo)', 'low')}, {r('hi + 0.05 * (hi - lo)', 'high')} FROM q")
def central_range(spark, folder):
    return profile.central_range(die_tests(spark, folder))


# --- golden baseline --------------------------------------------------------------
YIELD = "ly AS (SELECT lot, 100.0 * count(*) FILTER (is_pass) / count(*) AS yield_pct FROM dies GROUP BY lot), top3 AS (SELECT * FROM ly ORDER BY yield_pct DESC, lot LIMIT 3)"
GOLD = f"{TESTS_SQL}, {YIELD}, gold AS (SELECT test_id, avg(value) AS gm, stddev_samp(value) AS gs FROM tests WHERE lot IN (SELECT lot FROM top3) GROUP BY test_id HAVING count(value) >= 5)"


def lot_yield(spark, folder):
    return dies(spark, folder).groupBy("lot").agg((100.0 * F.count_if("is_pass") / F.count(F.lit(1))).alias("yield_pct"))


def _gold(spark, folder):
    return golden.golden_baseline(die_tests(spark, folder), lot_yield(spark, folder))


@query("golden_baseline", f"WITH {TESTS_SQL}, {YIELD} SELECT test_id, {LTS}, (SELECT round(avg(yield_pct), 6) FROM top3) AS golden_yield FROM tests WHERE lot IN (SELECT lot FROM top3) GROUP BY test_id HAVING count(value) >= 5")
def golden_baseline(spark, folder):
    return _gold(spark, folder)


@query("prediction_baseline", f"""WITH {TESTS_SQL}, ly AS (SELECT lot, wafer, 100.0 * count(*) FILTER (is_pass) / count(*) AS y FROM dies GROUP BY ALL), f AS (SELECT lot, wafer, y FROM ly QUALIFY row_number() OVER (PARTITION BY lot ORDER BY y DESC, CAST(lot AS VARCHAR) || '_' || CAST(wafer AS VARCHAR)) = 1), b AS (SELECT * FROM f ORDER BY y DESC, lot LIMIT 5)
SELECT test_id, {LTS} FROM tests JOIN b USING (lot, wafer) GROUP BY test_id HAVING count(value) >= 5""")
def prediction_baseline(spark, folder):
    name = F.concat_ws("_", F.col("lot").cast("string"), F.col("wafer").cast("string"))
    files = dies(spark, folder).groupBy("lot", name.alias("source_file")).agg((100.0 * F.count_if("is_pass") / F.count(F.lit(1))).alias("yield_pct"))
    return golden.prediction_baseline(die_tests(spark, folder).withColumn("source_file", name), files)


def _candidates(spark, folder):
    return die_tests(spark, folder).groupBy(*LT).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


CAND = "cand AS (SELECT lot, test_id, avg(value) AS m, stddev_samp(value) AS s FROM tests GROUP BY ALL)"


@query("golden_comparison", f"""WITH {GOLD}, {LIMITS_SQL}, c AS (SELECT test_id, avg(value) AS m, CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END AS s FROM tests WHERE lot % 10 = 0 GROUP BY test_id), j AS (SELECT test_id, lsl, usl, gm, gs, coalesce(m, gm) AS m, coalesce(s, gs) AS s FROM gold LEFT JOIN c USING (test_id) LEFT JOIN limits USING (test_id)), z AS (SELECT *, abs(m - gm) / (gs + 1e-9) AS z FROM j)
SELECT test_id, lsl, usl, {r('gm', 'golden_mean')}, {r('gs', 'golden_std')}, {r('m', 'mean')}, {r('s', 'std')}, {r('z', 'deviation_z')}, CASE WHEN m < lsl OR m > usl OR z > 2 THEN 'Out of Spec' WHEN z > 1 THEN 'Marginal' ELSE 'Within Spec' END AS status FROM z""")
def golden_comparison(spark, folder):
    current = die.current_param_stats(die_tests(spark, folder).filter(is_current()))
    return golden.golden_comparison(current, _gold(spark, folder), limits(spark))


@query("golden_correlation", f"WITH {GOLD}, {CAND} SELECT lot, count(*) AS overlap, {r('greatest(least(corr(m, gm), 1), -1)', 'golden_correlation')} FROM cand JOIN gold USING (test_id) GROUP BY lot")
def golden_correlation(spark, folder):
    return golden.golden_correlation(_candidates(spark, folder), _gold(spark, folder), ["lot"])


ZROWS = f"{GOLD}, {CAND}, z AS (SELECT lot, test_id, abs(m - gm) / gs AS z, (m - gm) / (gs + 1e-9) AS sz FROM cand JOIN gold USING (test_id) WHERE gs > 1e-9)"
CLOSE = "greatest(greatest(least(100 - 25 * avg(z), 100), 0) - CASE WHEN max(z) > 1 THEN least(20 + 30 * (max(z) - 1), 80) ELSE 0 END, 0)"


@query("zscore_closeness", f"WITH {ZROWS} SELECT lot, {r('max(z)', 'max_z')}, {r(CLOSE, 'closeness')} FROM z GROUP BY lot")
def zscore_closeness(spark, folder):
    return golden.golden_z_scores(_candidates(spark, folder), _gold(spark, folder), ["lot"])


@query("max_zscore", f"WITH {ZROWS} SELECT lot, {r('max(z)', 'max_z')} FROM z GROUP BY lot")
def max_zscore(spark, folder):
    return golden.golden_z_scores(_candidates(spark, folder), _gold(spark, folder), ["lot"]).select("lot", "max_z")


def _dispositions(spark, folder):
    gold, cand = pin(_gold(spark, folder)), pin(_candidates(spark, folder))
    both = golden.golden_z_scores(cand, gold, ["lot"]).join(golden.golden_correlation(cand, gold, ["lot"]), "lot").join(lot_yield(spark, folder), "lot")
    corr, y, z, c = F.col("golden_correlation"), F.col("yield_pct") / 100, F.col("max_z"), F.col("closeness")
    score = grades.reliability_score(corr, y, probe_corr=corr, probe_closeness=c, final_corr=corr, final_closeness=c, probe_max_z=z, final_max_z=z)
    return both.withColumns({"_s": score, "_y": y})


DISP = f"""{ZROWS}, zz AS (SELECT lot, max(z) AS mz, {CLOSE} AS closeness FROM z GROUP BY lot), gc AS (SELECT lot, corr(m, gm) AS corr FROM cand JOIN gold USING (test_id) GROUP BY lot),
pen AS (SELECT lot, corr, yield_pct / 100 AS y, closeness, CASE WHEN mz > 1 THEN least(20 + 30 * (mz - 1), 80) ELSE 0 END AS pz, CASE WHEN yield_pct < 80 THEN least((0.8 - yield_pct / 100) * 100, 25) ELSE 0 END AS yp FROM zz JOIN gc USING (lot) JOIN ly USING (lot)),
cs AS (SELECT *, greatest(least(greatest(corr, 0) * 100, 100) - pz, 0) AS sc FROM pen), sim AS (SELECT *, 0.5 * sc + 0.5 * closeness AS s FROM cs), fin AS (SELECT *, round(greatest(least(s - yp, 100), 0), 4) AS score FROM sim)"""


@query("reliability_score", f"WITH {DISP} SELECT lot, {r('score', 'risk_score')}, {r('yp', 'yield_penalty')}, {r('s', 'probe_similarity')}, {r('s', 'final_similarity')} FROM fin")
def reliability_score(spark, folder):
    return _dispositions(spark, folder).select("lot", "_s.risk_score", "_s.yield_penalty", "_s.probe_similarity", "_s.final_similarity")


@query("product_grade", f"WITH {DISP} SELECT lot, CASE WHEN y < 0.6 OR corr < 0.2 THEN 'D' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM fin")
def product_grade(spark, folder):
    d = _dispositions(spark, folder)
    return d.select("lot", grades.product_grade(F.col("_s.risk_score"), F.col("golden_correlation"), F.col("_y")).alias("grade"))


THRESHOLDS = {"Z": 0.70, "A": 0.68, "H": 0.66, "I": 0.64, "C": 0.62}


@query("yield_grade", f"""WITH {DIES}, {YIELD}, p AS (SELECT lot, yield_pct / 100 AS y FROM ly), e AS (SELECT lot, y, abs(y - 0.665) AS gap, least(abs(y - 0.7), abs(y - 0.68), abs(y - 0.66), abs(y - 0.64), abs(y - 0.62)) AS near FROM p)
SELECT lot, CASE WHEN y >= 0.7 THEN 'Z' WHEN y >= 0.68 THEN 'A' WHEN y >= 0.66 THEN 'H' WHEN y >= 0.64 THEN 'I' WHEN y >= 0.62 THEN 'C' ELSE 'F' END AS grade,
 {r('greatest(least(0.95 - least(0.2, gap / 0.1 * 0.15) - CASE WHEN near < 0.005 THEN 0.08 WHEN near < 0.015 THEN 0.04 ELSE 0 END, 0.99), 0.8)', 'confidence')} FROM e""")
def yield_grade(spark, folder):
    y = F.col("yield_pct") / 100
    return lot_yield(spark, folder).select("lot", grades.yield_grade(y, THRESHOLDS).alias("grade"), grades.confidence(y, F.lit(0.665), THRESHOLDS).alias("confidence"))


@query("shifted_tests", f"""WITH {ZROWS.replace('gs AS z,', 'gs * 25 AS z,')}, f AS (SELECT lot, test_id, row_number() OVER (PARTITION BY lot ORDER BY test_id) AS k FROM z WHERE z > 2)
SELECT lot, count(*) AS shifted, string_agg(test_id, ', ' ORDER BY test_id) FILTER (k <= 2) || CASE WHEN count(*) > 2 THEN ' (+' || (count(*) - 2) || ' more)' ELSE '' END AS tests FROM f GROUP BY lot""")
def shifted_tests(spark, folder):
    gold = _gold(spark, folder).withColumn("std", F.col("std") / 25)
    return golden.shifted_tests(_candidates(spark, folder), gold, ["lot"], shown=2)


@query("radar_parameters", f"WITH {ZROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY z DESC, test_id) AS rank FROM z) SELECT lot, CAST(rank AS INTEGER) AS rank, test_id, {r('sz', 'signed_z')} FROM k WHERE rank <= 2")
def radar_parameters(spark, folder):
    return golden.radar_parameters(_candidates(spark, folder), _gold(spark, folder), ["lot"], k=2)


@query("golden_overlap", f"WITH {GOLD}, {CAND} SELECT lot, test_id, {r('m', 'mean')}, {r('gm', 'golden_mean')} FROM cand JOIN gold USING (test_id)")
def golden_overlap(spark, folder):
    return joins.golden_overlap(_candidates(spark, folder), _gold(spark, folder)).select("lot", "test_id", "mean", "golden_mean")


@query("golden_fallback", f"""WITH {GOLD}, c AS (SELECT test_id, avg(value) AS m FROM tests WHERE lot % 10 = 0 AND test_id NOT IN ('tax', 'discount') GROUP BY test_id), a AS (SELECT test_id, avg(value) AS am FROM tests WHERE lot % 10 = 1 AND test_id <> 'discount' GROUP BY test_id)
SELECT test_id, {r('gm', 'golden_mean')}, {r('coalesce(m, am, gm)', 'mean')} FROM gold LEFT JOIN c USING (test_id) LEFT JOIN a USING (test_id)""")
def golden_fallback(spark, folder):
    rows = die_tests(spark, folder)
    current = die.current_param_stats(rows.filter(is_current())).filter("test_id NOT IN ('tax', 'discount')")
    actual = die.current_param_stats(rows.filter("lot % 10 = 1")).filter("test_id <> 'discount'")
    return joins.golden_fallback(_gold(spark, folder), current, actual).select("test_id", "golden_mean", "mean")


@query("yield_ensemble", f"""WITH {DIES}, s AS (SELECT lot, count(*) FILTER (is_pass) / count(*) AS share FROM dies GROUP BY lot), m AS (SELECT lot, share, unnest([share, share * 100, -1.0]) AS p FROM s)
SELECT lot, {r('avg(greatest(least(CASE WHEN p <= 0 AND share > 0 THEN share * 100 * 0.92 WHEN p > 1 THEN p WHEN p > 0 THEN p * 100 ELSE 0 END, 100), 0) / 100)', 'yield_prediction')}, count(*) AS models FROM m GROUP BY lot""")
def yield_ensemble(spark, folder):
    share = lot_yield(spark, folder).select("lot", (F.col("yield_pct") / 100).alias("pass_share"))
    rows = share.withColumn("predicted", F.explode(F.array(F.col("pass_share"), F.col("pass_share") * 100, F.lit(-1.0))))
    return golden.yield_ensemble(rows, ["lot"])


@query("baseline_yield", f"WITH {DIES}, {YIELD} SELECT lot, {r('coalesce(CASE WHEN lot % 3 = 0 THEN yield_pct / 100 END, CASE WHEN lot % 3 = 1 THEN 0.9 END, 0.8)', 'baseline_yield')} FROM ly")
def baseline_yield(spark, folder):
    final = F.when(F.col("lot") % 3 == 0, F.col("yield_pct")).otherwise(0.0)
    probe = F.when(F.col("lot") % 3 == 1, 90.0)
    return lot_yield(spark, folder).select("lot", golden.baseline_yield(final, probe, F.lit(0.8)).alias("baseline_yield"))


# --- wafer maps -------------------------------------------------------------------
GRID = """g AS (SELECT l_suppkey % 5 AS wafer, l_orderkey % 120 AS x, l_orderkey // 120 AS y, (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS ord, l_returnflag <> 'R' AS ok FROM lineitem),
die AS (SELECT wafer, x, y, arg_max(ok, ord) AS is_pass FROM g GROUP BY ALL), off AS (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i) WHERE NOT (a.i = 0 AND b.i = 0)),
nb AS (SELECT d.wafer, d.x, d.y, any_value(d.is_pass) AS is_pass, count(n.x) AS neighbours, count(*) FILTER (n.is_pass = false) AS bad_neighbours FROM die d CROSS JOIN off LEFT JOIN die n ON n.wafer = d.wafer AND n.x = d.x + dx AND n.y = d.y + dy GROUP BY ALL),
fl AS (SELECT *, is_pass AND neighbours >= 4 AND bad_neighbours >= 0.75 * neighbours AS gdbn_flag FROM nb), box AS (SELECT wafer, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM die GROUP BY wafer),
ed AS (SELECT fl.*, (x <= x0 + 2 OR x >= x1 - 2 OR y <= y0 + 2 OR y >= y1 - 2) AND NOT is_pass AS edge_fail FROM fl JOIN box USING (wafer))"""


def die_grid(spark, folder):
    order = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    x, y = F.col("l_orderkey") % 120, F.floor(F.col("l_orderkey") / 120)
    rows = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 5).alias("wafer"), x.alias("x"), y.alias("y"), (F.col("l_returnflag") != "R").alias("ok"), *order)
    # Few rows share a position: they are dealt out first, so that no task sorts all it has read.
    return rows.repartition("wafer", "x", "y").groupBy("wafer", "x", "y").agg(F.max_by("ok", F.struct(*order)).alias("is_pass"), F.lit(0).alias("row"))


@query("neighbour_join", f"WITH {GRID} SELECT wafer, x, y, neighbours, bad_neighbours FROM nb")
def neighbour_join(spark, folder):
    return spatial.neighbour_join(die_grid(spark, folder))


@query("gdbn", f"WITH {GRID} SELECT wafer, x, y, is_pass, neighbours, bad_neighbours, gdbn_flag FROM fl")
def gdbn(spark, folder):
    return spatial.gdbn(die_grid(spark, folder)).drop("row")


@query("edge_fails", f"WITH {GRID} SELECT wafer, x, y, edge_fail FROM ed")
def edge_fails(spark, folder):
    return spatial.edge_fails(die_grid(spark, folder)).select("wafer", "x", "y", "edge_fail")


@query("spatial_summary", f"""WITH {GRID} SELECT wafer, count(*) AS total_dies, count(*) FILTER (is_pass) AS good_dies, count(*) FILTER (gdbn_flag) AS gdbn_count, count(*) FILTER (edge_fail) AS edge_fail_count, {r('(count(*) - count(*) FILTER (is_pass)) / count(*)', 'fail_density')},
 {r('count(*) FILTER (gdbn_flag) / count(*)', 'gdbn_ratio_all')}, {r('count(*) FILTER (gdbn_flag) / count(*) FILTER (is_pass)', 'gdbn_rate_good')} FROM ed GROUP BY wafer""")
def spatial_summary(spark, folder):
    return spatial.spatial_summary(die_grid(spark, folder))


@query("wafer_map", f"""WITH {GRID} SELECT wafer, count(*) AS dies, count(*) FILTER (is_pass AND NOT gdbn_flag) AS pass_dies, count(*) FILTER (NOT is_pass) AS fail_dies, count(*) FILTER (gdbn_flag) AS gdbn_dies, {r('100.0 * count(*) FILTER (is_pass AND NOT gdbn_flag) / count(*)', 'yield_pct')} FROM fl GROUP BY wafer""")
def wafer_map(spark, folder):
    return spatial.wafer_map_counts(spatial.gdbn(die_grid(spark, folder)))


@query("wafer_status", f"WITH {GRID} SELECT wafer, x, y, CASE WHEN gdbn_flag THEN 'GDBN Risk' WHEN NOT is_pass THEN 'Fail' ELSE 'Pass' END AS status FROM fl")
def wafer_status(spark, folder):
    return spatial.wafer_map(spatial.gdbn(die_grid(spark, folder))).select("wafer", "x", "y", "status")


