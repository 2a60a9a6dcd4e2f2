"""Join, set, sort, profile and name-rule queries on the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.base import SCORED, query, r, scored, table
from yieldloom.functions import numeric, text
from yieldloom.operators import cleaning, contracts, joins, profile, sets

def _rows():
    return F.count(F.lit(1)).alias("rows")


# --- joins --------------------------------------------------------------------
def per_order(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))


@query("join_one_to_one", f"""WITH a AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) SELECT o_orderkey, {r('quantity', 'quantity')}, {r('o_totalprice', 'o_totalprice')} FROM a JOIN orders USING (o_orderkey)""")
def join_one_to_one(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return joins.join_one_to_one(per_order(spark, folder).select("o_orderkey", "quantity"), orders, ["o_orderkey"])


@query("join_many_to_one", f"SELECT p_brand, count(*) AS rows, {r('sum(l_quantity)', 'quantity')} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_many_to_one(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = joins.join_many_to_one(table(spark, folder, "lineitem").select("l_partkey", "l_quantity"), part, ["l_partkey"])
    return out.groupBy("p_brand").agg(_rows(), F.sum("l_quantity").alias("quantity"))


@query("join_label_complete", "SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id)")
def join_label_complete(spark, folder):
    return joins.join_label_complete(table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels").select("doc_id", "quality"), ["doc_id"])


@query("join_folds_left", "SELECT c_custkey, CAST(c_nationkey % 5 AS INTEGER) AS fold FROM customer")
def join_folds_left(spark, folder):
    folds = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 5).alias("fold"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "k")
    per_customer = rows.join(folds, "c_nationkey").select("k", "fold")
    return joins.join_folds_left(rows.select("k"), per_customer, ["k"]).withColumnRenamed("k", "c_custkey")


@query("align_probability", f"WITH {SCORED} SELECT c_custkey, {r('probability', 'probability')} FROM customer LEFT JOIN scored ON c_custkey = wafer AND wafer % 3 <> 0")
def align_probability(spark, folder):
    ref = table(spark, folder, "customer").select("c_custkey")
    source = scored(spark, folder).filter("wafer % 3 <> 0").select(F.col("wafer").alias("c_custkey"), "probability")
    return joins.align_probability(ref, source, "probability", ["c_custkey"])


@query("probe_final_join", f"""WITH a AS (SELECT l_suppkey AS parent_folder, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS parent_folder, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT parent_folder, {r('a.m', 'TP_m')}, {r('b.m', 'FT_m')} FROM a JOIN b USING (parent_folder)""")
def probe_final_join(spark, folder):
    side = lambda cond: table(spark, folder, "lineitem").filter(cond).groupBy(F.col("l_suppkey").alias("parent_folder")).agg(F.avg("l_quantity").alias("m"))
    return joins.probe_final_join(side("l_returnflag = 'A'"), side("l_returnflag <> 'A'"))


@query("match_final_test_file", """WITH p AS (SELECT p_partkey AS k, 'P' || (p_partkey % 700) || CASE WHEN p_partkey % 3 = 0 THEN '_x' ELSE '' END AS pre, 'L' || (p_partkey % 300) || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END AS lot FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT 'P' || (p_partkey % 500) AS pre, 'P' || (p_partkey % 500) || '_FIN_' || p_partkey || '.csv' AS filename, 'L' || (p_partkey % 100) || CASE WHEN p_partkey % 4 = 1 THEN '.2' ELSE '' END AS lot FROM part WHERE p_partkey % 2 = 1),
a AS (SELECT pre, min(filename) AS h FROM f GROUP BY pre), b AS (SELECT lot, min(filename) AS h FROM f GROUP BY lot), c AS (SELECT split_part(lot, '.', 1) AS lot, min(filename) AS h FROM f GROUP BY 1)
SELECT p.k, coalesce(a.h, b.h, c.h) AS final_filename FROM p LEFT JOIN a ON upper(p.pre) = a.pre LEFT JOIN b ON p.lot = b.lot LEFT JOIN c ON split_part(p.lot, '.', 1) = c.lot""")
def match_final_test_file(spark, folder):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    part = table(spark, folder, "part")
    mark = F.when(k % 3 == 0, "_x").otherwise("")
    probe = part.filter(k % 2 == 0).select(
        k.alias("k"), F.concat(F.lit("P"), s(k % 700), mark, F.lit("_PRB_1.csv")).alias("filename"), F.concat(F.lit("L"), s(k % 300), F.when(k % 2 == 0, ".1").otherwise("")).alias("lot_id")
    )
    final = part.filter(k % 2 == 1).select(
        F.concat(F.lit("P"), s(k % 500), F.lit("_FIN_"), s(k), F.lit(".csv")).alias("filename"), F.concat(F.lit("L"), s(k % 100), F.when(k % 4 == 1, ".2").otherwise("")).alias("lot_id")
    )
    return joins.match_final_test_file(probe, final).select("k", "final_filename")


@query("matched_keys", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def matched_keys(spark, folder):
    li = table(spark, folder, "lineitem")
    return joins.matched_keys([li.filter(F.col("l_returnflag") == f) for f in "ANR"], ["l_suppkey", "l_partkey"])


@query("unmatched_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_keys(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched_keys(table(spark, folder, "orders"), li, ["o_orderkey"])


@query("replace_keys", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_returnflag = 'R'")
def replace_keys(spark, folder):
    new = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("new").alias("o_orderstatus")).distinct()
    return joins.replace_keys(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@query("limit_lookup", """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'T1.0' WHEN 1 THEN 't1 0' WHEN 2 THEN 'T2.0' ELSE 'none' END AS test_id FROM part)
SELECT p_partkey, CASE WHEN test_id IN ('T1.0', 't1 0') THEN 1.14 WHEN test_id = 'T2.0' THEN NULL END::DOUBLE AS lsl, CASE WHEN test_id IN ('T1.0', 't1 0') THEN 1.26 WHEN test_id = 'T2.0' THEN 5 END::DOUBLE AS usl FROM t""")
def limit_lookup(spark, folder):
    k = F.col("p_partkey") % 4
    tests = table(spark, folder, "part").select("p_partkey", F.when(k == 0, "T1.0").when(k == 1, "t1 0").when(k == 2, "T2.0").otherwise("none").alias("test_id"))
    lims = spark.createDataFrame([("T1.0", 1.14, 1.26), ("T2.0", None, 5.0)], "test_id string, lsl double, usl double")
    return joins.limit_lookup(tests, lims).drop("test_id")


def _norm_sql(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '[^a-z0-9_]+', '_', 'g')"


# By the length of the name: known under it, known under its plain form, starting like a limit's key, or left to the other rules.
@query("current_test_mapping", f"""WITH c AS (SELECT DISTINCT p_type AS "column", {_norm_sql('p_type')} AS n, length(p_type) % 4 AS g FROM part),
e AS (SELECT "column" AS name, 'X ' || "column" AS id FROM c WHERE g = 0 UNION ALL SELECT 'other ' || "column", lower("column") FROM c WHERE g = 1),
lo AS (SELECT {_norm_sql('id')} AS n, min(id) AS id FROM e GROUP BY 1), k AS (SELECT DISTINCT split_part("column", ' ', 1) || ' ' || split_part("column", ' ', 2) AS l FROM c WHERE g = 2),
p AS (SELECT "column", min(l) AS l FROM c JOIN k ON starts_with(n, {_norm_sql('l')}) OR starts_with({_norm_sql('l')}, n) GROUP BY 1)
SELECT c."column", coalesce(e.id, lo.id, p.l, c.n) AS test_id FROM c LEFT JOIN e ON e.name = c."column" LEFT JOIN lo ON lo.n = c.n LEFT JOIN p ON p."column" = c."column" """)
def current_test_mapping(spark, folder):
    c = table(spark, folder, "part").select(F.col("p_type").alias("column")).distinct().withColumn("g", F.length("column") % 4)
    exact = c.filter("g = 0").select(F.col("column").alias("name"), F.concat(F.lit("X "), "column").alias("test_id"))
    loose = c.filter("g = 1").select(F.concat(F.lit("other "), "column").alias("name"), F.lower("column").alias("test_id"))
    limits = c.filter("g = 2").select(F.concat(F.split_part("column", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("column", F.lit(" "), F.lit(2))).alias("limit_key"))
    return joins.current_test_mapping(c.select("column"), exact.unionByName(loose), limits)


@query("positional_align_check", "SELECT CAST(20 * (SELECT count(*) FROM nation) AS BIGINT) * 0 + (SELECT count(*) FROM events) AS left_rows, (SELECT count(*) FROM events WHERE event_id % 50 <> 0) AS right_rows, (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS unaligned_rows, CAST(0 AS BIGINT) AS repeated_left_times")
def positional_align_check(spark, folder):
    ev = table(spark, folder, "events").select(F.col("event_id").alias("time"))
    return joins.positional_align_check(ev, ev.filter("time % 50 <> 0"))


@query("align_trace_to_features", "SELECT user_id, count(*) AS rows FROM events WHERE user_id % 3 = 0 GROUP BY user_id")
def align_trace_to_features(spark, folder):
    ev = table(spark, folder, "events").select("user_id", "event_id")
    return joins.align_trace_to_features(ev, ev.filter("user_id % 3 = 0"), ["user_id"]).groupBy("user_id").agg(_rows())


@query("verify_label_identity", f"WITH {SCORED} SELECT count(*) AS compared, count(*) FILTER (wafer % 11 = 0) AS response_mismatches, count(*) FILTER (wafer % 13 = 0) AS class_mismatches FROM scored")
def verify_label_identity(spark, folder):
    a = scored(spark, folder).select("lot", "wafer", "response", F.when(F.col("actual_bad") == 1, "bad").otherwise("good").alias("class"))
    b = a.withColumns({"response": F.col("response") + F.when(F.col("wafer") % 11 == 0, 1e-3).otherwise(0.0), "class": F.when(F.col("wafer") % 13 == 0, "other").otherwise(F.col("class"))})
    return joins.verify_label_identity(a, b)


@query("key_number_dataset", f"""WITH {SCORED} SELECT wafer, {r('response', 'response')}, CAST(sum(i * wafer) AS BIGINT) AS checksum FROM scored, range(1, 51) AS g(i) WHERE wafer % 2 = 0 GROUP BY wafer, response""")
def key_number_dataset(spark, folder):
    keys = scored(spark, folder).select("lot", "wafer")
    first = keys.select("lot", "wafer", *[(F.col("wafer") * i).alias(f"KN{i}") for i in range(1, 26)])
    second = keys.select("lot", "wafer", *[(F.col("wafer") * i).alias(f"KN{i}") for i in range(26, 51)])
    labels = scored(spark, folder).select("lot", "wafer", "response")
    out = joins.key_number_dataset(first.unionByName(first), second, labels, keys.filter("wafer % 2 = 0"))
    return out.select("wafer", "response", sum((F.col(f"KN{i}") for i in range(2, 51)), F.col("KN1")).alias("checksum"))


@query("table_diff", f"""WITH d AS (SELECT o_orderkey, o_totalprice AS b, o_totalprice + CASE WHEN o_orderkey % 1000 = 0 THEN 0.25 ELSE 0 END AS a FROM orders)
SELECT 'o_totalprice' AS "column", count(*) AS rows_before, count(*) AS rows_after, count(*) AS rows_matched, count(*) FILTER (a <> b) AS mismatches, {r('max(abs(a - b))', 'max_abs_diff')}, false AS equal FROM d
UNION ALL SELECT 'o_orderstatus', count(*), count(*), count(*), 0, NULL, true FROM d""")
def table_diff(spark, folder):
    before = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    after = before.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 1000 == 0, 0.25).otherwise(0.0))
    return joins.table_diff(before, after, ["o_orderkey"])


@query("resolve_limits", """SELECT DISTINCT l_returnflag AS product, l_suppkey AS lot, CASE WHEN l_suppkey % 4 = 0 AND l_returnflag <> 'N' THEN l_returnflag || '_lot' || l_suppkey WHEN l_returnflag <> 'R' THEN l_returnflag || '_shared' END AS limit_file FROM lineitem""")
def resolve_limits(spark, folder):
    wafers = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("product"), F.col("l_suppkey").alias("lot")).distinct()
    own = wafers.filter("lot % 4 = 0 AND product <> 'N'").select("product", "lot", F.concat("product", F.lit("_lot"), F.col("lot").cast("string")).alias("limit_file"))
    shared = wafers.select("product").distinct().filter("product <> 'R'").select("product", F.lit(None).cast("long").alias("lot"), F.concat("product", F.lit("_shared")).alias("limit_file"))
    return joins.resolve_limits(wafers, own.unionByName(shared))


# --- contracts and labels -------------------------------------------------------
LABELS = "SELECT c_nationkey AS lot, c_custkey AS wafer, response, CASE WHEN response > 250 THEN 'bad' ELSE 'good' END AS class FROM customer JOIN avgs ON c_custkey = o_custkey"


def label_rows(spark, folder):
    rows = scored(spark, folder).select("lot", "wafer", "response", F.when(F.col("actual_bad") == 1, "bad").otherwise("good").alias("class"))
    return rows.unionByName(rows.filter("wafer % 2 = 0"))


@query("dedupe_labels", f"WITH {SCORED} SELECT CAST(lot AS VARCHAR) AS lot, CAST(wafer AS VARCHAR) AS wafer, {r('response', 'response')}, CASE WHEN actual_bad = 1 THEN 'bad' ELSE 'good' END AS class FROM scored")
def dedupe_labels(spark, folder):
    return cleaning.dedupe_labels(label_rows(spark, folder), 250.0)


@query("label_summary", f"WITH {SCORED} SELECT CAST(count(*) + count(*) FILTER (wafer % 2 = 0) AS BIGINT) AS raw_response_rows, count(*) AS unique_response_wafers, count(*) FILTER (wafer % 2 = 0) AS exact_duplicate_rows, 2 * count(*) FILTER (wafer % 2 = 0) AS duplicate_key_rows, CAST(0 AS BIGINT) AS conflicting_keys FROM scored")
def label_summary(spark, folder):
    return cleaning.label_summary(label_rows(spark, folder))


@query("conflict_keys", "SELECT l_orderkey, list_filter(['l_suppkey', 'l_returnflag'], lambda c: (c = 'l_suppkey' AND a) OR (c = 'l_returnflag' AND b)) AS conflicting FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) > 1 AS a, count(DISTINCT l_returnflag) > 1 AS b FROM lineitem GROUP BY l_orderkey) WHERE a OR b")
def conflict_keys(spark, folder):
    return contracts.conflict_keys(table(spark, folder, "lineitem"), ["l_orderkey"], ["l_suppkey", "l_returnflag"])


@query("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, folder):
    return cleaning.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dataset_summary", f"""WITH {SCORED}, l AS (SELECT lot, count(*) AS n, sum(actual_bad) AS b FROM scored GROUP BY lot)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS lots, CAST(sum(n) AS BIGINT) AS wafers, CAST(sum(n - b) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS bad, count(*) FILTER (b = 0 OR b = n) AS single_class_lots, {r('sum(b) / sum(n)', 'bad_rate')} FROM l""")
def dataset_summary(spark, folder):
    return cleaning.dataset_summary(scored(spark, folder), bad="actual_bad")


@query("validate_trace_contract", "SELECT count(*) AS rows, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS unknown_stage_rows, count(*) FILTER (l_partkey % 100 = 0) AS null_key_rows FROM lineitem")
def validate_trace_contract(spark, folder):
    li = table(spark, folder, "lineitem").select(F.when(F.col("l_partkey") % 100 != 0, F.col("l_partkey")).alias("WAFER_ID"), F.col("l_returnflag").alias("STAGE"), F.col("l_orderkey").alias("TIMESTAMP"))
    return contracts.validate_trace_contract(li, ["WAFER_ID", "STAGE", "TIMESTAMP"], stages=("A", "N"))


@query("class_from_response", f"WITH {SCORED} SELECT wafer, CAST(response > 250 AS INTEGER) AS bad FROM scored")
def class_from_response(spark, folder):
    return scored(spark, folder).select("wafer", numeric.class_from_response(F.col("response"), 250.0).alias("bad"))


@query("inf_to_null", f"SELECT event_id, CASE WHEN event_id % 3 = 1 THEN {r('value', 'v').split(' AS ')[0]} END AS v FROM events")
def inf_to_null(spark, folder):
    m = F.col("event_id") % 3
    raw = F.when(m == 0, float("nan")).when(m == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", numeric.inf_to_null(raw).alias("v"))


@query("logit_clip", f"SELECT c_custkey, {r('ln(greatest(least((c_acctbal + 1000) / 11000, 1 - 1e-6), 1e-6) / greatest(least(1 - (c_acctbal + 1000) / 11000, 1.0), 1e-6))', 'logit')}, {r('greatest(least((c_acctbal + 1000) / 11000, 0.8), 0.2)', 'clipped')} FROM customer")
def logit_clip(spark, folder):
    p = (F.col("c_acctbal") + 1000) / 11000
    return table(spark, folder, "customer").select("c_custkey", numeric.logit(p).alias("logit"), numeric.clip(p, 0.2, 0.8).alias("clipped"))


# --- sorts, limits and sets -------------------------------------------------------
@query("latest_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, folder):
    out = sets.latest_per_key(table(spark, folder, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return out.select("o_custkey", "o_orderkey")


@query("best_per_group", "SELECT l_suppkey, l_returnflag, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL")
def best_per_group(spark, folder):
    out = sets.best_per_group(table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag"], F.desc("l_extendedprice"))
    return out.select("l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("price"))


@query("rank_models", "SELECT s_nationkey, s_name AS model, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS INTEGER) AS rank FROM supplier")
def rank_models(spark, folder):
    rows = table(spark, folder, "supplier").select("s_nationkey", F.col("s_name").alias("model"), F.col("s_acctbal").alias("r2"))
    return sets.rank_models(rows, ["s_nationkey"]).drop("r2")


@query("evidence_views", "SELECT p_brand AS feature_set, p_name AS model FROM part WHERE p_size > 10 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name) = 1")
def evidence_views(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_brand").alias("feature_set"), F.col("p_name").alias("model"), F.col("p_retailprice").alias("r2"), (F.col("p_size") > 10).alias("active"))
    return sets.evidence_views(rows, active=True).select("feature_set", "model")


@query("top_k", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k(spark, folder):
    return sets.top_k(table(spark, folder, "orders"), 15, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")


@query("head_n", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200")
def head_n(spark, folder):
    return sets.head_n(table(spark, folder, "orders"), 200, "o_orderkey").select("o_orderkey")


@query("order_by_keys", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey")
def order_by_keys(spark, folder):
    return sets.order_by_keys(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("natural_sort", "SELECT DISTINCT 'T' || p_size || '.' || (p_partkey % 12) AS test_id, p_size AS major, CAST(p_partkey % 12 AS INTEGER) AS minor FROM part")
def natural_sort(spark, folder):
    name = F.concat(F.lit("T"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    out = sets.natural_sort(table(spark, folder, "part").select(name.alias("test_id")).distinct())
    return out.withColumn("_k", text.test_order(F.col("test_id"))).select("test_id", "_k.major", "_k.minor")


@query("severity_sort", "SELECT c_custkey AS test_id, CASE WHEN c_acctbal > 5000 THEN 'Major Shift' WHEN c_acctbal > 0 THEN 'Minor Shift' ELSE 'Normal' END AS psi_status FROM customer")
def severity_sort(spark, folder):
    b = F.col("c_acctbal")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("test_id"), F.when(b > 5000, "Major Shift").when(b > 0, "Minor Shift").otherwise("Normal").alias("psi_status"))
    return sets.severity_sort(rows)


@query("union_by_name", "SELECT c_custkey AS k, c_mktsegment AS seg, NULL::INTEGER AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_by_name(spark, folder):
    return sets.union_by_name([table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")), table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))])


@query("intersect_columns", "SELECT l_partkey AS test_id FROM lineitem WHERE l_suppkey % 10 = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 10 = 1")
def intersect_columns(spark, folder):
    li = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "test_id")
    return sets.intersect_columns(li.filter("l_suppkey % 10 = 0"), li.filter("l_suppkey % 10 = 1"))


@query("except_keys", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(spark, folder):
    o = table(spark, folder, "orders")
    return sets.except_keys(o, o.filter("o_orderstatus = 'F'"), ["o_custkey"])


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(spark, folder):
    return sets.distinct_keys(table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("disjoint_check", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING min(l_orderkey % 2) <> max(l_orderkey % 2)")
def disjoint_check(spark, folder):
    return sets.shared_groups(table(spark, folder, "lineitem").withColumn("side", F.col("l_orderkey") % 2), "l_suppkey", "side")


@query("prefix_columns", "SELECT p_partkey, 'TP_' || p_brand AS feature FROM part")
def prefix_columns(spark, folder):
    return sets.prefix_columns(table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("feature")), "TP_")


@query("align_feature_schema", f"SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, NULL::DOUBLE AS absent, {r('p_retailprice', 'p_retailprice')} FROM part")
def align_feature_schema(spark, folder):
    return sets.align_feature_schema(table(spark, folder, "part"), ["p_size", "absent", "p_retailprice"], ["p_partkey"])


@query("sanitize_feature_names", """WITH c AS (SELECT p_partkey AS position, p_type || ' [' || (p_size % 5) || ']' AS name FROM part), s AS (SELECT position, name, regexp_replace(regexp_replace(replace(replace(name, '[', '('), ']', ')'), '\\s+', '_', 'g'), '[^0-9a-zA-Z_().:+-]', '_', 'g') AS clean FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY position) - 1 AS seen FROM s)
SELECT position, name, CASE WHEN seen > 0 THEN clean || '__' || seen ELSE clean END AS clean FROM k""")
def sanitize_feature_names(spark, folder):
    name = F.concat("p_type", F.lit(" ["), (F.col("p_size") % 5).cast("string"), F.lit("]"))
    return sets.sanitize_feature_names(table(spark, folder, "part").select(F.col("p_partkey").alias("position"), name.alias("name")))


@query("metric_summary", f"SELECT l_returnflag AS dataset, l_linestatus AS variant, {r('avg(l_discount)', 'accuracy')}, {r('avg(l_tax)', 'f1')} FROM lineitem GROUP BY ALL")
def metric_summary(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("variant"), F.col("l_discount").alias("accuracy"), F.col("l_tax").alias("f1"))
    return sets.metric_summary(rows)


STATUS = """m AS (SELECT s_nationkey AS product, s_name AS model, s_acctbal / 10000 AS r2 FROM supplier WHERE s_acctbal > 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY r2 DESC, model) AS INTEGER) AS rank FROM m),
st AS (SELECT n_nationkey AS product, rank, model, r2, CASE WHEN model IS NULL THEN 'N/A' WHEN r2 > 0.5 THEN 'Yes' ELSE 'No' END AS r2_above_half FROM nation LEFT JOIN k ON n_nationkey = product AND rank <= 3)"""


def _status(spark, folder):
    products = table(spark, folder, "nation").select(F.col("n_nationkey").alias("product"))
    results = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("product"), F.col("s_name").alias("model"), (F.col("s_acctbal") / 10000).alias("r2"))
    return sets.status_table(products, results)


@query("status_table", f"WITH {STATUS} SELECT product, rank, model, {r('r2', 'r2')}, r2_above_half FROM st")
def status_table(spark, folder):
    return _status(spark, folder)


@query("duration_summary", f"WITH {STATUS} SELECT count(DISTINCT product) AS products, count(*) FILTER (rank = 1) AS models, count(*) FILTER (rank = 1 AND r2_above_half = 'Yes') AS good_models, {r('100.0 * count(*) FILTER (rank = 1 AND r2 > 0.5) / count(*) FILTER (rank = 1)', 'good_percent')} FROM st")
def duration_summary(spark, folder):
    return sets.duration_summary(_status(spark, folder))


# --- profiles -------------------------------------------------------------------
@query("dataset_profile", """SELECT count(*) AS rows, CAST(4 AS INTEGER) AS columns, CAST(2 AS INTEGER) AS numeric_columns, count(*) FILTER (l_tax <= 0.02) AS missing_cells, round(count(*) FILTER (l_tax <= 0.02) / (count(*) * 4), 6) AS missing_rate,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_tax > 0.02 THEN l_tax END)) AS duplicate_rows FROM lineitem""")
def dataset_profile(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("l_tax"))
    return profile.dataset_profile(rows)


@query("column_profile", """SELECT 'c_mktsegment' AS "column", 'string' AS source_type, count(*) AS non_null, CAST(0 AS BIGINT) AS missing, 0.0::DOUBLE AS missing_rate, count(DISTINCT c_mktsegment) AS "unique", (SELECT string_agg(c_mktsegment, ' | ' ORDER BY c_mktsegment) FROM (SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 3)) AS examples FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(*), 0, 0.0, count(DISTINCT c_nationkey), (SELECT string_agg(k, ' | ' ORDER BY k) FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS k FROM customer ORDER BY 1 LIMIT 3)) FROM customer""")
def column_profile(spark, folder):
    return profile.column_profile(table(spark, folder, "customer").select("c_mktsegment", "c_nationkey"))


@query("value_counts", "SELECT coalesce(CASE WHEN p_size > 5 THEN p_brand END, '(missing)') AS value, count(*) AS rows FROM part GROUP BY 1 ORDER BY rows DESC, value LIMIT 25")
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "part").select(F.when(F.col("p_size") > 5, F.col("p_brand")).alias("b")), "b")


NUM = ("l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")


@query("target_correlations", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_quantity) AS v FROM lineitem" for c in NUM) + f") SELECT feature, {r('v', 'pearson_r')} FROM c ORDER BY abs(v) DESC LIMIT 3")
def target_correlations(spark, folder):
    return profile.target_correlations(table(spark, folder, "lineitem"), "l_quantity", NUM, 3)


@query("correlation_audit", "WITH c AS (SELECT l_quantity AS response, CAST(l_returnflag = 'R' AS INTEGER) AS bad, unnest(['price', 'discount', 'tax']) AS feature, unnest([l_extendedprice, l_discount, l_tax]) AS value FROM lineitem), s AS (SELECT 'all' AS subset, * FROM c UNION ALL SELECT CASE WHEN bad = 1 THEN 'bad' ELSE 'good' END, * FROM c), a AS (SELECT subset, feature, corr(value, response) AS v FROM s GROUP BY ALL) "
+ f"SELECT subset, feature, {r('v', 'pearson_r')}, {r('abs(v)', 'abs_pearson_r')}, CAST(row_number() OVER (PARTITION BY subset ORDER BY abs(v) DESC, feature) AS INTEGER) AS rank FROM a")
def correlation_audit(spark, folder):
    wide = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("response"), (F.col("l_returnflag") == "R").cast("int").alias("bad"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return profile.correlation_audit(wide.unpivot(["response", "bad"], ["price", "discount", "tax"], "feature", "value"))


@query("histogram", f"""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, lo, (hi - lo) / 40 AS w FROM lineitem, s), t AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, bin, {r('any_value(lo) + bin * any_value(w)', 'bin_start')}, count(*) AS rows, {r('count(*) / (any_value(n) * any_value(w)) * 1000', 'density')} FROM b JOIN t USING (l_returnflag) GROUP BY l_returnflag, bin""")
def histogram(spark, folder):
    out = profile.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 40, ["l_returnflag"])
    return out.withColumn("density", F.col("density") * 1000)


@query("numeric_columns", "SELECT unnest(['p_partkey', 'p_size', 'p_retailprice', 'as_text']) AS \"column\"")
def numeric_columns(spark, folder):
    part = table(spark, folder, "part").withColumn("as_text", F.col("p_size").cast("string"))
    return spark.createDataFrame([(c,) for c in profile.numeric_columns(part)], "column string")


@query("analyzable_numeric", f"SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, {r('p_retailprice', 'price_text')} FROM part")
def analyzable_numeric(spark, folder):
    price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    part = table(spark, folder, "part").select("p_partkey", price.alias("price_text"), "p_brand", F.lit(1).alias("one"))
    return profile.analyzable_numeric(part)


@query("share_observed", "WITH f AS (SELECT user_id, event_type || CASE WHEN user_id % 25 = 0 THEN '_rare' ELSE '' END AS feature FROM events), d AS (SELECT DISTINCT user_id, feature FROM f), t AS (SELECT count(DISTINCT user_id) AS n FROM f), k AS (SELECT feature FROM d, t GROUP BY feature, n HAVING count(*) >= greatest(5, n * 0.2)) SELECT feature, count(*) AS rows FROM d JOIN k USING (feature) GROUP BY feature")
def share_observed(spark, folder):
    rare = F.when(F.col("user_id") % 25 == 0, "_rare").otherwise("")
    rows = table(spark, folder, "events").select("user_id", F.concat("event_type", rare).alias("feature")).distinct().withColumn("value", F.lit(1.0))
    return profile.share_observed(rows, ["user_id"]).groupBy("feature").agg(_rows())


@query("valid_target_rows", f"""WITH v AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS b FROM lineitem), f AS (SELECT * FROM v WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT l_partkey, count(*) AS rows, {r('sum(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM f)))', 'a')}, {r('sum(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM f)))', 'b')} FROM f GROUP BY l_partkey""")
def valid_target_rows(spark, folder):
    k = F.col("l_partkey")
    rows = table(spark, folder, "lineitem").select("l_partkey", F.when(k % 2 == 0, F.col("l_quantity")).alias("a"), F.when(k % 3 == 0, F.col("l_tax")).alias("b"))
    return profile.valid_target_rows(rows, ["a", "b"]).groupBy("l_partkey").agg(_rows(), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("target_structure", f"""WITH {SCORED}, m AS (SELECT *, avg(response) OVER (PARTITION BY actual_bad) AS cm, avg(response) OVER (PARTITION BY lot) AS lm, avg(response) OVER () AS g FROM scored)
SELECT {r('min(response)', 'response_min')}, {r('max(response)', 'response_max')}, {r('stddev_samp(response)', 'response_std')}, {r('1 - sum((response - cm) ** 2) / sum((response - g) ** 2)', 'class_mean_oracle_r2')}, {r('1 - sum((response - lm) ** 2) / sum((response - g) ** 2)', 'lot_mean_oracle_r2')},
 {r('stddev_samp(response) FILTER (actual_bad = 0)', 'good_response_std')}, {r('stddev_samp(response) FILTER (actual_bad = 1)', 'bad_response_std')}, count(*) FILTER (actual_bad = 0) AS good_wafers, count(*) FILTER (actual_bad = 1) AS bad_wafers FROM m""")
def target_structure(spark, folder):
    return profile.target_structure(scored(spark, folder), bad="actual_bad")


# --- name rules -----------------------------------------------------------------
@query("normalise_keys", "SELECT o_orderkey, lower(o_orderpriority) AS lot, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'w' || o_custkey END AS wafer FROM orders")
def normalise_keys(spark, folder):
    c = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 0"), c, F.lit(".0"))).otherwise(F.concat(F.lit("w"), c, F.lit(" ")))
    return table(spark, folder, "orders").select("o_orderkey", text.normalise_lot(F.concat(F.lit(" "), "o_orderpriority")).alias("lot"), text.normalise_wafer(raw).alias("wafer"))


@query("normalize_colname", "SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[^a-z0-9_]+', '_', 'g') AS name, trim(regexp_replace(p_brand || ' [' || p_size || ']', '[^A-Za-z0-9]+', '_', 'g'), '_') AS safe FROM part")
def normalize_colname(spark, folder):
    label = F.concat("p_brand", F.lit(" ["), F.col("p_size").cast("string"), F.lit("]"))
    return table(spark, folder, "part").select("p_partkey", text.normalize_colname(F.col("p_type")).alias("name"), text.safe_name(label).alias("safe"))


@query("yield_and_lot_from_path", f"SELECT p_partkey, {r('(700 + p_size) / 10.0', 'yield_pct')}, CASE WHEN p_partkey % 2 = 0 THEN 'SYN_' || p_partkey ELSE 'HB' || p_partkey END AS lot, 'HB' || p_partkey AS bare FROM part")
def yield_and_lot_from_path(spark, folder):
    k, y = F.col("p_partkey").cast("string"), F.format_string("%.1f", (700 + F.col("p_size")) / 10.0)
    combo = F.concat(F.lit("HB"), k, F.lit("_[13]_"), y, F.lit("%"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x_SYN_"), k, F.lit(".csv"))).otherwise("x.csv")
    return table(spark, folder, "part").select("p_partkey", text.yield_from_path(combo).alias("yield_pct"), text.lot_from_path(combo, name).alias("lot"), text.normalize_lot_id(F.concat(F.lit("HB"), k, F.lit(".1"))).alias("bare"))


@query("normalize_partname", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'L' || p_partkey WHEN 1 THEN 'AB' || p_partkey WHEN 2 THEN '' WHEN 3 THEN '8VLG910NQ20XV' ELSE 'X' || p_partkey || 'Y' END AS part, CASE p_partkey % 5 WHEN 2 THEN 'G' WHEN 0 THEN 'G_' || p_size || 'L' || p_partkey WHEN 1 THEN 'G_AB' || p_partkey WHEN 3 THEN 'G_8VLG910NQ20XV' ELSE 'G_X' || p_partkey || 'Y' END AS product FROM part""")
def normalize_partname(spark, folder):
    m, k, s = F.col("p_partkey") % 5, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    raw = (
        F.when(m == 0, F.concat(s, F.lit("hl"), k, F.lit("-D"))).when(m == 1, F.concat(F.lit("ab"), k, F.lit("_l, other")))
        .when(m == 2, "TIMEOUT").when(m == 3, "8tlg912nq20v-l0dz").otherwise(F.concat(F.lit("\nx "), k, F.lit(" y")))
    )
    return table(spark, folder, "part").select("p_partkey", text.normalize_partname(raw).alias("part"), text.product_key(F.lit("G"), raw).alias("product"))


@query("fiscal_year", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN '2031' ELSE 'Unknown' END AS year FROM orders""")
def fiscal_year(spark, folder):
    d, m = F.col("o_orderdate"), F.col("o_orderkey") % 4
    named = (
        F.when(m == 0, F.concat(F.lit("a_"), F.date_format(d, "MMddyyyy"), F.lit("_04252026_b"))).when(m == 1, F.concat(F.lit("run-"), F.date_format(d, "yyyyMMdd"), F.lit("-x")))
        .when(m == 2, "lot 2031 b").otherwise("lot")
    )
    return table(spark, folder, "orders").select("o_orderkey", text.fiscal_year(named).alias("year"))


@query("wafer_list", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN list_transform(range(p_size % 20 + 1, p_size % 20 + 4), lambda i: lpad(CAST(i AS VARCHAR), 2, '0')) ELSE [lpad(CAST(p_size AS VARCHAR), 2, '0'), '07'] END AS wafers FROM part""")
def wafer_list(spark, folder):
    low, s = (F.col("p_size") % 20 + 1).cast("string"), F.col("p_size").cast("string")
    span = F.concat(F.lit("W1_["), low, F.lit(" - "), (F.col("p_size") % 20 + 3).cast("string"), F.lit("]"))
    name = F.when(F.col("p_partkey") % 2 == 0, span).otherwise(F.concat(F.lit("W1_["), s, F.lit(";7]")))
    return table(spark, folder, "part").select("p_partkey", text.wafer_list(name).alias("wafers"))


@query("wafer_from_filename", "SELECT p_partkey, 'HB' || p_partkey AS lot, CAST(p_size % 25 + 1 AS INTEGER) AS wafer, 'AB_' AS prefix, 'PRB_J750' AS suffix FROM part")
def wafer_from_filename(spark, folder):
    k, w = F.col("p_partkey").cast("string"), (F.col("p_size") % 25 + 1).cast("string")
    name = F.concat(F.lit("AB_HB"), k, F.lit("_"), w, F.lit("_PRB_J750.std_20240101.csv"))
    combo = F.concat(F.lit("HB"), k, F.lit("_[01-26]_97.9%"))
    named = table(spark, folder, "part").select("p_partkey", name.alias("filename"), combo.alias("folder"))
    return text.wafer_from_filename(named).select("p_partkey", "wafer_info.*")


@query("lot_folder", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'HB' || p_partkey || '_[01-07]_97.5%' END AS folder, p_partkey % 2 = 0 AS valid, CASE WHEN p_partkey % 2 = 0 THEN 'HB' || p_partkey || '_[01-07]_97.5%' ELSE 'HB' || p_partkey || '_13' END AS short FROM part")
def lot_folder(spark, folder):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("HB"), k, F.lit("_[01-07]_97.5%"))).otherwise(F.concat(F.lit("HB"), k, F.lit("_13")))
    long = F.replace(name, F.lit("[01-07]"), F.lit("[01-02-03-04-05-06-07]"))
    path = F.concat(F.lit("/data/x/"), name, F.lit("/sub/file.csv"))
    return table(spark, folder, "part").select("p_partkey", text.lot_folder(path).alias("folder"), text.combo_folder_valid(name).alias("valid"), text.shorten_wafer_list(long).alias("short"))


@query("creation_timestamp", "SELECT o_orderkey, o_orderdate AS created FROM orders")
def creation_timestamp(spark, folder):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MM/dd/yyyy HH:mm:ss")).otherwise(F.date_format(d, "MMM d yyyy HH:mm:ss"))
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", text.creation_timestamp(raw).cast(o.schema["o_orderdate"].dataType if isinstance(o.schema["o_orderdate"].dataType, T.TimestampNTZType) else "timestamp").alias("created"))


@query("experiment_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '_' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') END AS experiment_key FROM orders")
def experiment_key(spark, folder):
    name = F.concat(F.lit("Day_"), F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit("_Wafer_"), (F.col("o_custkey") % 30).cast("string"))
    raw = F.when(F.col("o_orderkey") % 3 != 0, name).otherwise(F.concat(F.lit("Night_"), name))
    return table(spark, folder, "orders").select("o_orderkey", text.experiment_key(raw).alias("experiment_key"))


@query("group_key", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'folder' || p_size WHEN p_partkey % 3 = 1 THEN 'HB1000' || p_size ELSE 'plain ' || p_size END AS group_key FROM part")
def group_key(spark, folder):
    m, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    base = F.when(m == 0, F.concat(F.lit("folder"), s)).when(m == 1, "nan").otherwise("")
    path = F.when(m == 1, F.concat(F.lit("a/ hb1000"), s)).otherwise(F.concat(F.lit("plain "), s))
    return table(spark, folder, "part").select("p_partkey", text.group_key(base, path).alias("group_key"))


@query("readable_feature_name", "SELECT p_partkey, 'T' || p_size || '.' || (p_partkey % 10) || CASE p_partkey % 3 WHEN 0 THEN ' mean' WHEN 1 THEN ' (99th Percentile)' ELSE '' END AS label, 'T' || p_size || '.' || (p_partkey % 10) AS test, CASE p_partkey % 3 WHEN 1 THEN 'p99' ELSE 'mean' END AS stat FROM part")
def readable_feature_name(spark, folder):
    m = F.col("p_partkey") % 3
    base = F.concat(F.lit("FT_t"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 10).cast("string"))
    name = F.concat(base, F.when(m == 0, "__mean").when(m == 1, "__p99").otherwise(""))
    return table(spark, folder, "part").select("p_partkey", text.readable_feature_name(name).alias("label"), text.parse_feature_name(name).alias("p")).select("p_partkey", "label", "p.test", "p.stat")


@query("cert_id", "SELECT p_partkey, upper(substr(sha256(p_brand || '-' || p_type || '-' || p_size), 1, 16)) AS cert_id FROM part")
def cert_id(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.cert_id(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("cert_id"))


@query("stdf_test_codes", "WITH s AS (SELECT l_suppkey, CASE WHEN min(l_orderkey) < 100000 THEN 100 ELSE 100000 END AS scale FROM lineitem GROUP BY 1) SELECT DISTINCT l_suppkey, l_orderkey, 'T' || (l_orderkey // scale) || '.' || (l_orderkey % scale) AS code FROM lineitem JOIN s USING (l_suppkey)")
def stdf_test_codes(spark, folder):
    from yieldloom.sources.stdf import stdf_test_codes as codes

    tests = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return codes(tests, ["l_suppkey"], "l_orderkey", "code")


@query("json_safe", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"id\":' || event_id || '}' ELSE '{\"id\":' || event_id || ',\"v\":1.5}' END AS json FROM events")
def json_safe(spark, folder):
    v = numeric.inf_to_null(F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(1.5))
    return table(spark, folder, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), v.alias("v"))).alias("json"))
