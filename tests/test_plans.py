"""The split plans must equal the plain ones, whatever the key sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldloom.plans import find_hot, group_stats, nearby_rows, row_index, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = None if i % 17 == 0 else float(rng.choice([rng.gauss(0, 5), 1.0, 2.0]))
        rows.append((key, i, rng.randrange(400), value))
    return spark.createDataFrame(rows, "k string, id long, t long, v double").cache()


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_hot_keys_found(skewed):
    assert not find_hot(skewed, ["k"], 10_000)
    hot = find_hot(skewed, ["k"], 500)
    assert hot.count == 1


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_split_equals_plain(skewed, keys):
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "low": 0.0, "top": 1.0}
    aggs = [F.count("v").alias("n"), F.avg("v").alias("m")]
    plain = group_stats(skewed, keys, "v", aggs, probs, hot_rows=10**9)
    split = group_stats(skewed, keys, "v", aggs, probs, hot_rows=40)
    order = keys or ["n"]
    a, b = _rows(plain, *order), _rows(split.select(plain.columns), *order)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        np.testing.assert_allclose(
            [c for c in x if isinstance(c, (int, float))], [c for c in y if isinstance(c, (int, float))], rtol=1e-12
        )


@pytest.mark.parametrize("descending", [(), ("t",)])
def test_row_index_split_equals_plain(skewed, descending):
    plain = row_index(skewed, ["k"], ["t", "id"], descending=descending, hot_rows=10**9)
    split = row_index(skewed, ["k"], ["t", "id"], descending=descending, hot_rows=25)
    assert _rows(plain, "id") == _rows(split.select(plain.columns), "id")


def test_string_order_split(skewed):
    named = skewed.withColumn("s", F.concat(F.lit("wafer_"), F.col("t").cast("string")))
    plain = row_index(named, ["k"], ["s", "id"], hot_rows=10**9)
    split = row_index(named, ["k"], ["s", "id"], hot_rows=25)
    assert _rows(plain, "id") == _rows(split.select(plain.columns), "id")


def test_running_totals_split_equals_plain(skewed):
    totals = {"cum": F.col("id"), "seen": F.when(F.col("v") > 0, 1).otherwise(0)}
    plain = running_totals(skewed, ["k"], ["t", "id"], totals, hot_rows=10**9)
    split = running_totals(skewed, ["k"], ["t", "id"], totals, hot_rows=25)
    assert _rows(plain, "id") == _rows(split.select(plain.columns), "id")


def test_nearby_rows_split_equals_plain(skewed):
    def build(w):
        return {
            "l1": F.lag("id", 1).over(w),
            "l5": F.lag("id", 5).over(w),
            "f3": F.lead("id", 3).over(w),
            "s25": F.sum("id").over(w.rowsBetween(-24, 0)),
        }

    plain = nearby_rows(skewed, ["k"], ["t", "id"], build, back=24, ahead=3, hot_rows=10**9)
    split = nearby_rows(skewed, ["k"], ["t", "id"], build, back=24, ahead=3, hot_rows=40)
    assert split.count() == 1500
    assert _rows(plain, "id") == _rows(split.select(plain.columns), "id")


@pytest.mark.parametrize("descending", [(), ("t",), ("t", "id")])
def test_one_order_value_with_most_rows(skewed, descending):
    clumped = skewed.withColumn("t", F.when(F.col("id") % 4 != 0, 200).otherwise(F.when(F.col("id") % 8 == 0, F.col("t"))))
    plain = row_index(clumped, ["k"], ["t", "id"], descending=descending, hot_rows=10**9)
    split = row_index(clumped, ["k"], ["t", "id"], descending=descending, hot_rows=25)
    assert _rows(plain, "id") == _rows(split.select(plain.columns), "id")


def test_crowded_cells_are_cut_by_the_next_column(spark):
    from yieldloom.plans.ordered import _blocks

    rows = spark.range(4000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), "id")
    blocks = _blocks(rows, ["k"], ["t", "id"], (), find_hot(rows, ["k"], 100))
    assert blocks.groupBy("__block").count().agg(F.max("count")).first()[0] <= 300


@pytest.mark.parametrize("value", ["'a prefix of twenty ch' || lpad(id, 6, '0')", "9007199254740992 + id", "DATE '2020-01-01' + INT(id % 50)"])
def test_blocks_are_even_whatever_the_values(spark, value):
    from yieldloom.plans.ordered import _blocks

    rows = spark.range(2_000).selectExpr("1 AS k", f"{value} AS v", "id").repartition(4)
    blocks = _blocks(rows, ["k"], ["v", "id"], (), find_hot(rows, ["k"], 100))
    sizes = [r["count"] for r in blocks.groupBy("__block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 300 and sum(sizes) == 2_000
    numbered = row_index(rows, ["k"], ["v", "id"], name="n", hot_rows=100).orderBy("v", "id").collect()
    assert [r.n for r in numbered] == list(range(1, 2_001))


def test_scored_rows_meet_by_shuffle(spark, tmp_path):
    """A small file of customers is not broadcast: in memory it is many times larger, and each fit would send it again."""
    from catalog.base import scored

    spark.createDataFrame([(k, k % 3, 100.0 * k) for k in range(6)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k % 5, 1000.0 * k) for k in range(20)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows = scored(spark, str(tmp_path))
    assert {(r.wafer, r.response) for r in rows.collect()} == {(k, (1000.0 * k + 1000.0 * (15 + k)) / 2000) for k in range(5)}
    plan = rows._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
