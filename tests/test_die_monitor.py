"""Die statistics, drift, golden comparison, die merge and wafer maps on hand-worked fixtures."""

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import die, golden, joins, monitor, spatial


def values(spark, numbers, test="t"):
    return spark.createDataFrame([(test, float(v)) for v in numbers], "test_id string, value double")


@pytest.mark.parametrize("hot", [None, 3])
def test_col_stats_and_proximity(spark, hot):
    rows = values(spark, [1, 2, 4, 8, 16, 23, 100]).unionByName(values(spark, [5], "one"))
    limits = spark.createDataFrame([("t", 0.0, 100.0), ("one", None, 3.0)], "test_id string, lsl double, usl double")
    got = {r.test_id: r for r in die.col_stats(rows, ["test_id"], limits=limits, hot_rows=hot).collect()}
    t = got["t"]
    want = dict(mean=22, std=35.312887166, median=8, iqr=16.5, outlier_rate=1 / 7, p01=1.06, p05=1.3, p95=76.9, p99=95.38, near_lsl_pct=3 / 7, near_usl_pct=1 / 7, near_lsl_sigma=5 / 7, near_usl_sigma=1 / 7)
    for name, value in want.items():
        assert t[name] == pytest.approx(value, rel=1e-9), name
    assert got["one"].std == 0.0 and got["one"].near_usl_pct is None


def test_names_are_judged_once(spark):
    """Rows of die attributes, coordinates and timings go under any spelling, and rows without a name; repeated rows stay."""
    names = ["T1.0", "T1.0", " Bin ", "X_DIE location", "site", "index time", None, "width"]
    df = spark.createDataFrame([(n, float(k)) for k, n in enumerate(names)], "test_id string, value double").repartition(3)
    assert sorted((r.test_id, r.value) for r in die.test_columns(df).collect()) == [("T1.0", 0.0), ("T1.0", 1.0), ("width", 7.0)]
    assert die.test_columns(df.limit(0)).collect() == []


def test_psi_and_spc(spark):
    base, cur = values(spark, range(1, 11)), values(spark, [3, 4, 5, 6, 11])
    assert monitor.psi(cur, base).first().psi == pytest.approx(3.79699735)
    assert monitor.psi(values(spark, [7] * 5), values(spark, [7] * 6)).first().psi == 0.0
    assert monitor.psi(cur, values(spark, [1, 2])).first().psi is None
    hist = base.withColumn("lot", F.lit("a"))
    for hot in (None, 2):
        assert monitor.psi_pairwise_min(cur, hist, hot_rows=hot).first().psi == pytest.approx(3.79699735)
    spc = monitor.spc_mean_shift(cur, base).first()
    assert (spc.cl, spc.ucl, spc.lcl) == (5.5, pytest.approx(14.582951), pytest.approx(-3.582951))
    assert spc.mean_shift == pytest.approx(0.0990867, abs=1e-6) and spc.is_shift == 0.0
    med = monitor.spc_median_shift(cur, base).first()
    assert med.history_iqr == pytest.approx(4.5) and not med.spc_shift
    flat = monitor.spc_mean_shift(cur, values(spark, [2] * 6)).first()
    assert flat.cl == 2.0 and flat.ucl is None and flat.is_shift is None


def test_lot_stability_equals_pooled_baseline(spark):
    rows = [(lot, "t", float((i * 7 + lot * 3) % 11 + (lot == 5) * 6)) for lot in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "lot int, test_id string, value double")
    got = {r.lot: r for r in monitor.lot_stability(df).collect()}
    for lot in range(6):
        own, rest = df.filter(F.col("lot") == lot), df.filter(F.col("lot") != lot)
        assert got[lot].psi == pytest.approx(monitor.psi(own, rest).first().psi)
        spc = monitor.spc_mean_shift(own, rest).first()
        assert got[lot].ucl == pytest.approx(spc.ucl) and got[lot].is_shift == spc.is_shift
    assert monitor.lot_stability(df.filter("lot < 4")).isEmpty()


def test_merge_dies(spark):
    rows = [
        (0, True, 1, 1.0, None), (0, False, 2, 9.0, 9.0),  # old pass beats new fail
        (1, False, 1, 9.0, 9.0), (1, True, 2, 2.0, None),  # new pass beats old fail
        (2, True, 1, 5.0, 6.0), (2, True, 2, 7.0, None),  # newest pass, missing test from the older pass
    ]
    df = spark.createDataFrame(rows, "x int, is_pass boolean, created int, a double, b double").withColumns({"wafer": F.lit("w"), "y": F.lit(0)})
    got = {r.x: (r.is_pass, r.created, r.a, r.b) for r in die.merge_dies(df, recency=["created"], tests=["a", "b"]).collect()}
    assert got == {0: (True, 1, 1.0, None), 1: (True, 2, 2.0, None), 2: (True, 2, 7.0, 6.0)}


def test_wafer_map(spark):
    cells = [("w", x, y, x == 1 and y == 1, 0) for x in range(3) for y in range(3)] + [("w", 5, 5, True, 0)]
    dies = spark.createDataFrame(cells, "wafer string, x int, y int, is_pass boolean, row int")
    flags = {(r.x, r.y): (r.gdbn_flag, r.neighbours) for r in spatial.gdbn(dies).collect()}
    assert flags[1, 1] == (True, 8) and flags[5, 5] == (False, 0)
    summary = spatial.spatial_summary(dies).first()
    assert (summary.total_dies, summary.good_dies, summary.gdbn_count, summary.edge_fail_count) == (10, 2, 1, 8)
    counts = spatial.wafer_map_counts(spatial.gdbn(dies)).first()
    assert (counts.pass_dies, counts.fail_dies, counts.gdbn_dies, counts.yield_pct) == (1, 8, 1, 10.0)
    later = dies.unionByName(spark.createDataFrame([("w", 0, 0, True, 1)], dies.schema))
    assert spatial.neighbour_join(later).filter("x = 1 AND y = 1").first().bad_neighbours == 7


def test_golden(spark):
    gold = spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 2.0), ("c", 5.0, 0.0)], "test_id string, mean double, std double")
    cand = spark.createDataFrame([("w", "a", 10.2, 1.0), ("w", "b", 23.2, 2.0), ("w", "c", 9.0, 1.0)], "wafer string, test_id string, mean double, std double")
    z = golden.golden_z_scores(cand, gold, ["wafer"]).first()
    assert z.max_z == pytest.approx(1.6) and z.closeness == pytest.approx(39.5)
    corr = golden.golden_correlation(cand, gold, ["wafer"]).first()
    assert corr.overlap == 3 and 0.9 < corr.golden_correlation < 1
    limits = spark.createDataFrame([("A", 10.5, 12.0)], "test_id string, lsl double, usl double")
    status = {r.test_id: r.status for r in golden.golden_comparison(cand.drop("wafer"), gold, limits).collect()}
    assert status == {"a": "Out of Spec", "b": "Marginal", "c": "Out of Spec"}
    far = golden.shifted_tests(cand.withColumn("mean", F.lit(99.0)), gold, shown=1).first()
    assert (far.shifted, far.tests) == (2, "a (+1 more)")
    radar = golden.radar_parameters(cand, gold, k=1).first()
    assert radar.test_id == "b" and radar.signed_z == pytest.approx(1.6)


def test_current_mapping_and_limits(spark):
    columns = spark.createDataFrame([("VDD",), ("t1 0",), ("t2_0_extra",), ("else",)], "column string")
    known = spark.createDataFrame([("VDD", "T9.0"), ("x", "T1.0")], "name string, test_id string")
    limits = spark.createDataFrame([("T2.0",)], "limit_key string")
    got = {r.column: r.test_id for r in joins.current_test_mapping(columns, known, limits).collect()}
    assert got == {"VDD": "T9.0", "t1 0": "T1.0", "t2_0_extra": "T2.0", "else": "else"}
    wafers = spark.createDataFrame([("p", "l1"), ("p", "l2"), ("q", "l1")], "product string, lot string")
    files = spark.createDataFrame([("p", "l1", "own"), ("p", None, "shared")], "product string, lot string, limit_file string")
    found = {(r.product, r.lot): r.limit_file for r in joins.resolve_limits(wafers, files).collect()}
    assert found == {("p", "l1"): "own", ("p", "l2"): "shared", ("q", "l1"): None}


def test_tiles_meet_over_their_edges(spark):
    """Whole-numbered positions, met as maps of tiles, have the counts of fractional types, met one by one; repeats, gaps and nulls, too."""
    rows = [(w, x, y, None if (x * y) % 11 == 5 else (x + y * y) % 3 > 0, k) for w in ("a", None) for k, (x, y) in enumerate((i % 13 - 9, i * i % 19 - 4) for i in range(90))]
    rows += [("b", 2**40 + i % 3, -(2**40) + i // 3, i % 2 == 0, i) for i in range(9)] + [("a", None, y, y > 1, 0) for y in range(4)] + [("a", 7, None, False, 0), ("a", None, None, False, 0)]
    dies = spark.createDataFrame(rows, "wafer string, x long, y long, is_pass boolean, row int")
    plain = dies.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    for met in (spatial.neighbour_join, spatial.gdbn):
        one, other = ([str([None if v is None else int(v) if not isinstance(v, str) else v for v in r]) for r in met(d).collect()] for d in (dies, plain))
        assert len(one) > 90 and sorted(one) == sorted(other)
    assert "Generate explode" in spatial.neighbour_join(dies)._jdf.queryExecution().optimizedPlan().toString()
    assert spatial.neighbour_join(dies).schema["x"].dataType.simpleString() == "bigint"
    assert spatial.edge_fails(dies)._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert {r.wafer: r.total_dies for r in spatial.spatial_summary(dies).collect()} == {"a": 90, "b": 9}


def test_one_feature_with_most_rows_is_not_gathered(spark):
    """Kept features are broadcast and hashed: rows are not sorted by feature."""
    rows = [(lot, lot % 2, "common") for lot in range(5) for _ in range(20)] + [(1, 1, "rare"), (2, 0, None)]
    df = spark.createDataFrame(rows, "lot int, wafer int, feature string")
    out = die.common_features(df)
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.groupBy("feature").count().collect()[0].asDict() == {"feature": "common", "count": 100} and out.count() == 100


def test_spec_proximity_hashes_sigmas(spark):
    rows = values(spark, [1, 2, 4, 8, 16, 23, 100])
    out = die.spec_proximity(rows, ["test_id"], spark.createDataFrame([("t", 0.0, 100.0)], "test_id string, lsl double, usl double"))
    assert "strategy=shuffle_hash" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().near_lsl_sigma == pytest.approx(5 / 7)
