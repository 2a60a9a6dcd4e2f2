"""Hand-worked values for every scalar rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

from yieldloom.functions import grades, numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(
    "raw, want",
    [("01.Sep", 1.09), ("Mär.92", 3.92), ("1,5", 1.5), ("5d", None), ("nan", None), ("x", None), ("01.Mai", 1.05),
     ("1,5E3", 1500.0), ("Jän.5", 1.05), ("12.dez", 12.12), (None, None)],
)
def test_recover(spark, raw, want):
    assert one(spark, numeric.recover_spreadsheet_decimal(lit(raw))) == want


def test_coerce_sensor(spark):
    got = one(spark, numeric.coerce_sensor(lit("01.Mai")))
    assert (got.value, got.recovered, got.unresolved) == (1.05, True, False)
    got = one(spark, numeric.coerce_sensor(lit("bad")))
    assert (got.value, got.recovered, got.unresolved) == (None, False, True)


@pytest.mark.parametrize(
    "fn, raw, want",
    [
        (text.timestamp_index, "timestamp_12", 12),
        (text.normalise_wafer, " 01.0 ", "1"),
        (text.normalise_wafer, "A01", "A01"),
        (text.normalise_lot, " LotA ", "lota"),
        (text.normalize_colname, " Vdd Core (mV) ", "vdd_core_mv_"),
        (text.safe_name, "RF power [W]", "RF_power_W"),
        (text.yield_from_path, "W1234_[01]_95.5%", 95.5),
        (text.normalize_lot_id, "HB02.1", "HB02"),
        (text.normalize_partname, "6CL123-D", "6L123"),
        (text.normalize_partname, "8VL8744NQ20XV-L0VGZ", "8VLG910NQ20XV"),
        (text.normalize_partname, "UNKNOWN", ""),
        (text.normalize_partname, "\n ab c, zz", "ABC"),
        (text.fiscal_year, "a_04252026_b", "2026"),
        (text.fiscal_year, "a_20260425_b", "2026"),
        (text.fiscal_year, "run-20190101-x", "2019"),
        (text.fiscal_year, "x 2031 y", "2031"),
        (text.fiscal_year, "lot", "Unknown"),
        (text.wafer_list, "W1_[03-01]", ["03", "02", "01"]),
        (text.wafer_list, "W1_[1,2]", ["01", "02"]),
        (text.wafer_list, "W1", []),
        (text.combo_folder_valid, "HB025401_[13]_97.9%", True),
        (text.combo_folder_valid, "A_B_[01-25]", True),
        (text.combo_folder_valid, "HB025401_13", False),
        (text.lot_folder, "/d/L1_[01]/x/L2_[02]_90%/f.csv", "L2_[02]_90%"),
        (text.shorten_wafer_list, "L_[01-02-03-04-05-06]_9%", "L_[01-06]_9%"),
        (text.shorten_wafer_list, "L_[01,02]", "L_[01,02]"),
        (text.experiment_key, "Day_2024_07_02_Wafer_01", "2024-07-02_01"),
        (text.experiment_key, "Night_1", None),
        (text.readable_feature_name, "TP_t1_0__mean", "T1.0 mean"),
        (text.readable_feature_name, "WP_edge_loss", "Edge Loss"),
        (text.readable_feature_name, "probe: t2_1__p99", "probe: T2.1 (99th Percentile)"),
        (text.readable_feature_name, "Factor 2", "Principal Factor 2"),
        (text.tester_family, " ets300_c2", "J750"),
    ],
)
def test_text(spark, fn, raw, want):
    assert one(spark, fn(lit(raw))) == want


@pytest.mark.parametrize(
    "name, folder, want",
    [
        ("AB_HB025401_13_PRB_J750.std_1.csv", "HB025401_[13]_97.9%", ("HB025401", 13, "AB_", "PRB_J750_1")),
        ("W55.07_20240101_x.csv", "W55", ("W55", 7, "", "WS")),
        ("W55_w3x_FT_combined.csv", "W55_[01-05]", ("W55", 3, "", "FT")),
        ("none.csv", "W55", ("W55", None, "", "WS")),
    ],
)
def test_wafer_from_filename(spark, name, folder, want):
    row = text.wafer_from_filename(spark.createDataFrame([(name, folder)], "filename string, folder string")).first()
    assert tuple(row.wafer_info) == want


def test_lots_codes_and_keys(spark):
    assert one(spark, text.lot_from_path(lit("SYN_0053_x"))) == "SYN_0053"
    assert one(spark, text.lot_from_path(lit("HB1_[13]"), lit("q_SYN_0009_1.csv"))) == "SYN_0009"
    assert one(spark, text.test_code(F.lit(1203), F.lit(100))) == "T12.3"
    assert tuple(one(spark, text.test_order(lit("T1.10")))) == (1, 10)
    assert tuple(one(spark, text.parse_feature_name(lit("FT_t1_0__p50")))) == ("T1.0", "median")
    assert one(spark, text.product_key(lit("DDR4"), lit("6HL9_L"))) == "DDR4_6L9"
    want = hashlib.sha256(b"L1-DDR4-69.125").hexdigest()[:16].upper()
    assert one(spark, text.cert_id(lit("L1"), lit("DDR4"), lit(69.125, "double"))) == want
    assert one(spark, text.creation_timestamp(lit("Apr 5 2024 01:02:03"))).isoformat() == "2024-04-05T01:02:03"


def test_grades(spark):
    num = lambda v: lit(v, "double")
    assert one(spark, grades.cpk(num(5), num(1), num(1), num(10))) == pytest.approx(4 / 3)
    assert one(spark, grades.cpk(num(5), num(1), num(None), num(None))) is None
    for mean_z, max_z, want in [(0.3, 0.4, 92.5), (0.9, 1.6, 39.5), (3.25, 3.5, 0.0)]:
        assert one(spark, grades.zscore_closeness(num(mean_z), num(max_z))) == pytest.approx(want)
    score = grades.reliability_score(
        num(0.85), num(0.75), probe_corr=num(0.9), probe_closeness=num(92.5), final_corr=num(0.8),
        final_closeness=num(60), probe_max_z=num(1), final_max_z=num(1.2),
    )
    got = one(spark, score)
    assert got.probe_similarity == pytest.approx(91.25)
    assert got.final_similarity == pytest.approx(57)
    assert got.risk_score == pytest.approx(69.125)
    assert one(spark, grades.product_grade(num(69.125), num(0.85), num(0.75))) == "C"
    assert one(spark, grades.product_grade(num(95), num(0.1), num(0.9))) == "D"
    limits = {"Z": 0.99, "A": 0.95, "H": 0.9, "I": 0.85, "C": 0.8}
    assert one(spark, grades.yield_grade(num(0.91), limits)) == "H"
    assert one(spark, grades.confidence(num(0.902), num(0.902), limits)) == pytest.approx(0.87)
    assert one(spark, grades.normalised_yield(num(-1), num(0.5))) == pytest.approx(46)
    assert one(spark, grades.normalised_yield(num(0.9), num(0.5))) == pytest.approx(90)
    assert one(spark, numeric.coordinate_columns(F.lit(30000), F.lit(40000))["coordinate__radius"]) == pytest.approx(0.5)


def test_tokens_without_numbers_are_not_cast(spark):
    """Empty matches are NULL before they are cast, so that no error is raised for each of a name's tokens."""
    out = text.wafer_from_filename(spark.createDataFrame([("AB_HB7_PRB_J750.std", "HB7_[01-26]_97.9%")], "filename string, folder string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "= )) null else try_cast(regexp_extract" in plan and "WHEN ((try_cast(regexp_extract" not in plan
    assert out.first().wafer_info.asDict() == {"lot": "HB7", "wafer": None, "prefix": "AB_", "suffix": "WS"}
