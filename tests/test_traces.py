"""Equipment, polishing, etch and run-to-failure lanes on hand-worked fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import cleaning, cmp, contracts, etch, joins, rul, signal, traces


@pytest.fixture(scope="module")
def equipment(spark):
    """3 lots x 2 wafers x 176 samples; one damaged decimal per wafer; every label twice."""
    rows, labels = [], []
    for lot in ("lot1", "lot2", "lot3"):
        for wafer, response in (("1", 0.4), ("2", 0.9)):
            labels += [(lot, wafer, str(response), "bad" if response > 0.75 else "good")] * 2
            for t in range(176):
                rows.append((f" {lot}", wafer, f"timestamp_{t}", repr(response + t / 1000), "01.Mai" if t == 0 else repr(t / 100)))
    wide = spark.createDataFrame(rows, "lot string, wafer string, timestamp string, sensor_1 string, sensor_2 string")
    return wide, spark.createDataFrame(labels, "lot string, wafer string, response string, class string")


def test_equipment_slice(equipment):
    wide, labels = equipment
    long = cleaning.coerce_sensor(cleaning.long_trace(wide, "e1"))
    assert cleaning.sequence_check(long, ["lot", "wafer", "sensor"]).isEmpty()
    quality = {r.sensor: r for r in cleaning.sensor_quality(long).collect()}
    assert quality["sensor_2"].status == "RECOVERED_SOURCE_FORMAT"
    assert quality["sensor_2"].recovered_decimal_count == 6
    assert quality["sensor_2"].source_format_examples == "01.Mai"
    assert quality["sensor_1"].status == "VALID"
    kept = cleaning.sensor_retention(long, cleaning.sensor_quality(long))
    first = kept.filter("sensor = 'sensor_2' AND ts_idx = 0").select("value").distinct().collect()
    assert [r.value for r in first] == [1.05]
    labels_one = cleaning.dedupe_labels(labels)
    assert labels_one.count() == 6
    summary = cleaning.label_summary(labels).first()
    assert (summary.raw_response_rows, summary.exact_duplicate_rows, summary.conflicting_keys) == (12, 6, 0)

    stats = traces.temporal_features(kept)
    row = stats.filter("lot = 'lot1' AND wafer = '1' AND sensor = 'sensor_1'").first()
    want = dict(
        mean=0.4875, std=0.0509509568, min=0.4, max=0.575, median=0.4875, q25=0.44375, q75=0.53125, delta=0.175, slope=0.001,
        early_mean=0.429, middle_mean=0.4875, late_mean=0.546, missing_rate=0.0,
    )
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name
    features = traces.feature_rows(stats, ["lot", "wafer"], ["equipment", "sensor"])
    names = ["e1__sensor_1__mean", "e1__sensor_2__max", "absent"]
    table = joins.join_one_to_one(traces.pivot_features(features, ["lot", "wafer"], names), labels_one, ["lot", "wafer"])
    assert table.count() == 6
    assert table.filter("class = 'bad'").count() == 3
    assert table.filter("absent IS NOT NULL").isEmpty()


def test_label_conflicts_are_refused(spark):
    rows = spark.createDataFrame([("a", "1", "0.4", "good"), ("a", "1", "0.5", "good")], "lot string, wafer string, response string, class string")
    with pytest.raises(contracts.ContractError, match="conflicting"):
        cleaning.dedupe_labels(rows)
    with pytest.raises(contracts.ContractError, match="threshold"):
        cleaning.dedupe_labels(rows.limit(1).withColumn("class", F.lit("bad")))


def test_sequence_check_flags(spark):
    rows = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0), ("b", 0), ("b", 1)] + [("c", 0)], "w string, i int")
    got = {r.w: (r.samples, r.duplicate_timestamps) for r in cleaning.sequence_check(rows, ["w"], "i", 3).collect()}
    assert got == {"b": (3, 1), "c": (1, 0)}


@pytest.mark.parametrize("hot", [None, 3])
def test_failure_cycles_and_samples(spark, hot):
    ttf = [12.0, 8.0, 4.0, 0.0, 20.0, 16.0, None, None]
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(ttf)], "Tool string, time int, ttf double")
    got = rul.failure_cycle_ids(rows, hot_rows=hot).orderBy("time").collect()
    assert [r.cycle for r in got] == [0, 0, 0, 0, 1, 1, 1, 1]
    kept = rul.stride_sample(rows, stride=5, hot_rows=hot).orderBy("time").collect()
    assert [r.time for r in kept] == [0, 3, 4, 5]
    lagged = rul.lag_difference(rows, signals=["ttf"], lags=(1, 5), time="time", hot_rows=hot).orderBy("time").collect()
    assert [r.ttf__diff_1 for r in lagged] == [None, -4.0, -4.0, -4.0, 20.0, -4.0, None, None]
    assert lagged[5].ttf__diff_5 == 4.0 and lagged[0].time_since_previous == 0
    rolled = rul.rolling_stats(rows, signals=["ttf"], windows=(2,), hot_rows=hot).orderBy("time").collect()
    assert [r.ttf__mean_2 for r in rolled][:3] == [12.0, 10.0, 6.0] and rolled[0].ttf__std_2 == 0.0


def test_expanding_splits(spark):
    cycles = spark.createDataFrame([(c,) for c in range(5) for _ in range(2)], "cycle int")
    assert [(r.split, r.test_cycle) for r in rul.expanding_splits(cycles).orderBy("split").collect()] == [(1, 3), (2, 4)]
    assert rul.expanding_splits(cycles.filter("cycle = 0")).isEmpty()


def test_even_sample_matches_positions(spark):
    import numpy as np

    rows = spark.createDataFrame([(i,) for i in range(1000)], "i int")
    for n in (7, 300, 999):
        got = sorted(r.i for r in rul.even_sample(rows, ["i"], n).collect())
        assert got == sorted(set(np.linspace(0, 999, n).astype(int).tolist()))


def test_cmp_phases_and_contract(spark):
    rows = spark.createDataFrame(
        [(1, "A", float(t), 4, 1.0 if t < 3 else 2.0, 10.0 + t, 2.0, -1.0, 3.0, 7) for t in range(7)],
        "WAFER_ID long, STAGE string, TIMESTAMP double, CHAMBER int, MACHINE_DATA double, PRESSURIZED_CHAMBER_PRESSURE double, WAFER_ROTATION double, HEAD_ROTATION double, STAGE_ROTATION double, _source_index int",
    )
    phases = [r.phase for r in cmp.phase_by_position(rows).orderBy("TIMESTAMP").collect()]
    assert phases == [0, 0, 0, 1, 1, 2, 2]
    general = cmp.cmp_process_stats(rows).first()
    assert (general.sample_count, general.process_duration, general.timestamp_gap_mean, general.timestamp_gap_std) == (7, 6.0, 1.0, 0.0)
    physics = cmp.preston_proxy(rows).first()
    assert physics.preston_mean == pytest.approx(13 * 6) and physics.pressure_speed_exposure == pytest.approx(13 * 6 * 6)
    features = {r.feature: r.value for r in cmp.cmp_features(rows, critical=["WAFER_ROTATION"]).collect()}
    assert features["context__MACHINE_DATA__1.0__fraction"] == pytest.approx(3 / 7)
    assert features["PRESSURIZED_CHAMBER_PRESSURE__first"] == 10.0 and features["context__stage_b"] == 0.0
    assert cmp.campaign_id(rows.withColumn("_source_index", F.lit(27))).first().campaign == 2
    with pytest.raises(contracts.ContractError, match="missing required columns"):
        contracts.validate_trace_contract(rows.drop("PRESSURIZED_CHAMBER_PRESSURE"), cmp.TRACE_COLUMNS)


def test_slope_values(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 5.0), ("b", 1, 5.0), ("c", 0, 9.0)]
    df = spark.createDataFrame(rows, "k string, t int, value double")
    for hot in (None, 1):
        got = {r.k: r.slope for r in etch.trace_slope(df, ["k"], ["t"], hot_rows=hot).collect()}
        assert got["a"] == pytest.approx(1.5) and got["b"] == 0.0 and got["c"] == 0.0


def test_signal_values(spark):
    rows = spark.createDataFrame([("w", "s", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 3.0])], "wafer string, sensor string, ts_idx int, value double")
    acf = signal.autocorrelation(rows).first()
    assert acf.autocorr_lag_1 == pytest.approx(0.2075143392) and acf.autocorr_lag_8 == 0.0
    arrays = traces.trace_arrays(rows, ["wafer", "sensor"], samples=4)
    spectrum = signal.spectral_features(arrays).first()
    assert spectrum.spectral_total_power == pytest.approx(2.3978953, abs=1e-6)
    assert spectrum.spectral_centroid == pytest.approx(1.0) and spectrum.spectral_dominant_frequency == 1.0
    position = signal.position_stats(rows).first()
    assert (position.first, position.last, position.argmin, position.argmax) == (1.0, 3.0, 0.0, pytest.approx(2 / 3))
    steps = signal.difference_stats(rows).first()
    assert steps.diff_mean == pytest.approx(2 / 3) and steps.diff_abs_max == 2.0
    assert signal.signal_features(rows).count() == 1


def test_waveforms(spark):
    df = spark.createDataFrame([("a", [1.0, None, 3.0]), ("b", [None, None, None])], "k string, readings array<double>")
    out = {r.k: r.waveform for r in signal.interpolate_waveform(df, 5).collect()}
    assert out["a"] == [1.0, 1.5, 2.0, 2.5, 3.0] and out["b"] is None
    wave = [r for r in signal.interpolate_waveform(df, 5, normalise=True).collect() if r.k == "a"][0].waveform
    assert sum(wave) == pytest.approx(0) and math.sqrt(sum(v * v for v in wave) / 5) == pytest.approx(1)


def test_trace_scaling_uses_training_rows_only(spark):
    rows = [(1, "s", 0, 1.0), (1, "s", 1, None), (1, "s", 2, 3.0), (1, "s", 3, 2.0), (9, "s", 0, 100.0), (9, "s", 1, None)]
    df = spark.createDataFrame(rows, "wafer int, sensor string, ts_idx int, value double")
    filled = traces.trace_impute(df, F.col("wafer") == 1)
    assert {r.value for r in filled.filter("ts_idx = 1").collect()} == {2.0}
    scaled = traces.trace_scale(filled, F.col("wafer") == 1).filter("wafer = 9 AND ts_idx = 1").first()
    assert scaled.value == pytest.approx(0.0)
