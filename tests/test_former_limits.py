"""Rows just beyond what earlier versions cut off, refused or decided by size."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from yieldloom import session
from yieldloom.functions import text
from yieldloom.operators import etch, folds, joins, models, profile, signal, traces
from yieldloom.operators.contracts import ContractError
from yieldloom.sources import csvtext, inventory, provenance


def test_codes_beyond_sixteen_bits(spark):
    codes = spark.createDataFrame([(1, 70_000), (2, 5), (3, 9)], "row long, code int")
    dictionary = spark.createDataFrame([(70_000, 1.5), (5, 2.5), (5, 2.5)], "code int, value double")
    assert {r.row: r.value for r in etch.decode_dictionary(codes, dictionary).collect()} == {1: 1.5, 2: 2.5, 3: None}
    with pytest.raises(ContractError):
        etch.decode_dictionary(codes, dictionary.union(spark.createDataFrame([(5, 3.5)], dictionary.schema)))


@pytest.mark.parametrize("index", [200, -1, None])
def test_readings_outside_a_trace_are_refused(spark, index):
    rows = spark.createDataFrame([("w", 0, 1.0), ("w", index, 2.0)], "wafer string, ts_idx int, value double")
    with pytest.raises(Exception, match="outside the trace"):
        traces.trace_arrays(rows, ["wafer"]).collect()


def test_all_rows_are_judged(spark):
    rows = spark.range(50_001).select(F.when(F.col("id") == 50_000, 7.0).otherwise(1.0).alias("v"))
    assert profile.analyzable_numeric(rows).count() == 50_001


def test_bank_keeps_all_waveforms(spark):
    arrays = spark.range(600).select(F.col("id").alias("wafer"), F.lit("s").alias("sensor"), F.array(*[F.col("id") * 1.0 + k for k in range(4)]).alias("readings"))
    assert signal.waveform_bank(arrays, points=4).count() == 600


def test_groups_beyond_ten_thousand_keep_the_rule(spark):
    rows = spark.range(20_002).select((F.col("id") % 10_001).alias("lot"), (F.col("id") % 2).alias("bad"))
    for out in (folds.group_kfold(rows), folds.stratified_group_kfold(rows, "bad")):
        sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
        assert out.groupBy("lot").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_more_than_a_hundred_folds(spark):
    rows = spark.range(404).select((F.col("id") % 101).alias("fold"), F.when(F.col("id") % 101 == 3, 1.0).alias("only"), F.col("id").alias("x"))
    usable = models._usable_features(rows, ["only", "x"], "fold")
    assert len(usable) == 101 and usable[3] == ["x"] and usable[4] == ["only", "x"] and len(models._folds(rows, "fold")) == 101
    assert models.mean_baseline_ledger(rows, ["x"], "x").count() == 404


def test_preamble_lines_may_come_again_as_data(spark, tmp_path):
    note = "note;of the run"
    body = "\n".join(f"{k};{k + 1};{k + 2}" for k in range(90))
    (tmp_path / "t.csv").write_text(f"{note}\n\nplain\na;b;c\n{body}\n{note}\n1;2;3;4\n")
    table = csvtext.scan_table_sniff(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["a", "b", "c"] and table.count() == 92
    assert sorted(r.fields for r in csvtext.uneven_lines(spark, str(tmp_path / "t.csv")).collect()) == [2, 4]
    (tmp_path / "u.csv").write_text("x;y;z\n1;2;3\n")
    with pytest.raises(ContractError):
        csvtext.scan_table_sniff(spark, str(tmp_path))


def test_lots_with_a_long_common_prefix(spark):
    rows = [(f"/data/J750/DDR4_MT40/COMMONPREFIX_LOT_{k}.csv",) for k in (1, 2)]
    assert inventory.discover_products(spark.createDataFrame(rows, "path string"), "/data").count() == 2


def test_long_digit_runs_sort_by_value(spark):
    names = ["T" + "9" * 25, "T" + "1" + "0" * 25, "T2", "T010"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(text.natural_sort(F.col("n"))).collect()] == ["T2", "T010", names[0], names[1]]


def test_versions_of_lists_and_keys(spark):
    import hashlib

    rows = [(k % 2, f"f{k:03d}", f"d{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "part int, name string, digest string").repartition(4)
    want = lambda some: hashlib.sha256("|".join(sorted(f"{n}:{d}" for _, n, d in some)).encode()).hexdigest()[:16]
    assert [tuple(r) for r in provenance.dataset_version(df).collect()] == [(300, want(rows))]
    assert {tuple(r) for r in provenance.dataset_version(df, ["part"]).collect()} == {(p, 150, want([r for r in rows if r[0] == p])) for p in (0, 1)}


def test_tree_versions_depend_on_entries_alone(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(k % 2, f"f{k:03d}", f"d{k}") for k in range(300)] + [(0, "f000", "d0")] * 3 + [(1, None, "d"), (1, "n", None)]
    df = spark.createDataFrame(rows, "part int, name string, digest string")

    def root(some):
        counts = {}
        for _, n, d in some:
            h = sha(":".join(x for x in (n, d) if x is not None))
            counts[h] = counts.get(h, 0) + 1
        nodes = {h: f"{h}:{c}" for h, c in counts.items()}
        for digits in (4, 2, 0):
            nodes = {p: sha("|".join(nodes[h] for h in sorted(nodes) if h.startswith(p))) for p in {h[:digits] for h in nodes}}
        return nodes[""][:16]

    want = root(rows)
    assert {tuple(provenance.tree_version(df.repartition(n)).first()) for n in (1, 50)} == {(305, want)}
    per_key = {r.part: (r.files, r.version) for r in provenance.tree_version(df, ["part"]).collect()}
    assert per_key == {p: (len(own := [r for r in rows if r[0] == p]), root(own)) for p in (0, 1)}
    assert provenance.tree_version(df.limit(0)).collect() == []


def test_shared_folder_is_needed_off_one_machine():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)


def test_limits_without_product_pairs(spark):
    wafers = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "product string, lot string")
    files = spark.createDataFrame([("p", "a", "own2"), ("p", "a", "own1"), ("p", None, "all"), ("r", None, "other")], "product string, lot string, limit_file string")
    got = {(r.product, r.lot): r.limit_file for r in joins.resolve_limits(wafers, files).collect()}
    assert got == {("p", "a"): "own1", ("p", "b"): "all", ("q", "a"): None}
