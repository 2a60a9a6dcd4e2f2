"""Readers and writers on small files."""

import gzip
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog import files
from yieldloom.operators import cleaning
from yieldloom.operators.contracts import ContractError
from yieldloom.sources import csvtext, dlog, heads, inventory, provenance, stdf

LOG = """Created from DLOG: x.std
Test Program: prog
File Creation Date: 04/25/2026 10:11:12
,,,,,,,T1.0,T1.1
,,,,,,,V,mA
Device #,Bin,Site,X,Y,Fails,Alarms,VDD,IDD
1,1,0,3,4,,,1.2,5.5
2,5,1,-1,0,"T1.0,T1.1",T1.1,1.9,
"""


def test_dlog(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LOG)
    (tmp_path / "b.csv").write_bytes("no header\n1,2,3\nMär\x80".encode("cp1252", "ignore"))
    lines = dlog.read_lines(spark, str(tmp_path))
    header = dlog.scan_dlog_header(lines).filter("names IS NOT NULL").first()
    assert header.created_ts.isoformat() == "2026-04-25T10:11:12" and header.program == "prog"
    assert header.test_ids[7:] == ["T1.0", "T1.1"] and header.units[7:] == ["V", "mA"]
    dies = dlog.scan_dlog(lines).orderBy("device_no").collect()
    assert len(dies) == 2
    assert (dies[0].bin, dies[0].x, dies[0].y, dies[0].fails) == (1, 3.0, 4.0, [])
    assert dies[1].fails == ["T1.0", "T1.1"] and dies[1].alarms == ["T1.1"]
    long = {(r.device_no, r.test_id): r.value for r in dlog.die_test(dlog.scan_dlog(lines)).collect()}
    assert long == {(1, "T1.0"): 1.2, (1, "T1.1"): 5.5, (2, "T1.0"): 1.9, (2, "T1.1"): None}
    assert [r.source_file.rsplit("/", 1)[-1] for r in dlog.dlog_rejected(lines).collect()] == ["b.csv"]


def test_die_table_round_trip(spark, tmp_path):
    rows = [("w1", 1, i % 2, i, 10 - i, ["T1.0"] if i == 3 else [], [], float(i)) for i in range(10)]
    dies = spark.createDataFrame(rows, "wafer string, bin int, site int, x int, y int, fails array<string>, alarms array<string>, v double")
    path = str(tmp_path / "out")
    dlog.write_die_table(dies, path, [("T1.0", "V", "v")], created="04/25/2026 10:11:12", rows_per_file=4)
    lines = dlog.read_lines(spark, path)
    back = dlog.scan_dlog(lines)
    assert lines.select("source_file").distinct().count() == 3
    assert back.count() == 10 and back.agg(F.sum(F.col("tests")[0]["value"])).first()[0] == 45.0
    by_site = {(r.site, r.x): r.device_no for r in back.collect()}
    assert [by_site[0, x] for x in (0, 2, 4)] == [1, 2, 3]


def test_die_table_positions_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    rows = [(w, 1, i % 2, i, 10 - i, [], [], float(i)) for w, n in (("w1", 9), ("w2", 4), (None, 5)) for i in range(n)]
    dies = spark.createDataFrame(rows, "wafer string, bin int, site int, x int, y int, fails array<string>, alarms array<string>, v double").withColumn("x", counted("x"))
    path = str(tmp_path / "out")
    dlog.write_die_table(dies, path, [("T1.0", "V", "v")], rows_per_file=4)
    assert seen.value == len(rows)  # not a second time for the heads
    lines = dlog.read_lines(spark, path)
    assert {tuple(r) for r in lines.filter("line like 'Device #%'").select(F.regexp_extract("source_file", "wafer=([^/]*)/chunk=[0-9]+", 0)).collect()} == {
        (f"wafer={w}/chunk={c}",) for w, n in (("w1", 3), ("w2", 1), ("__HIVE_DEFAULT_PARTITION__", 2)) for c in range(n)
    }
    assert dlog.scan_dlog(lines).count() == len(rows)


def _record(kind, sub, body, order="<"):
    return struct.pack(order + "HBB", len(body), kind, sub) + body


def _text(value):
    return bytes([len(value)]) + value.encode()


def _log(order="<"):
    out = [_record(0, 10, bytes([1 if order == ">" else 2, 4]), order)]
    out.append(_record(1, 10, struct.pack(order + "II", 0, 86400) + bytes(7) + b"".join(map(_text, ("LOT1", "PART", "node", "J750", "job"))), order))
    for site, x, y, sb in ((0, 5, 6, 1), (1, 0, 0, 65535)):
        out.append(_record(5, 10, bytes([1, site]), order))
        for number, name, value, flags in ((100, "VDD", 1.5, 0), (101, "X DIE", 7.0, 0x80), (102, "Y DIE", 8.0, 1)):
            out.append(_record(15, 10, struct.pack(order + "IBBBBf", number, 1, site, flags, 0, value) + _text(name) + _text("") + bytes(4) + struct.pack(order + "ff", -1.0, float("inf")) + _text("V"), order))
        out.append(_record(5, 20, struct.pack(order + "BBBHHHhh", 1, site, 0, 3, 9, sb, x, y), order))
    return b"".join(out) + b"\x01"  # a torn record at the end


@pytest.mark.parametrize("order", ["<", ">"])
def test_stdf(spark, tmp_path, order):
    (tmp_path / "a.std").write_bytes(_log(order))
    (tmp_path / "b.std.gz").write_bytes(gzip.compress(_log(order)))
    records = stdf.scan_stdf(spark, str(tmp_path))
    dies = stdf.stdf_die_rows(records).filter("source_file LIKE '%a.std'").orderBy("site").collect()
    assert [(d.bin, d.x, d.y, d.lot, d.program) for d in dies] == [(1, 5.0, 6.0, "LOT1", "job"), (9, 7.0, 8.0, "LOT1", "job")]
    assert dies[0].fails == ["T1.1"] and dies[0].alarms == ["T1.2"]
    assert dies[0].created_ts.isoformat() == "1970-01-02T00:00:00"
    tests = {r.test_id: r for r in stdf.stdf_tests(records).collect()}
    assert tests["T1.0"].test_name == "VDD" and tests["T1.0"].lsl == -1.0 and tests["T1.0"].usl is None
    assert stdf.stdf_die_tests(records).count() == 12


def test_die_tests_keep_what_is_known_of_the_die(spark):
    """Resolved bin and place, the master record's facts and T-coded fails and alarms stand beside each test's value."""
    records = stdf.decode_stdf(spark.createDataFrame([("/a.std", _log())], "path string, content binary"))
    for rows in (records, stdf.stdf_die_rows(records)):
        got = stdf.stdf_die_tests(rows).select("lot", "program", "site", "bin", "x", "y", "test_num", "test_id", "value", F.array_contains("fails", F.col("test_id")).alias("fails"), F.array_contains("alarms", F.col("test_id")).alias("alarms"))
        assert sorted(map(tuple, got.collect())) == [
            ("LOT1", "job", site, *die, number, code, value, code == "T1.1", code == "T1.2")
            for site, die in enumerate([(1, 5.0, 6.0), (9, 7.0, 8.0)])
            for number, code, value in ((100, "T1.0", 1.5), (101, "T1.1", 7.0), (102, "T1.2", 8.0))
        ]


def test_query_of_die_rows_resolves_dies(spark, tmp_path):
    """The query tells bins, places, fails and alarms of the dies, with the place that a test names where the result has none."""
    rows = [(7, 1001, 3, 2, 10.0, "N"), (7, 100, 50, 4, 20.0, "R")]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = files.stdf_die_rows(spark, str(tmp_path)).select("lot", "program", "created", "test_num", "test_id", "rows", "total", "passing", "x", "y", "failing", "alarms")
    head = ("L7", "job", 1_700_000_000)
    assert sorted(map(tuple, got.collect())) == [(*head, 1001, "T10.1", 2, 30.0, 1, 5.0, 3.0, 1, 0), (*head, 1002, "T10.2", 2, 6.0, 1, 5.0, 3.0, 0, 0)]


def _busy_log():
    """Two sites in turn; site 0 begins anew once, repeats a test and ends twice, site 1 never ends."""
    test = lambda number, site, value, flags=0: _record(15, 10, struct.pack("<IBBBBf", number, 1, site, flags, 0, value) + _text("X_DIE" if number == 7 else "V"))
    result = _record(5, 20, struct.pack("<BBBHHHhh", 1, 0, 0, 3, 9, 65535, 0, 0))
    return b"".join(
        [_record(0, 10, bytes([2, 4])), test(5, 0, 1.0), _record(5, 10, bytes([1, 0])), test(5, 1, 9.0), test(200_000, 0, 2.0, 0x80), test(7, 0, 3.0)]
        + [test(200_000, 0, 4.0, 0x81), result, result, test(5, 0, 6.0), result, test(3, 1, 1.0)]
    )


@pytest.mark.parametrize("held", [1, 4, 1_000])
def test_parts_over_several_runs_of_records(spark, monkeypatch, held):
    """Parts are the same however few records are held at a time; all rows know the file's smallest test."""
    monkeypatch.setattr(stdf, "RECORDS_AT_A_TIME", held)
    schema = stdf.to_arrow_schema(stdf.StructType.fromDDL(stdf.RECORD))
    rows = [r for rows in stdf._decode("/a.std", stdf.pa.py_buffer(_busy_log()), schema, 1) for r in rows.to_pylist()]
    parts, tests = [r for r in rows if r["kind"] == "part"], [r for r in rows if r["kind"] == "test"]
    assert [(p["seq"], [(t["test_num"], t["value"]) for t in p["tests"]], p["fails"], p["alarms"], p["x_named"]) for p in parts] == [
        (1, [(200_000, 4.0), (7, 3.0)], [200_000, 200_000], [200_000], 3.0), (2, [(5, 6.0)], [], [], None),
    ]
    assert [t["test_num"] for t in tests] == [5, 200_000, 7, 3] and {r["lowest_test"] for r in rows} == {3}


def test_logs_are_decoded_once(spark):
    """Codes need the file's smallest test number, but no second decoding of all files."""
    records = stdf.decode_stdf(spark.createDataFrame([("/a.std", _log())], "path string, content binary"))
    for out in (stdf.stdf_die_rows(records), stdf.stdf_tests(records)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_overrunning_text_is_empty():
    assert stdf._texts(b"\x02ab\x09cd", 0, 3) == (["ab", "", ""], 6)


def test_archives(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.std", _log())
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(inner, "inner.zip")
        z.writestr("y.stdf", b"y")
        z.writestr("__MACOSX/z.std", b"z")
    files = spark.read.format("binaryFile").load(str(tmp_path / "outer.zip"))
    assert sorted(r.path for r in inventory.expand_archives(files).collect()) == ["deep/x.std", "y.stdf"]


def test_semicolon_trace(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("lot;wafer;timestamp;sensor_1\nL1;1;timestamp_0;Mär.92\nL1;1;timestamp_1;1,5\n".encode("cp1252"))
    raw = csvtext.scan_semicolon_cp1252(spark, str(tmp_path / "t.csv"))
    got = cleaning.coerce_sensor(cleaning.long_trace(raw, "e")).orderBy("ts_idx").collect()
    assert [(r.ts_idx, r.value) for r in got] == [(0, 3.92), (1, 1.5)]


def test_sniffed_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("lot;sensor;label\nlot1;1,25;März\n".encode("cp1252"))
    row = csvtext.scan_table_sniff(spark, str(tmp_path / "a.csv")).first()
    assert row.asDict() == {"lot": "lot1", "sensor": "1,25", "label": "März"}
    (tmp_path / "b.csv").write_text(LOG)
    table = csvtext.scan_table_sniff(spark, str(tmp_path / "b.csv"))
    assert table.columns[:2] == ["Device #", "Bin"] and table.count() == 2


def test_cmp_files(spark, tmp_path):
    head = "WAFER_ID,STAGE,TIMESTAMP,CHAMBER,MACHINE_DATA,V\n"
    (tmp_path / "CMP-training-007.csv").write_text(head + "1,A ,0.5,4,2,x\n")
    (tmp_path / "CMP-training-012.csv").write_text(head + "1,B,1.5,4,2,3\n")
    (tmp_path / "CMP-training-013.csv").write_text("")
    got = csvtext.scan_cmp_traces(spark, str(tmp_path)).orderBy("_source_index").collect()
    assert [(r._source_index, r.STAGE, r.V) for r in got] == [(7, "A", None), (12, "B", 3.0)]


def test_limits(spark):
    raw = spark.createDataFrame([("T1.0", "x", "1.14", "1.26"), ("2.0", "y", None, "5")], "`Test Number` string, `Test Description` string, `STDF Min` string, `STDF Max` string")
    got = {r.test_key: (r.test_id, r.lsl, r.usl) for r in csvtext.scan_limits(raw).collect()}
    assert got == {"1_0": ("T1.0", 1.14, 1.26), "2_0": ("2.0", None, 5.0)}


def test_limits_files(spark, tmp_path):
    """Each file has its own delimiter, encoding, header and first lines."""
    (tmp_path / "a.csv").write_bytes("für X\n\nby;me\nTest Number;Größe;STDF Min;STDF Max\nT1.0;\"a;ü\";1.14;1.26\n;x;1;2\nT3.0;y;;\n".encode("cp1252"))
    (tmp_path / "b.csv").write_text("Max Limit,test_num,Min Limit\n5,2.0,\n")
    (tmp_path / "c.csv").write_text("")
    got = {r.test_key: (r.test_id, r.lsl, r.usl) for r in csvtext.read_limits(spark, str(tmp_path)).collect()}
    assert got == {"1_0": ("T1.0", 1.14, 1.26), "2_0": ("2.0", None, 5.0), "3_0": ("T3.0", None, None)}
    (tmp_path / "d.csv").write_text("test_num,low,high\n1,2,3\n")
    with pytest.raises(ContractError, match="minimum"):
        csvtext.read_limits(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("\n")
    with pytest.raises(ContractError, match="no table"):
        csvtext.read_yield_map(spark, str(tmp_path / "empty"))


def test_maps_of_files(spark, tmp_path):
    (tmp_path / "y.csv").write_text("LotId,Yield,YieldActual\nA.1,9,80\nA.2,9,85.5\nB,9,n/a\n")
    assert [tuple(r) for r in csvtext.read_yield_map(spark, str(tmp_path / "y.csv")).collect()] == [("A", 85.5)]
    (tmp_path / "t.csv").write_text("Generic|Tester Name|Part Name\nNAND|ets300_c1|MT1\nnan|J750|MT2\nDRAM||MT3\n")
    assert [tuple(r) for r in csvtext.read_tester_map(spark, str(tmp_path / "t.csv")).collect()] == [("NAND", "ets300_c1", "MT1", "J750")]


def test_file_heads(spark, tmp_path):
    """First bytes only, hidden files left out, one file or a folder, more files than one task reads."""
    for k in range(3):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "f.bin").write_bytes(bytes([k]) * 10 * k)
    (tmp_path / "d0" / "_SUCCESS").write_text("x")
    got = {(r.path[len(str(tmp_path)) :], r.length, bytes(r.head)) for r in heads.file_heads(spark, str(tmp_path), 12).collect()}
    assert got == {(f"/d{k}/f.bin", 10 * k, (bytes([k]) * 10 * k)[:12]) for k in range(3)}
    assert [r.length for r in heads.file_heads(spark, (tmp_path / "d2" / "f.bin").as_uri()).collect()] == [20]
    (tmp_path / "none").mkdir()
    assert heads.file_heads(spark, str(tmp_path / "none")).collect() == []
    reader = heads.HeadReader(str(tmp_path), 1)
    before, heads.FILES_AT_A_TIME = heads.FILES_AT_A_TIME, 2
    try:
        assert [len(p.files) for p in reader.partitions()] == [2, 1]
    finally:
        heads.FILES_AT_A_TIME = before
    with pytest.raises(FileNotFoundError):
        heads.HeadReader(str(tmp_path / "absent"), 1).partitions()


def test_facts_of_heads(spark):
    master = struct.pack(">HBBBB", 2, 0, 10, 1, 4) + struct.pack(">HBB", 15 + 8, 1, 10) + bytes(15) + b"\x02L1\x02P1\x01n\x00"
    rows = [("/a", master), ("/b", b"Lot\nPart Name : P2\r\nlot=L2"), ("/c", None), ("/d", master[:-2])]
    got = {r.path: tuple(r)[1:] for r in inventory.header_facts(spark.createDataFrame(rows, "path string, head binary")).collect()}
    assert got["/a"][1:] == ("L1", "P1", "n") and got["/b"] == ("Lot|Part Name : P2|lot=L2", "", "", "") and got["/c"] == ("", "", "", "") and got["/d"][1:] == ("", "", "")


def test_inventory(spark, tmp_path):
    base = tmp_path / "J750" / "DDR4_MT40"
    for name, size in (("SYN_0053_PRB_04252026_89.78%.std_1.csv", 20_000), ("SYN_0053_PRB_91.0%.csv", 20_000), ("SYN_0054_PRB_70%.csv", 20_000), ("SYN_0055_PRB_95%.csv", 10), ("x_limits.csv", 20_000), ("SYN_0053_FIN_90%.csv", 20_000)):
        base.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x" * size)
    files = inventory.list_files(spark, str(tmp_path))
    lots = inventory.inventory_lots(files).collect()
    assert [(r.norm_lot, r.yield_pct) for r in lots] == [("SYN_0053", 91.0)]
    final = inventory.final_test_inventory(files, "DDR4_MT40").collect()
    assert [(r.lot_id, r.yield_pct) for r in final] == [("SYN_0053", 90.0)]
    products = inventory.discover_products(files, str(tmp_path)).collect()
    assert {(p.family, p.generic, p.partname, p.lot_id) for p in products} == {("J750", "DDR4", "MT40", f"SYN_005{i}") for i in (3, 4, 5)}


def test_provenance(spark, tmp_path):
    with pytest.raises(provenance.LaneViolation, match="spc"):
        provenance.assert_functions_allowed("real_open_source", ["regression", "spc"])
    record = provenance.provenance_record(spark, "local_demonstration", "d", ["f"], ["psi", "psi"], "v").first()
    assert record.functions == ["psi"] and record.is_synthetic
    tables = {"metrics": spark.range(3), "ledger": spark.range(5)}
    provenance.write_evidence(tables, str(tmp_path / "e"))
    back = provenance.read_evidence(spark, str(tmp_path / "e"), ["ledger"])
    assert back["ledger"].count() == 5


def test_one_product_with_all_files_is_not_gathered(spark):
    """Whether a product has probe files is broadcast; its final files go, and a product without probes keeps them."""
    paths = [f"/d/F/{p}_X/L{k}/L{k}_{s}_.csv" for p, s in (("A", "PRB"), ("A", "FIN"), ("B", "FIN")) for k in range(3)]
    out = inventory.discover_products(spark.createDataFrame([(p,) for p in paths], "path string"), "/d")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert sorted((r.generic, r.lot_id) for r in out.collect()) == [("A", f"L{k}_PRB_") for k in range(3)] + [("B", f"L{k}_FIN_") for k in range(3)]
