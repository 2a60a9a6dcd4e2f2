"""Source and sink queries: files derived from the tables by Spark are written, read back and checked."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalog.base import query, r, table
from yieldloom.operators import golden
from yieldloom.plans import row_index
from yieldloom.session import scratch_path
from yieldloom.sources import csvtext, dlog, heads, inventory, provenance, stdf


@query("scan_semicolon_cp1252", """SELECT CAST(user_id AS VARCHAR) AS lot, count(*) AS rows, count(*) FILTER (event_id % 5 = 0) AS umlauts FROM events GROUP BY user_id""")
def scan_semicolon(spark, folder):
    ev = table(spark, folder, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "Mär.92").otherwise(F.col("value").cast("string"))
    path = scratch_path(spark, "semicolon")
    ev.select(F.col("user_id").cast("string").alias("lot"), raw.alias("sensor_1")).write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    out = csvtext.scan_semicolon_cp1252(spark, path)
    return out.groupBy("lot").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sensor_1") == "Mär.92").alias("umlauts"))


@query("scan_table_sniff", "SELECT c_mktsegment AS segment, count(*) AS rows, CAST(sum(c_custkey) AS DOUBLE) AS keys FROM customer GROUP BY 1")
def scan_table_sniff(spark, folder):
    path = scratch_path(spark, "sniff")
    table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_nationkey").write.csv(path, sep="|", header=True)
    return csvtext.scan_table_sniff(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("c_custkey").cast("double")).alias("keys"))


def cmp_rows(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_partkey").alias("WAFER_ID"), F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("STAGE"), F.col("l_orderkey").alias("TIMESTAMP"),
        F.col("l_linenumber").alias("CHAMBER"), F.col("l_suppkey").alias("MACHINE_DATA"), F.col("l_quantity").alias("HEAD_ROTATION"),
    )


CMP_SUM = "SELECT CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS \"STAGE\", count(*) AS rows, CAST(sum(l_partkey) AS DOUBLE) AS wafers, CAST(sum(l_quantity) AS DOUBLE) AS rotation FROM lineitem GROUP BY 1"


@query("scan_cmp_traces", CMP_SUM)
def scan_cmp_traces(spark, folder):
    path = scratch_path(spark, "cmp")
    cmp_rows(spark, folder).write.csv(path, header=True)
    out = csvtext.scan_cmp_traces(spark, path, pattern="part-*.csv", index=r"part-(\d+)").filter("_source_index IS NOT NULL")
    return out.groupBy("STAGE").agg(F.count(F.lit(1)).alias("rows"), F.sum("WAFER_ID").alias("wafers"), F.sum("HEAD_ROTATION").alias("rotation"))


@query("scan_multi_upload", "SELECT CAST(l_linenumber % 2 AS INTEGER) AS _source_index, count(*) AS rows FROM lineitem GROUP BY 1")
def scan_multi_upload(spark, folder):
    base = scratch_path(spark, "uploads")
    rows = cmp_rows(spark, folder)
    paths = [f"{base}/even", f"{base}/odd"]
    for i, path in enumerate(paths):
        rows.filter(F.col("CHAMBER") % 2 == i).write.csv(path, header=True)
    return csvtext.scan_multi_upload(spark, paths).groupBy("_source_index").agg(F.count(F.lit(1)).alias("rows"))


TESTS = [("T1.0", "V", "quantity"), ("T1.1", "pct", "discount")]


def _dlog_lines(spark, folder):
    li = table(spark, folder, "lineitem")
    fails = F.when(F.col("l_returnflag") == "R", F.array(F.lit("T1.0"), F.lit("T1.1"))).otherwise(F.array().cast("array<string>"))
    dies = li.select(
        (F.col("l_suppkey") % 10).alias("wafer"), F.when(F.col("l_returnflag") == "R", 5).otherwise(1).alias("bin"), F.col("l_linenumber").alias("site"),
        (F.col("l_orderkey") % 300).alias("x"), (F.col("l_partkey") % 300).alias("y"), fails.alias("fails"), F.array().cast("array<string>").alias("alarms"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
    )
    path = scratch_path(spark, "dlog")
    dlog.write_die_table(dies, path, TESTS, created="04/25/2026 10:11:12")
    return dlog.read_lines(spark, path)



@query("scan_dlog", f"""SELECT CAST(l_suppkey % 10 AS VARCHAR) AS wafer, t AS test_id, count(*) AS rows, {r("sum(CASE WHEN t = 'T1.0' THEN l_quantity ELSE l_discount END)", 'total')} FROM lineitem, (VALUES ('T1.0'), ('T1.1')) AS v(t) GROUP BY ALL""")
def scan_dlog(spark, folder):
    long = dlog.die_test(dlog.scan_dlog(_dlog_lines(spark, folder)))
    wafer = F.regexp_extract("source_file", r"wafer=(\d+)", 1).alias("wafer")
    return long.groupBy(wafer, "test_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


@query("scan_dlog_header", "SELECT CAST(l_suppkey % 10 AS VARCHAR) AS wafer, 'merged' AS program, '2026-04-25 10:11:12' AS created, 'T1.0,T1.1' AS tests FROM lineitem GROUP BY 1")
def scan_dlog_header(spark, folder):
    header = dlog.scan_dlog_header(_dlog_lines(spark, folder))
    wafer = F.regexp_extract("source_file", r"wafer=(\d+)", 1).alias("wafer")
    return header.select(wafer, "program", F.date_format("created_ts", "yyyy-MM-dd HH:mm:ss").alias("created"), F.array_join(F.slice("test_ids", 8, 10), ",").alias("tests"))


@query("write_die_table", "SELECT CAST(l_suppkey % 10 AS VARCHAR) AS wafer, CAST(l_linenumber AS INTEGER) AS site, count(*) AS dies, CAST(count(*) AS INTEGER) AS last_device, count(*) FILTER (l_returnflag = 'R') AS failing FROM lineitem GROUP BY ALL")
def write_die_table(spark, folder):
    dies = dlog.scan_dlog(_dlog_lines(spark, folder))
    wafer = F.regexp_extract("source_file", r"wafer=(\d+)", 1).alias("wafer")
    return dies.groupBy(wafer, "site").agg(F.count(F.lit(1)).alias("dies"), F.max("device_no").alias("last_device"), F.count_if(F.size("fails") == 2).alias("failing"))


# --- binary logs ----------------------------------------------------------------
def _record(kind: int, sub: int, body: bytes) -> bytes:
    return struct.pack("<HBB", len(body), kind, sub) + body


def _text(value: str) -> bytes:
    raw = value.encode()
    return bytes([len(raw)]) + raw


_PART = b"".join(
    [_record(5, 10, bytes(2))]
    + [_record(15, 10, struct.pack("<IBBBBf", number, 1, 0, 0, 0, 0) + _text(name) + _text("") + bytes([0]) + bytes(3) + struct.pack("<ff", 0.0, 50.0) + _text("V")) for number, name in ((1001, "quantity"), (1002, "X DIE"))]
    + [_record(5, 20, struct.pack("<BBBHHHhh", 1, 0, 0, 2, 9, 0, 0, 0))]
)
# Places in a part's bytes: its start, its two tests, its result.
_AT = [0, 6, 6 + 40, 6 + 40 + 37]


def _binary_log(lot: str, rows: pa.Table) -> bytes:
    """A minimal log: header, then part start, two tests and part result per row."""
    head = _record(0, 10, bytes([2, 4])) + _record(1, 10, struct.pack("<II", 1_700_000_000, 0) + bytes(7) + b"".join(map(_text, (lot, "PART", "n", "J750", "job"))))
    if any(rows[c].null_count for c in ("line", "x", "y")):
        raise ValueError("a part has no site or no place")
    line, x, y = (rows[c].to_numpy() for c in ("line", "x", "y"))
    if len(line) and not 0 <= line.min() <= line.max() <= 255:
        raise ValueError("a part's site is none from 0 to 255")
    ok, quantity = rows["ok"].fill_null(False).to_numpy(), rows["q"].cast("double").fill_null(float("nan")).to_numpy()
    parts = np.tile(np.frombuffer(_PART, np.uint8), (len(line), 1))
    start, first, second, result = _AT

    def put(at: int, cells: np.ndarray, form: str = "u1") -> None:
        parts[:, at : at + np.dtype(form).itemsize] = np.ascontiguousarray(cells, form).view(np.uint8).reshape(len(line), -1)

    parts[:, start + 4] = 1
    for at in (start + 5, first + 9, second + 9, result + 5):
        put(at, line)
    put(first + 10, np.where(ok, 0, 0x80))
    put(first + 12, quantity, "<f4")
    put(second + 12, line, "<f4")
    put(result + 11, np.where(ok, 1, 5), "<u2")
    put(result + 13, x, "<i2")
    put(result + 15, y, "<i2")
    return head + parts.tobytes()


def _log_files(spark, folder, rows: int = 2_000, packed: Callable[[bytes], bytes] | None = None):
    """(lot, path, content): one binary log per supplier and chunk of at most ``rows`` parts, or the archive ``packed`` makes of it."""
    li = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("lot"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") != "R").alias("ok"),
        (F.col("l_orderkey") % 50).alias("x"), (F.col("l_partkey") % 50).alias("y"), "l_orderkey",
    )
    placed = row_index(li, ["lot"], ["l_orderkey", "line", "q", "y"], name="pos").withColumn("chunk", F.floor((F.col("pos") - 1) / rows).cast("int"))
    ending = "zip" if packed else "std"

    schema = pa.schema([("lot", pa.int64()), ("path", pa.string()), ("content", pa.binary())])

    def encode(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        lot, chunk = (k.as_py() for k in key)
        name = f"L{'nan' if lot is None else lot}"
        content = _binary_log(name, part.sort_by("pos"))
        return pa.table([[lot], [f"/logs/{name}_{chunk}.{ending}"], [packed(content) if packed else content]], schema=schema)

    return placed.groupBy("lot", "chunk").applyInArrow(encode, "lot long, path string, content binary")


@query("scan_stdf", "SELECT 'L' || l_suppkey AS lot, CAST(l_linenumber AS INTEGER) AS site, CAST(CASE WHEN l_returnflag = 'R' THEN 5 ELSE 1 END AS INTEGER) AS bin, count(*) AS parts, CAST(sum(CASE WHEN l_orderkey % 50 = 0 AND l_partkey % 50 = 0 THEN l_linenumber ELSE l_orderkey % 50 END) AS DOUBLE) AS x, count(*) FILTER (l_returnflag = 'R') AS failing FROM lineitem GROUP BY ALL")
def scan_stdf(spark, folder):
    dies = stdf.stdf_die_rows(stdf.decode_stdf(_log_files(spark, folder)))
    return dies.groupBy("lot", "site", "bin").agg(F.count(F.lit(1)).alias("parts"), F.sum("x").alias("x"), F.count_if(F.array_contains("fails", "T10.1")).alias("failing"))


@query("stdf_die_rows", "SELECT 'L' || l_suppkey AS lot, 'job' AS program, CAST(1700000000 AS BIGINT) AS created, n AS test_num, 'T10.' || (n - 1000) AS test_id, count(*) AS rows, CAST(sum(CASE WHEN n = 1001 THEN l_quantity ELSE l_linenumber END) AS DOUBLE) AS total, count(*) FILTER (l_returnflag <> 'R') AS passing, CAST(sum(CASE WHEN l_orderkey % 50 = 0 AND l_partkey % 50 = 0 THEN l_linenumber ELSE l_orderkey % 50 END) AS DOUBLE) AS x, CAST(sum(l_partkey % 50) AS DOUBLE) AS y, count(*) FILTER (l_returnflag = 'R' AND n = 1001) AS failing, CAST(0 AS BIGINT) AS alarms FROM lineitem, (VALUES (CAST(1001 AS BIGINT)), (1002)) AS v(n) GROUP BY ALL")
def stdf_die_rows(spark, folder):
    dies = stdf.stdf_die_rows(stdf.decode_stdf(_log_files(spark, folder)))
    long = stdf.stdf_die_tests(dies)
    listed = lambda c: F.count_if(F.array_contains(c, F.col("test_id")))
    return long.groupBy("lot", "program", F.unix_timestamp("created_ts").alias("created"), "test_num", "test_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"), F.count_if(F.col("bin") == 1).alias("passing"), F.sum("x").alias("x"), F.sum("y").alias("y"), listed("fails").alias("failing"), listed("alarms").alias("alarms"),
    )


@query("stdf_tests", "SELECT DISTINCT 'L' || l_suppkey AS lot, t.* FROM lineitem, (VALUES (CAST(1001 AS BIGINT), 'quantity', 'V', CAST(0 AS DOUBLE), CAST(50 AS DOUBLE), 'T10.1'), (1002, 'X DIE', 'V', 0, 50, 'T10.2')) AS t(test_num, test_name, units, lsl, usl, test_id)")
def stdf_tests(spark, folder):
    tests = stdf.stdf_tests(stdf.decode_stdf(_log_files(spark, folder)))
    return tests.select(F.regexp_extract("source_file", r"/(L\d+)_", 1).alias("lot"), "test_num", "test_name", "units", "lsl", "usl", "test_id").distinct()


@query("expand_archives", "SELECT 'L' || l_suppkey AS lot, CAST(ceil(count(*) / 2000) AS BIGINT) * 2 AS members, count(*) * 2 AS parts FROM lineitem GROUP BY l_suppkey")
def expand_archives(spark, folder):
    def pack(data: bytes) -> bytes:
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("deep.std", data)
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("a.std", data)
            z.writestr("nested.zip", inner.getvalue())
            z.writestr("__MACOSX/x.std", b"no")
            z.writestr("readme.txt", b"no")
        return outer.getvalue()

    archives = _log_files(spark, folder, packed=pack)
    found = inventory.expand_archives(archives)
    parts = stdf.decode_stdf(found.select(F.concat_ws("!", "archive", "path").alias("path"), "content")).filter("kind = 'part'")
    lot = lambda c: F.regexp_extract(c, r"/(L\d+)_", 1).alias("lot")
    counts = parts.groupBy("lot").agg(F.count(F.lit(1)).alias("parts"))
    return found.groupBy(lot("archive")).agg(F.count(F.lit(1)).alias("members")).join(counts, "lot")


@query("archive_lot_folder", "SELECT l_suppkey AS k, 'HB' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN '_[01]' ELSE '_[02]_95%' END AS lot_folder FROM lineitem GROUP BY l_suppkey")
def archive_lot_folder(spark, folder):
    k = F.col("l_suppkey").cast("string")
    inside = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("HB"), k, F.lit("_[01]/"))).otherwise("plain/")
    members = table(spark, folder, "lineitem").select(
        F.concat(F.lit("/d/HB"), k, F.lit("_[02]_95%/a.zip")).alias("archive"), F.concat(inside, F.col("l_orderkey").cast("string"), F.lit(".std")).alias("path")
    )
    out = inventory.archive_lot_folder(members)
    return out.select(F.regexp_extract("archive", r"HB(\d+)", 1).cast("long").alias("k"), "lot_folder")


# --- maps and inventories ---------------------------------------------------------
@query("scan_limits", f"""SELECT p_partkey, 'T' || p_partkey || '.0' AS test_id, p_partkey || '_0' AS test_key, CASE WHEN p_partkey % 5 <> 0 THEN {r('CAST(p_size AS DOUBLE)', 'x').split(' AS x')[0]} END AS lsl, {r('p_retailprice', 'usl')} FROM part""")
def scan_limits(spark, folder):
    k = F.col("p_partkey")
    raw = table(spark, folder, "part").select(
        F.concat(F.lit(" T"), k.cast("string"), F.lit(".0")).alias("Test Number"), F.when(k % 5 != 0, F.col("p_size").cast("string")).alias("STDF Min"), F.col("p_retailprice").cast("string").alias("STDF Max")
    )
    return csvtext.scan_limits(raw).withColumn("p_partkey", F.regexp_extract("test_id", r"(\d+)", 1).cast("long"))


@query("scan_yield_map", "SELECT CAST(s_suppkey AS VARCHAR) AS lot, CAST(s_nationkey AS DOUBLE) AS \"yield\" FROM supplier WHERE s_suppkey % 4 <> 0")
def scan_yield_map(spark, folder):
    k = F.col("s_suppkey")
    raw = table(spark, folder, "supplier").select(F.concat(k.cast("string"), F.lit(".1")).alias("FabLotId"), F.when(k % 4 != 0, F.col("s_nationkey").cast("string")).otherwise("n/a").alias("CYActual"))
    return csvtext.scan_yield_map(raw)


@query("scan_tester_map", "WITH m AS (SELECT 'G' || (p_partkey % 40) AS generic, CASE p_size % 4 WHEN 0 THEN 'J750' WHEN 1 THEN 'J750' WHEN 2 THEN 'EAGLE' ELSE 'OTHER' END AS family FROM part) SELECT family, list_sort(list(DISTINCT generic)) AS generics FROM m GROUP BY family")
def scan_tester_map(spark, folder):
    s = F.col("p_size") % 4
    name = F.when(s == 0, "ets300_c2").when(s == 1, "J750EX").when(s == 2, "eagle_C1").otherwise("other_C5")
    raw = table(spark, folder, "part").select(F.concat(F.lit("G"), (F.col("p_partkey") % 40).cast("string")).alias("Generic Name"), name.alias("Tester "))
    return csvtext.generics_by_tester(csvtext.scan_tester_map(raw))


def _headed_files(spark, rows, heads, path):
    """Writes (file, value) rows as text, one file per ``file``, below its own first lines."""
    first = spark.createDataFrame([(f, n, line) for f, lines in heads.items() for n, line in enumerate(lines)], "file int, place int, value string")
    every = rows.select(F.col("file").cast("int"), F.lit(1_000).alias("place"), "value").unionByName(first)
    every.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)


def _spelled(k, *forms):
    """Text of one of several spellings, by file."""
    return F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))


@query("read_limits", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'T' || p_partkey || '.0' WHEN 1 THEN p_partkey || '.0' ELSE 't' || p_partkey || '_0' END AS test_id, p_partkey || '_0' AS test_key, CASE WHEN p_partkey % 5 <> 0 THEN {r('CAST(p_size AS DOUBLE)', 'x').split(' AS x')[0]} END AS lsl, {r('p_retailprice', 'usl')} FROM part""")
def read_limits(spark, folder):
    k, low, high = F.col("p_partkey"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string")).otherwise(""), F.col("p_retailprice").cast("string")
    value = _spelled(
        k, F.concat(F.lit(" T"), k, F.lit('.0;"a; b";'), low, F.lit(";"), high), F.concat(k, F.lit(".0,"), low, F.lit(","), high), F.concat(F.lit("t"), k, F.lit("_0\tname\t"), high, F.lit("\t"), low)
    )
    lines = [["limits of a product", "", "made by;planner", "Test Number;Description;STDF Min;STDF Max"], ["test_num,min_limit,max_limit"], ["revision\t4", "TEST NUM\tName\tMax Limit\tMin Limit"]]
    path = scratch_path(spark, "limits")
    _headed_files(spark, table(spark, folder, "part").select((k % 6).alias("file"), value.alias("value")), {f: lines[f % 3] for f in range(6)}, path)
    return csvtext.read_limits(spark, path).withColumn("p_partkey", F.regexp_extract("test_id", r"(\d+)", 1).cast("long"))


@query("read_yield_map", "SELECT CAST(s_suppkey AS VARCHAR) AS lot, CAST(s_nationkey AS DOUBLE) AS \"yield\" FROM supplier WHERE s_suppkey % 4 <> 0")
def read_yield_map(spark, folder):
    k = F.col("s_suppkey")
    value = F.when(k % 4 != 0, F.col("s_nationkey").cast("string")).otherwise("n/a")
    row = _spelled(k, F.concat(k, F.lit(".1,"), value), F.concat(value, F.lit(";"), k, F.lit(".1;x")), F.concat(k, F.lit("|"), value))
    path = scratch_path(spark, "yields")
    heads = {0: ["LotId,YieldActual"], 1: ["report of a week", "CYActual;FabLotId;Note"], 2: ["Lot_ID|Yield"]}
    _headed_files(spark, table(spark, folder, "supplier").select((k % 3).alias("file"), row.alias("value")), heads, path)
    return csvtext.read_yield_map(spark, path)


@query("read_tester_map", "WITH m AS (SELECT 'G' || (p_partkey % 40) AS generic, CASE p_size % 4 WHEN 0 THEN 'J750' WHEN 1 THEN 'J750' WHEN 2 THEN 'EAGLE' ELSE 'OTHER' END AS family FROM part) SELECT family, list_sort(list(DISTINCT generic)) AS generics FROM m GROUP BY family")
def read_tester_map(spark, folder):
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    name = F.when(s == 0, "ets300_c2").when(s == 1, "J750EX").when(s == 2, "eagle_C1").otherwise("other_C5")
    generic = F.concat(F.lit("G"), k % 40)
    path = scratch_path(spark, "testers")
    rows = table(spark, folder, "part").select((k % 2).alias("file"), _spelled(k, F.concat(generic, F.lit(","), name, F.lit(",P"), k), F.concat(name, F.lit(" ; "), generic)).alias("value"))
    _headed_files(spark, rows, {0: ["Generic Name,Tester,Part"], 1: ["testers in use", "TESTER TYPE;Generic"]}, path)
    return csvtext.generics_by_tester(csvtext.read_tester_map(spark, path))


@query("sniff_files", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'MTX' || s_suppkey WHEN 1 THEN 'MT40A1G' WHEN 2 THEN 'MTMIR' ELSE 'MT40A1G' END AS partname, CASE s_suppkey % 4 WHEN 0 THEN 'LX' || s_nationkey WHEN 1 THEN 'LOT' || s_nationkey WHEN 2 THEN 'MIR' || s_nationkey END AS lot_id,
CASE s_suppkey % 4 WHEN 2 THEN 'NAND' WHEN 0 THEN 'LPDDR5' ELSE 'DDR4SDRAM' END AS generic, CASE s_suppkey % 4 WHEN 1 THEN 'J750' WHEN 2 THEN 'HP94' END AS tester FROM supplier""")
def sniff_files(spark, folder):
    path = scratch_path(spark, "heads")

    def write(frames):
        for frame in frames:
            for k, n in zip(frame["s_suppkey"], frame["s_nationkey"]):
                master = _record(0, 10, bytes([2, 4])) + _record(1, 10, struct.pack("<II", 1_700_000_000, 0) + bytes(7) + b"".join(map(_text, (f"MIR{n}", "MTMIR", "node", "HP94", "job"))))
                name, content = [
                    ("file.csv", f"site 1\nPart Name: MTX{k}\nLot ID = LX{n}\nGeneric,LPDDR5\n".encode() + b"1,2,3\n" * 20_000), (f"DDR4SDRAM_mt40a1g_LOT{n}.csv", b"1,2,3\n"),
                    ("file.std", master + bytes(100_000)), ("file.txt", b"lot\nx\ngeneric: DDR4SDRAM\n" + b"-\n" * 40 + b"lot id: LATE\n"),
                ][k % 4]
                system, root = heads.located(path)
                system.create_dir(f"{root}/{k}", recursive=True)
                with system.open_output_stream(f"{root}/{k}/{name}", compression=None) as out:
                    out.write(content)
            yield frame[["s_suppkey"]]

    table(spark, folder, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(write, "s_suppkey long").count()
    tester_map = spark.createDataFrame([("DDR4SDRAM", "J750", "MT40A1G"), ("NAND", "EAGLE", "mtmir")], "generic string, tester string, partname string")
    out = inventory.sniff_files(spark, path, tester_map)
    return out.select(F.element_at(F.split("path", "/"), -2).cast("long").alias("s_suppkey"), "partname", "lot_id", "generic", "tester")


def _files(spark, folder):
    """One probe data file per order: lot = customer, yield from the order key, written at the order date."""
    k = F.col("o_orderkey")
    y = F.format_string("%.1f", 75 + (k % 250) / 10.0)
    lot = F.concat(F.lit("HB"), F.col("o_custkey").cast("string"))
    stage = F.when(k % 4 == 0, "FIN").otherwise("PRB")
    path = F.concat(F.lit("/data/J750/DDR4_MT40/"), lot, F.lit("_[01]_"), y, F.lit("%/MT40_"), lot, F.lit("_"), stage, F.lit("_04252026_"), k.cast("string"), F.lit(".csv"))
    return table(spark, folder, "orders").select(path.alias("path"), (k % 7 * 4000).alias("length"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))


FILES = """f AS (SELECT o_orderkey AS k, 'HB' || o_custkey AS lot, round(75 + (o_orderkey % 250) / 10.0, 1) AS y, o_orderdate AS t, o_orderkey % 7 * 4000 AS length, CASE WHEN o_orderkey % 4 = 0 THEN 'FIN' ELSE 'PRB' END AS stage FROM orders),
p AS (SELECT *, '/data/J750/DDR4_MT40/' || lot || '_[01]_' || printf('%.1f', y) || '%/MT40_' || lot || '_' || stage || '_04252026_' || k || '.csv' AS path FROM f)"""


@query("inventory_lots", f"WITH {FILES} SELECT lot AS norm_lot, y AS yield_pct, '2026' AS year, path FROM p WHERE length > 10240 AND y >= 80 QUALIFY row_number() OVER (PARTITION BY lot ORDER BY y DESC, t DESC, path) = 1")
def inventory_lots(spark, folder):
    return inventory.inventory_lots(_files(spark, folder)).select("norm_lot", "yield_pct", "year", "path")


@query("final_test_inventory", f"WITH {FILES} SELECT 'MT40' AS norm_lot, max(y) AS yield_pct FROM p WHERE length > 10240 AND stage = 'FIN'")
def final_test_inventory(spark, folder):
    return inventory.final_test_inventory(_files(spark, folder), "DDR4_MT40").select("norm_lot", "yield_pct")


@query("discover_products", f"WITH {FILES} SELECT 'J750' AS family, 'DDR4' AS generic, 'MT40' AS partname, 'MT40_' || lot || '_' || stage || '_04252026_' || k AS lot_id, min(path) AS path FROM p WHERE stage = 'PRB' GROUP BY ALL")
def discover_products(spark, folder):
    return inventory.discover_products(_files(spark, folder), "/data").select("family", "generic", "partname", "lot_id", "path")


@query("sniff_metadata", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'MTX' || p_partkey WHEN 1 THEN 'MT40A1G' ELSE 'MTMIR' END AS partname, CASE p_partkey % 3 WHEN 0 THEN 'LX' || p_size WHEN 1 THEN 'LOT' || p_size ELSE 'MIR' || p_size END AS lot_id, CASE p_partkey % 3 WHEN 1 THEN 'DDR4SDRAM' WHEN 2 THEN 'NAND' END AS generic, CASE p_partkey % 3 WHEN 1 THEN 'J750' WHEN 2 THEN 'EAGLE' END AS tester FROM part""")
def sniff_metadata(spark, folder):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    m = k % 3
    files = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("/x/DDR4SDRAM_mt40a1g_LOT"), s, F.lit(".csv")).alias("_named"), m.alias("_m"),
        F.when(m == 0, F.concat(F.lit("Part Name: MTX"), k.cast("string"), F.lit("\nLot ID = LX"), s)).otherwise("").alias("head"),
        F.when(m == 2, "MTMIR").alias("mir_part"), F.when(m == 2, F.concat(F.lit("MIR"), s)).alias("mir_lot"), F.lit(None).cast("string").alias("mir_tester"),
    )
    files = files.withColumn("path", F.concat(F.lit("/"), k.cast("string"), F.when(F.col("_m") == 1, F.col("_named")).otherwise(F.lit("/x/file.csv"))))
    tester_map = spark.createDataFrame([("DDR4SDRAM", "J750", "MT40A1G"), ("NAND", "EAGLE", "mtmir")], "generic string, tester string, partname string")
    out = inventory.sniff_metadata(files, tester_map)
    return out.select(F.split("path", "/")[1].cast("long").alias("p_partkey"), "partname", "lot_id", "generic", "tester")


@query("actual_yield_lookup", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 71.5 WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 80.0 + c_nationkey ELSE 60.0 + c_nationkey END END::DOUBLE AS actual_yield FROM customer")
def actual_yield_lookup(spark, folder):
    m, syn = F.col("c_custkey") % 3, F.format_string("syn_%04d", "c_nationkey")
    wafers = table(spark, folder, "customer").select("c_custkey", F.when(m == 0, "w_71.5%.csv").when(m == 1, F.concat(F.lit("w_"), syn, F.lit(".csv"))).otherwise("w.csv").alias("filename"), F.lit("L1").alias("lot_id"))
    nation = table(spark, folder, "nation")
    lot = F.format_string("SYN_%04d", "n_nationkey").alias("lot_id")
    final = nation.filter("n_nationkey % 2 = 0").select(lot, (80.0 + F.col("n_nationkey")).alias("yield_pct"))
    probe = nation.select(lot, (60.0 + F.col("n_nationkey")).alias("yield_pct"))
    return golden.actual_yield_lookup(wafers, final, probe).select("c_custkey", "actual_yield")


# --- provenance -------------------------------------------------------------------
@query("source_fingerprint", "SELECT doc_id, sha256(text) AS digest FROM documents")
def source_fingerprint(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "utf-8").alias("content"))
    out = provenance.source_fingerprint(docs)
    return out.select(F.col("name").cast("long").alias("doc_id"), "digest")


@query("dataset_version", "WITH d AS (SELECT conv_id, turn || ':' || sha256(text) AS e FROM conversations) SELECT conv_id, count(*) AS files, substr(sha256(string_agg(e, '|' ORDER BY e)), 1, 16) AS version FROM d GROUP BY conv_id")
def dataset_version(spark, folder):
    files = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("string").alias("name"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))
    return provenance.dataset_version(files, ["conv_id"])


@query("tree_version", """WITH e AS (SELECT source, sha256(concat_ws(':', doc_id, sha256(text))) AS h, count(*) AS n FROM documents GROUP BY ALL),
leaves AS (SELECT source, substr(h, 1, 4) AS p, sha256(string_agg(h || ':' || n, '|' ORDER BY h)) AS d, sum(n) AS n FROM e GROUP BY ALL),
inner_nodes AS (SELECT source, substr(p, 1, 2) AS q, sha256(string_agg(d, '|' ORDER BY p)) AS d, sum(n) AS n FROM leaves GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS files, substr(sha256(string_agg(d, '|' ORDER BY q)), 1, 16) AS version FROM inner_nodes GROUP BY source""")
def tree_version(spark, folder):
    files = table(spark, folder, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    return provenance.tree_version(files, ["source"])


@query("write_evidence", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer")
def write_evidence(spark, folder):
    path = scratch_path(spark, "evidence")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    provenance.write_evidence({"nation": table(spark, folder, "nation"), "customer": customers}, path)
    stored = provenance.read_evidence(spark, path, ["nation", "customer"])
    return stored["nation"].withColumn("n_nationkey", F.col("n_nationkey").cast("long")).union(stored["customer"])


@query("export_decoded_samples", f"SELECT CAST(l_partkey AS VARCHAR) AS experiment_key, count(*) AS rows, {r('sum(l_quantity)', 'total')} FROM lineitem GROUP BY 1")
def export_decoded_samples(spark, folder):
    path = scratch_path(spark, "samples")
    provenance.export_decoded_samples(table(spark, folder, "lineitem").select(F.col("l_partkey").alias("experiment_key"), F.col("l_quantity").alias("v")), path)
    out = spark.read.csv(path, header=True)
    return out.groupBy("experiment_key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("v").cast("double")).alias("total"))


@query("feature_cache", f"SELECT l_suppkey, {r('avg(l_quantity)', 'mean')} FROM lineitem GROUP BY 1")
def feature_cache(spark, folder):
    path = scratch_path(spark, "features")
    build = lambda: table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"))
    provenance.feature_cache(spark, path, build)
    return provenance.feature_cache(spark, path, lambda: build().filter("false"))


@query("provenance_record", "WITH d AS (SELECT item_id || ':' || sha256(text) AS e FROM benchmark) SELECT 'benchmark' AS dataset, substr(sha256(string_agg(e, '|' ORDER BY e)), 1, 16) AS version, false AS is_synthetic, count(*) AS files FROM d")
def provenance_record(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    found = provenance.dataset_version(items).first()
    record = provenance.provenance_record(spark, "real_open_source", "benchmark", ["benchmark"], ["data_quality"], found["version"])
    return record.select("dataset", "version", "is_synthetic", F.lit(found["files"]).alias("files"))
