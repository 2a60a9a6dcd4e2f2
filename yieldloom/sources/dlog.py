"""Tester logs: comma text with metadata lines, a T-number row, a units row, a name row and die rows.

Lines are classified by what they contain, not by their number, so large logs are
read in splits; one header row per file is joined back to its die rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions.text import creation_timestamp
from yieldloom.plans import measured, row_index

FIXED = ("Device #", "Bin", "Site", "X", "Y", "Fails", "Alarms")
DIE_FIELDS = ("device_no", "bin", "site", "x", "y", "fails", "alarms")
BLANKS = r"^(?:\s*,){7}"
QUOTED_FIELD = r',((?:"[^"]*+"|"|[^,"])*+)'
ROWS_PER_FILE = 1_000_000


def windows_text(latin: Column) -> Column:
    """Latin-1 text as Windows-1252: only the 0x80-0x9F block differs."""
    odd = bytes(range(0x80, 0xA0))
    return F.translate(latin, odd.decode("latin-1"), odd.decode("cp1252", errors="replace"))


def decoded_text(raw: Column) -> Column:
    """UTF-8 where valid, else Windows-1252."""
    return F.when(F.is_valid_utf8(raw), raw).otherwise(windows_text(F.decode(raw.cast("binary"), "ISO-8859-1")))


def read_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(source_file, place, line) of text files, read in splits; the place rises within a file."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths), recursiveFileLookup=True)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.col("_metadata.file_path").alias("source_file"), place.alias("place"), decoded_text(F.col("value")).alias("line"))


def fields(line: Column) -> Column:
    """Trimmed comma fields; quotes only matter on lines that have any."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(QUOTED_FIELD), F.lit(1))
    quoted = F.transform(cells, lambda c: F.trim(F.btrim(F.trim(c), F.lit('"'))))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.transform(F.split(line, ","), lambda c: F.trim(c)))


def placed(lines: DataFrame) -> DataFrame:
    """``lines`` with the place that ``read_lines`` gives; rows from elsewhere are taken in their order."""
    order = F.struct(F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines if "place" in lines.columns else lines.withColumn("place", order)


def _kind(line: Column) -> Column:
    low = F.lower(line)
    names = F.contains(low, F.lit("device")) & F.contains(low, F.lit("bin")) & F.contains(line, F.lit(","))
    return (
        F.when(names, "names")
        .when(line.rlike(r"^\s*\d+\s*,"), "die")  # most lines; never blank in front, so these come first
        .when(line.rlike(BLANKS) & line.rlike(r"T\d+"), "codes")
        .when(line.rlike(BLANKS), "units")
        .otherwise("meta")
    )


def scan_dlog_header(lines: DataFrame) -> DataFrame:
    """One row per file: creation time, program, test ids, names and units; ``names`` is NULL without a name row.

    Of several rows of a kind the first in the file counts. ``start`` is the place of the name row.
    """
    lines = placed(lines).withColumn("_kind", _kind(F.col("line")))
    kind = F.col("_kind")
    meta = lambda label: F.max(F.when(F.contains("line", F.lit(label)), F.trim(F.regexp_replace(F.split_part("line", F.lit(label), F.lit(2)), ",+$", ""))))
    row = lambda k: F.min_by(F.when(kind == k, fields(F.col("line"))), F.when(kind == k, F.col("place")))
    header = lines.filter(kind != "die").groupBy("source_file").agg(
        meta("File Creation Date:").alias("_created"), meta("Test Program:").alias("program"),
        row("names").alias("names"), row("codes").alias("codes"), row("units").alias("units"), F.min(F.when(kind == "names", F.col("place"))).alias("start"),
    )
    ids = F.transform("names", lambda n, i: F.coalesce(F.nullif(F.get("codes", i), F.lit("")), n))
    return header.select("source_file", creation_timestamp(F.col("_created")).alias("created_ts"), "program", "names", ids.alias("test_ids"), "units", "start")


def scan_dlog(lines: DataFrame) -> DataFrame:
    """Die rows with their ordered test values: (source_file, created_ts, die fields, tests array of (test_id, value)).

    Files without a name row have no rows here; ``dlog_rejected`` lists them. Dies stand below the name row. The files'
    headers are counted first: few are broadcast, so die rows are not shuffled to meet them.
    """
    header = measured(scan_dlog_header(lines).filter("names IS NOT NULL").select("source_file", "created_ts", "test_ids", "start"))
    dies = placed(lines).filter(_kind(F.col("line")) == "die").select("source_file", "place", fields(F.col("line")).alias("_f"))
    joined = dies.join(header, "source_file").filter(F.col("place") > F.col("start"))
    cell = lambda i: F.get("_f", F.lit(i))
    tests = F.transform(
        F.slice("test_ids", F.lit(len(FIXED) + 1), F.greatest(F.size("test_ids"), F.lit(0))),
        lambda t, i: F.struct(t.alias("test_id"), F.get("_f", i + len(FIXED)).try_cast("double").alias("value")),
    )
    listed = lambda c: F.filter(F.split(c, r"\s*,\s*"), lambda t: t != "")
    return joined.select(
        "source_file", "created_ts", cell(0).try_cast("int").alias("device_no"), cell(1).try_cast("int").alias("bin"),
        cell(2).try_cast("int").alias("site"), cell(3).try_cast("double").alias("x"), cell(4).try_cast("double").alias("y"),
        listed(cell(5)).alias("fails"), listed(cell(6)).alias("alarms"), tests.alias("tests"),
    )


def die_test(dies: DataFrame) -> DataFrame:
    """Long (source_file, device_no, site, test_id, value)."""
    return dies.select("source_file", "device_no", "site", F.explode("tests").alias("_t")).select(
        "source_file", "device_no", "site", "_t.test_id", "_t.value"
    )


def dlog_rejected(lines: DataFrame) -> DataFrame:
    """Files that have no name row and are therefore not read."""
    return scan_dlog_header(lines).filter("names IS NULL").select("source_file")


def write_die_table(dies: DataFrame, path: str, tests: Sequence[tuple[str, str, str]], *, wafer: str = "wafer", created: str = "", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes one log folder per wafer: header lines, then dies in (x, y) text order, renumbered per site.

    ``tests`` lists (test id, units, column). A wafer beyond ``rows_per_file`` dies continues in a
    further chunk with its own header, so no task writes an unbounded file.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = dies.withColumns({"_x": text("x"), "_y": text("y")})
    tie = [c for _, _, c in tests]
    numbered = row_index(keyed, [wafer, "site"], ["_x", "_y", *tie], name="device_no")
    placed = row_index(numbered, [wafer], ["_x", "_y", "site", "device_no"], name="_pos")
    listed = lambda c: F.concat(F.lit('"'), F.array_join(c, ","), F.lit('"'))
    line = F.concat_ws(",", F.col("device_no").cast("string"), text("bin"), text("site"), "_x", "_y", listed("fails"), listed("alarms"), *[text(c) for _, _, c in tests])
    chunk = F.floor((F.col("_pos") - 1) / rows_per_file).cast("int").alias("chunk")
    body = placed.select(F.col(wafer).alias("wafer"), chunk, F.lit(len(HEAD)).alias("_o"), "_pos", line.alias("line"))
    heads = _head_lines(tests, created)
    # A wafer's chunks follow from its number of dies, so heads need no positions.
    sizes = dies.groupBy(F.col(wafer).alias("wafer")).agg(F.count(F.lit(1)).alias("_n"))
    last = F.floor((F.col("_n") - 1) / rows_per_file).cast("int")
    starts = sizes.select("wafer", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    head = starts.withColumn("_h", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(h).alias("line")) for i, h in enumerate(heads)])))
    head = head.select("wafer", "chunk", F.col("_h.o").alias("_o"), F.lit(0).cast("long").alias("_pos"), F.col("_h.line").alias("line"))
    out = head.unionByName(body).repartition("wafer", "chunk").sortWithinPartitions("wafer", "chunk", "_o", "_pos")
    out.select("wafer", "chunk", "line").write.mode("errorifexists").partitionBy("wafer", "chunk").text(path)


HEAD = ("origin", "program", "created", "codes", "units", "names")


def _head_lines(tests, created: str) -> list[str]:
    blanks = [""] * len(FIXED)
    return [
        "Created from DLOG: merged",
        "Test Program: merged",
        f"File Creation Date: {created}",
        ",".join([*blanks, *[t for t, _, _ in tests]]),
        ",".join([*blanks, *[u for _, u, _ in tests]]),
        ",".join([*FIXED, *[c for _, _, c in tests]]),
    ]
