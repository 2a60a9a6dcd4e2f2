"""File inventories: what the names and sizes of data files tell about lots and products."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions import text
from yieldloom.operators.sets import latest_per_key
from yieldloom.plans import measured
from yieldloom.sources.heads import file_heads
from yieldloom.sources.stdf import master_texts

SMALLEST_FILE = 10_240
DATA_ENDINGS = (".stdf", ".std", ".std_1", ".stdf.gz", ".std.gz", ".std_1.gz")
# Product families recognised in file names.
GENERICS = ("DDR4SDRAM", "DDR5SDRAM", "LPDDR4", "LPDDR5", "NAND")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime); file contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))


def _data_csv(files: DataFrame) -> DataFrame:
    name = F.lower(_name(F.col("path")))
    keep = name.endswith(".csv") & ~name.endswith("_limits.csv") & ~name.startswith("merged_features")
    return files.filter(keep & (F.col("length") > SMALLEST_FILE))


def _described(files: DataFrame) -> DataFrame:
    name, folder = _name(F.col("path")), _folder(F.col("path"))
    both = F.concat_ws(" ", folder, name)
    lot = text.lot_from_path(folder, name)
    year = F.when(text.fiscal_year(name) != "Unknown", text.fiscal_year(name)).otherwise(text.fiscal_year(folder))
    return files.select(
        "path", name.alias("filename"), lot.alias("lot_id"), text.normalize_lot_id(lot).alias("norm_lot"),
        F.coalesce(text.yield_from_path(both), F.lit(0.0)).alias("yield_pct"), year.alias("year"), "modificationTime",
    )


def inventory_lots(files: DataFrame, lot_years: DataFrame | None = None, minimum_yield: float = 80.0) -> DataFrame:
    """Best file per lot of data files with a good enough yield: highest yield, then newest.

    ``lot_years`` (norm_lot, fiscal_year) fills years the names do not tell.
    """
    good = _described(_data_csv(files)).filter(F.col("yield_pct") >= minimum_yield)
    if lot_years is not None:
        good = good.join(lot_years.groupBy("norm_lot").agg(F.max("fiscal_year").alias("_fy")), "norm_lot", "left")
        good = good.withColumn("year", F.when(F.col("year") == "Unknown", F.coalesce("_fy", "year")).otherwise(F.col("year"))).drop("_fy")
    return latest_per_key(good, ["norm_lot"], F.desc("yield_pct"), F.desc("modificationTime"), F.asc("path"))


def final_test_inventory(files: DataFrame, generic: str) -> DataFrame:
    """Best final-test file per lot of a product; any product's final-test files when it has none."""
    upper = F.upper("path")
    final = _data_csv(files).filter(F.contains(upper, F.lit("_FIN_")) | F.contains(upper, F.lit("FT_DECRYPTED")))
    wanted = generic.upper().replace("_", "")
    own = final.filter(F.contains(F.replace(upper, F.lit("_"), F.lit("")), F.lit(wanted)))
    chosen = final if own.isEmpty() else own
    name, folder = _name(F.col("path")), _folder(F.col("path"))
    both = F.concat_ws(" ", folder, name)
    syn = F.regexp_extract(both, r"(SYN_\d+)", 1)
    lot = F.when(syn != "", syn).otherwise(F.split(name, "_")[0])
    rows = chosen.select(
        "path", name.alias("filename"), lot.alias("lot_id"), text.normalize_lot_id(lot).alias("norm_lot"),
        F.coalesce(text.yield_from_path(both), F.lit(0.0)).alias("yield_pct"), "modificationTime",
    )
    return latest_per_key(rows, ["norm_lot"], F.desc("yield_pct"), F.desc("modificationTime"), F.asc("path"))


def discover_products(files: DataFrame, root: str) -> DataFrame:
    """One row per (family, product, lot) found in the layout root/family/product/...; probe files are preferred.

    Product folders are named generic_part. Limits and feature tables are no lots.
    """
    rest = F.split(F.regexp_replace("path", "^.*" + root.strip("/") + "/", ""), "/")
    name = _name(F.col("path"))
    low = F.lower(name)
    is_data = (low.endswith(".csv") | low.endswith(".stdf")) & ~low.endswith("_limits.csv") & ~low.startswith("limit") & ~low.startswith("merged_features")
    rows = files.withColumn("_p", rest).filter(is_data & (F.size("_p") >= 3))
    syn = F.regexp_extract(F.concat_ws(" ", _folder(F.col("path")), name), r"(SYN_\d+)", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    upper = F.upper(name)
    final = F.contains(upper, F.lit("_FIN_")) | F.contains(upper, F.lit("FINAL")) | F.contains(upper, F.lit("FT_"))
    described = rows.select(
        F.col("_p")[0].alias("family"), F.col("_p")[1].alias("product"), "path", F.when(syn != "", syn).otherwise(stem).alias("lot_id"), final.alias("_final"),
        F.contains(upper, F.lit("_PRB_")).alias("_probe"), F.coalesce(text.yield_from_path(F.concat_ws(" ", name, _folder(F.col("path")))), F.lit(0.0)).alias("yield_pct"),
    )
    probes = described.groupBy("family", "product").agg(F.max("_probe").alias("_has_probe"))
    # A product may have most files: few products are broadcast, so its files need not meet.
    kept = described.join(measured(probes), ["family", "product"]).filter(~(F.col("_has_probe") & F.col("_final")))
    best = latest_per_key(kept, ["family", "product", "lot_id"], F.asc("path"))
    parts = F.split("product", "_", 2)
    return best.select("family", "product", parts[0].alias("generic"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("partname"), "lot_id", "yield_pct", "path")


# Labels of header lines and the forms of part and lot names.
HEADER_PART = r"(?i)(?:part\s*name|part|ptyp)[\s:=,]+([A-Za-z0-9_\-]+)"
HEADER_LOT = r"(?i)(?:lot\s*id|lot)[\s:=,]+([A-Za-z0-9_\-]+)"
HEADER_GENERIC = r"(?i)generic[\s:=,]+([A-Za-z0-9_\-]+)"
PART_FORM = r"^MT[0-9A-Z]{5,}"
LOT_FORM = r"^(?:LOT|CDK|WAFER)[0-9A-Z]*"


def sniff_metadata(files: DataFrame, tester_map: DataFrame) -> DataFrame:
    """part, lot, generic and tester per file from decoded header facts, header text, file name, then the tester map.

    ``files`` has (path, head) and may have mir_lot, mir_part, mir_tester from decoded binary headers.
    """
    have = set(files.columns)
    fact = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    found = lambda pattern: F.nullif(F.regexp_extract("head", pattern, 1), F.lit(""))
    stem = F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "")
    tokens = F.split(stem, r"[_.\-]+")
    first = lambda test: F.get(F.filter(tokens, test), F.lit(0))
    plain = (fact("mir_part").isNull() & fact("mir_lot").isNull())
    header = lambda pattern: F.when(plain, found(pattern))
    part = F.coalesce(fact("mir_part"), header(HEADER_PART), F.upper(first(lambda t: F.upper(t).rlike(PART_FORM))))
    lot = F.coalesce(fact("mir_lot"), header(HEADER_LOT), first(lambda t: F.upper(t).rlike(LOT_FORM)))
    generic = F.coalesce(header(HEADER_GENERIC), F.upper(first(lambda t: F.upper(t).isin(*GENERICS))))
    rows = files.select("path", part.alias("partname"), lot.alias("lot_id"), generic.alias("generic"), fact("mir_tester").alias("tester"))
    by_part = tester_map.groupBy(F.upper(F.trim("partname")).alias("_part")).agg(F.min("generic").alias("_g"), F.min("tester").alias("_t"))
    by_generic = tester_map.groupBy(F.upper(F.trim("generic")).alias("_gen")).agg(F.min("partname").alias("_p"))
    out = rows.join(by_part, F.upper("partname") == F.col("_part"), "left").join(by_generic, F.upper("generic") == F.col("_gen"), "left")
    return out.select(
        "path", F.coalesce("partname", "_p").alias("partname"), "lot_id", F.coalesce("generic", "_g").alias("generic"), F.coalesce("tester", "_t").alias("tester"),
    )


#: Bytes and lines of a text file in which header lines are looked for.
TEXT_BYTES, TEXT_LINES = 4_096, 25


def header_facts(heads: DataFrame) -> DataFrame:
    """(path, head, mir_lot, mir_part, mir_tester) of (path, head bytes): decoded master records, and the first lines as text.

    Lines are parted by ``|``, so that a label and its value are found on one line only.
    """

    @F.pandas_udf("head string, mir_lot string, mir_part string, mir_tester string")
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            data = bytes(data or b"")
            (lot, part, node, tester), _ = master_texts(data)
            lines = data[:TEXT_BYTES].decode("utf-8", "ignore").splitlines()[:TEXT_LINES]
            rows.append(("|".join(line.strip() for line in lines), lot, part, tester or node))
        return pd.DataFrame(rows, columns=["head", "mir_lot", "mir_part", "mir_tester"])

    return heads.select("path", read("head").alias("_f")).select("path", "_f.*")


def sniff_files(spark: SparkSession, path: str, tester_map: DataFrame) -> DataFrame:
    """``sniff_metadata`` of all files below ``path``; only their first bytes are read."""
    return sniff_metadata(header_facts(file_heads(spark, path)), tester_map)


def archive_lot_folder(members: DataFrame, archive: str = "archive", path: str = "path") -> DataFrame:
    """Lot folder of each archive: its first top-level folder with a valid name, else one in the archive's own path."""
    top = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")[0]
    inside = F.min(F.when(text.combo_folder_valid(top) & (top != "__MACOSX"), top))
    found = members.groupBy(archive).agg(inside.alias("_inside"))
    return found.select(archive, F.coalesce("_inside", text.lot_folder(F.col(archive))).alias("lot_folder"))


def expand_archives(files: DataFrame, endings: Sequence[str] = DATA_ENDINGS) -> DataFrame:
    """(archive, path, content) of every data file, nested zips opened in the task that holds them."""
    wanted = tuple(endings)

    def leaves(name: str, data: bytes | memoryview) -> Iterator[tuple[str, bytes | memoryview]]:
        if name.lower().endswith(".zip") or data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for member in archive.namelist():
                    if not member.startswith("__MACOSX/") and not member.endswith((".DS_Store", "/")):
                        yield from leaves(member, archive.read(member))
        elif name.lower().endswith(wanted):
            yield name, data

    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            # One archive's bytes at a time are copied, and one member's are handed on at a time.
            for path, content in zip(frame.column("path"), frame.column("content"), strict=True):
                for member, data in leaves(path.as_py(), memoryview(content.as_buffer()).cast("B")):
                    yield pa.RecordBatch.from_pydict({"archive": [path.as_py()], "path": [member], "content": [data]}, schema=schema)

    return files.select("path", "content").mapInArrow(run, "archive string, path string, content binary")
