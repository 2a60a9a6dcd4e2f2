"""Fingerprints, lane policy, stored evidence and feature caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What each data lane may be used for.
LANES = {
    "real_open_source": ("data_quality", "feature_engineering", "regression", "classification", "explainability", "grouped_validation"),
    "cmp_virtual_metrology": ("data_quality", "feature_engineering", "regression", "explainability", "grouped_validation", "prospective_campaign_validation"),
    "bosch_plasma_etch": ("data_quality", "feature_engineering", "regression", "classification", "explainability", "grouped_validation", "spatial_virtual_metrology"),
    "local_demonstration": ("stdf_parsing", "historical_baseline", "spc", "psi", "cpk", "gdbn", "alerts", "dashboard"),
    "real_stdf_sample": ("stdf_parsing", "feature_extraction", "gdbn"),
}


class LaneViolation(ValueError):
    """A function is requested from a lane that cannot support it."""


def source_fingerprint(files: DataFrame) -> DataFrame:
    """(path, name, sha256) of (path, content) rows."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def dataset_version(fingerprints: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """First sixteen hex digits of the hash over the sorted ``name:digest`` list, per key.

    The list is sorted by Spark and streamed through the hash, so a list of any length is read in constant memory, but by one
    task a key; ``tree_version`` hashes a long list in parallel.
    """
    keys = list(keys)
    entries = fingerprints.select(*keys, F.concat_ws(":", "name", "digest").alias("_entry"))
    dealt = entries.repartition(*keys) if keys else entries.repartition(1)
    ordered = dealt.sortWithinPartitions(*keys, "_entry")
    schema = ", ".join([*(f"`{k}` {fingerprints.schema[k].dataType.simpleString()}" for k in keys), "files long", "version string"])

    def stream(batches):
        at, digest, files = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([*at, pa.array([files]), pa.array([digest.hexdigest()[:16]])], names=[*keys, "files", "version"])

        for batch in batches:
            for k, entry in enumerate(batch.column(len(keys)).to_pylist()):
                own = [batch.column(c).slice(k, 1) for c in range(len(keys))]
                if digest is None or own != at:
                    if digest is not None:
                        yield done()
                    at, digest, files = own, hashlib.sha256(), 0
                digest.update((b"|" if files else b"") + entry.encode())
                files += 1
        if digest is not None:
            yield done()

    return ordered.mapInArrow(stream, schema)


def tree_version(fingerprints: DataFrame, keys: Iterable[str] = (), levels: int = 2) -> DataFrame:
    """First sixteen hex digits of the root of a digest tree over ``name:digest`` entries, and the number of files, per key.

    An entry is the sha256 of ``name:digest`` with the number of its rows. Entries whose hash begins with the same
    ``2 * levels`` digits are a leaf: the sha256 of them in order, joined by ``|``. A level up, up to 256 digests are
    hashed in order in the same way, until one is left. Leaves are cut by content, so the version depends neither on
    partitions nor on row order, and no task holds more than a leaf, however many files a key has.
    """
    keys = list(keys)
    entry = F.sha2(F.concat_ws(":", "name", "digest"), 256)
    nodes = fingerprints.select(*keys, entry.alias("_at")).groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("files"))
    nodes = nodes.withColumn("_digest", F.concat_ws(":", "_at", F.col("files").cast("string")))
    for digits in range(2 * levels, -1, -2):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_digest"))), lambda x: x["_digest"])
        parents = nodes.groupBy(*keys, F.substring("_at", 1, digits).alias("_parent"))
        nodes = parents.agg(F.sha2(F.concat_ws("|", ordered), 256).alias("_digest"), F.sum("files").alias("files")).withColumnRenamed("_parent", "_at")
    return nodes.select(*keys, "files", F.substring("_digest", 1, 16).alias("version"))


def assert_functions_allowed(lane: str, functions: Iterable[str]) -> None:
    if lane not in LANES:
        raise KeyError(f"unknown lane {lane!r}")
    refused = sorted(set(functions) - set(LANES[lane]))
    if refused:
        raise LaneViolation(f"{lane} cannot support: {', '.join(refused)}")


def provenance_record(spark: SparkSession, lane: str, dataset: str, sources: Iterable[str], functions: Iterable[str], version: str) -> DataFrame:
    """One-row record of a dataset version, refused when the lane does not allow a function."""
    wanted = list(dict.fromkeys(functions))
    assert_functions_allowed(lane, wanted)
    row = (dataset, version, list(sources), wanted, lane == "local_demonstration", (lane, list(LANES[lane])))
    schema = "dataset string, version string, sources array<string>, functions array<string>, is_synthetic boolean, lane struct<key:string, allowed:array<string>>"
    return spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp())


def write_evidence(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").format(form).option("header", "true").save(f"{folder.rstrip('/')}/{name}")


def read_evidence(spark: SparkSession, folder: str, names: Iterable[str], form: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(form).option("header", "true").load(f"{folder.rstrip('/')}/{n}") for n in names}


def export_decoded_samples(samples: DataFrame, path: str, form: str = "csv") -> None:
    """Decoded samples as files written in parallel."""
    samples.write.mode("overwrite").format(form).option("header", "true").save(path)


def feature_cache(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False, version: str = "") -> DataFrame:
    """Features stored for this version of their inputs (see ``dataset_version``), else built, written and read back."""
    place = f"{path.rstrip('/')}/version={version}" if version else path
    if not refresh:
        try:
            return spark.read.parquet(place)
        except AnalysisException as absent:
            if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
