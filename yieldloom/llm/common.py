"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.session import pin, shared_folder

__all__ = ["PIECES", "WORD_BPE", "by_batch", "fold_of", "freed", "measured_join", "once", "pin", "read", "settings", "shared_folder"]

#: Folder with the public tokenizers' files; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("YIELDLOOM_TOKENIZERS", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"

#: Rows and bytes of text handed to an operator at a time: long texts stay few in memory. A longer row goes alone.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 512, 1 << 20
#: A side of at most so many rows is broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Otherwise both sides are dealt by key and salt, so a key with a third of all rows is spread over so many tasks.
SALTS = 32

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def lots(batch: pa.RecordBatch, rows: int | None = None, room: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows (or ROWS_AT_A_TIME) and about ``room`` bytes (or BYTES_AT_A_TIME)."""
    rows, room = rows or ROWS_AT_A_TIME, room or BYTES_AT_A_TIME
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = int(np.searchsorted(upto, before + room, side="right"))
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """Applies a function of whole columns in each task. ``make`` runs once per task and returns the function,

    which takes one list per column of ``df`` and returns one list per column of ``schema`` (of any common length).
    """
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with only_used():
            work = make()
        for batch in batches:
            for lot in lots(batch):
                columns = [c.to_pylist() for c in lot.columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(work(*columns), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def memory() -> types.ModuleType:
    """Objects that this process keeps from task to task (``entries``), and the keys asked for lately (``asked``)."""
    if "yieldloom_worker_memory" not in sys.modules:
        sys.modules["yieldloom_worker_memory"] = types.ModuleType("yieldloom_worker_memory")
        sys.modules["yieldloom_worker_memory"].__dict__.update(entries={}, asked=set())
    return sys.modules["yieldloom_worker_memory"]


def once(key, make: Callable):
    """An object made once per process: workers outlive tasks, while a task's functions are unpickled anew each time."""
    kept = memory()
    kept.asked.add(key)
    if key not in kept.entries:
        kept.entries[key] = make()
    return kept.entries[key]


@contextmanager
def only_used():
    """Forgets what is not asked for inside: an operator's tables don't stay in a worker that has gone on to another one."""
    kept = memory()
    kept.asked.clear()
    hand_back()
    yield
    forgotten = kept.entries.keys() - kept.asked
    for key in forgotten:
        del kept.entries[key]
    if forgotten:
        hand_back()


def hand_back() -> None:
    """Gives memory that this process has freed, but still holds, back to the system: an earlier stage's arrays are gone by now."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Plans made inside have these settings; what was set before is set again."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def freed(spark: SparkSession):
    """Plans made and run to their end inside leave no shuffle files: what they wrote or pinned replaces them."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def measured_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins rows with one fact row per key: broadcast where the facts were counted to be few, salted otherwise."""
    if facts.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(facts), key, how)
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")

