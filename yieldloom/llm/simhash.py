"""SimHash near duplicates found through a table of distances to reference fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import by_batch, measured_join, pin
from yieldloom.llm.components import connected

BITS = 64
#: Words of a shingle, seed of its digest, most bits by which linked fingerprints differ.
WIDTH, SEED, MOST = 3, 42, 2
#: References come in families, one for each block of bits. Fingerprints in a crowded bucket go on to the next, finer
#: division; a bucket of the last one leaves 64 / 16 * MOST bits open, so it holds 256 fingerprints at most.
DIVISIONS = (4, 8, 16)
#: Fingerprints compared within one bucket.
CROWDED = 256
#: Digests whose bits are counted at a time, rows that a comparing task holds at least, pairs that it compares at a time.
DIGESTS_AT_A_TIME, ROWS_AT_A_TIME, PAIRS_AT_A_TIME = 1 << 15, 1 << 16, 1 << 13


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def digests(text: str | None, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle, repeats included; with fewer words, of the whole sequence; none without words."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Bits that are set in over half of the text's digests, as a signed 64-bit number; 0 without words."""
    found = digests(text, width, seed)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(found), DIGESTS_AT_A_TIME):
        part = np.array(found[at : at + DIGESTS_AT_A_TIME], ">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(found)).tobytes(), "big", signed=True)


class Pivots:
    """Reference fingerprints for a division of the bits into blocks, and the table of distances to them.

    The first reference is the base; each of a block's family differs from the base inside the block only. Reference k
    of a family differs in bit k, in some earlier bits by a scramble and in no later one. So a coordinate less the base's depends on nothing
    but the fingerprint's bits in the block, and a family's coordinates together tell those bits apart.
    """

    def __init__(self, blocks: int, seed: int = SEED):
        self.blocks, size = blocks, BITS // blocks
        base, *random = mixed(np.arange(BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        masks = []
        for bit in range(BITS):
            low = bit - bit % size
            earlier = int(random[bit]) & ((1 << bit) - (1 << low))
            masks.append((1 << bit) | earlier)
        self.references = np.r_[base, base ^ np.array(masks, np.uint64)]
        weights = mixed(np.arange(1, BITS + 1, dtype=np.uint64)) | np.uint64(1)
        self.weights = weights.reshape(blocks, size)
        #: Fingerprints that differ in MOST bits agree on all blocks but MOST, whichever these are.
        self.kept = list(combinations(range(blocks), blocks - MOST))

    def table(self, prints: np.ndarray) -> np.ndarray:
        """Hamming distances to all references, a row for each fingerprint."""
        return np.bitwise_count(prints[:, None] ^ self.references[None, :]).astype(np.int8)

    def keys(self, table: np.ndarray) -> np.ndarray:
        """A bucket for each choice of blocks, from the coordinates (less the base's) of their families."""
        relative = (table[:, 1:] - table[:, :1]).astype(np.int64).view(np.uint64).reshape(len(table), self.blocks, -1)
        codes = mixed((relative * self.weights[None]).sum(axis=2, dtype=np.uint64) + np.arange(self.blocks, dtype=np.uint64))
        return np.stack([mixed(codes[:, list(k)].sum(axis=1, dtype=np.uint64) + np.uint64(n)) for n, k in enumerate(self.kept)], axis=1).view(np.int64)


def buckets(prints: DataFrame, blocks: int) -> DataFrame:
    """key, print: each fingerprint in the buckets of all its choices of blocks."""

    def make():
        pivots = Pivots(blocks)

        def work(values):
            if not values:
                return [[], []]
            found = np.array(values, np.int64)
            keys = pivots.keys(pivots.table(found.view(np.uint64)))
            return [keys.ravel(), np.repeat(found, keys.shape[1])]

        return work

    return by_batch(prints.select("print"), "key long, print long", make)


def forest(size: int, pairs) -> list[tuple[int, int]]:
    """Of the links, given step by step as two arrays, those that join what earlier ones left apart."""
    label, kept = np.arange(size), []
    for left, right in pairs:
        apart = label[left] != label[right]
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            x, y = int(label[a]), int(label[b])
            if x != y:
                label[label == max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def compared(pivots: Pivots, key: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Links within whole buckets (rows in order of key): one spanning forest of all of them, as pairs of fingerprints.

    Pairs whose coordinates differ by more than MOST at some reference are discarded: a distance is at least the
    difference of two distances to a third point. The survivors' own distance is then counted.
    """
    unsigned = prints.view(np.uint64)
    alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
    rows = np.flatnonzero(~alone)
    if not len(rows):
        return []
    key, unsigned = key[rows], unsigned[rows]
    distinct, number = np.unique(unsigned, return_inverse=True)
    table = pivots.table(distinct)

    def steps():
        for step in range(1, len(key)):
            i = np.flatnonzero(key[step:] == key[:-step])
            if not len(i):
                return
            for at in range(0, len(i), PAIRS_AT_A_TIME):
                a = i[at : at + PAIRS_AT_A_TIME]
                near = np.abs(table[number[a]] - table[number[a + step]]).max(axis=1) <= MOST
                a = a[near]
                a = a[np.bitwise_count(unsigned[a] ^ unsigned[a + step]) <= MOST]
                yield number[a], number[a + step]

    signed = distinct.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in forest(len(distinct), steps())]


def bucket_links(rows: DataFrame, blocks: int) -> DataFrame:
    """a, b: spanning forests of the links inside the buckets; a task reads its rows in order of key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        pivots = Pivots(blocks)
        held_key, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(key, prints):
            found = compared(pivots, key, prints)
            return pa.RecordBatch.from_arrays([pa.array([link[k] for link in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            held_key = np.r_[held_key, batch.column(0).to_numpy(zero_copy_only=False)]
            held = np.r_[held, batch.column(1).to_numpy(zero_copy_only=False)]
            if len(held) >= ROWS_AT_A_TIME:
                last = int(np.searchsorted(held_key, held_key[-1]))  # its bucket may go on in the next batch
                if last:
                    yield links(held_key[:last], held[:last])
                    held_key, held = held_key[last:], held[last:]
        if len(held):
            yield links(held_key, held)

    return rows.repartition("key").sortWithinPartitions("key", "print").select("key", "print").mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print) that span the components of all pairs that differ in MOST bits.

    Buckets are counted before they meet anywhere. One with over CROWDED fingerprints is never gathered: its members go
    on to the next division, whose buckets fix more bits, all of them; so nothing is capped.
    """
    links = None
    for blocks in DIVISIONS:
        rows = buckets(prints, blocks)
        crowded = None
        if blocks != DIVISIONS[-1]:
            crowded = pin(rows.groupBy("key").count().filter(F.col("count") > CROWDED).select("key", F.lit(True).alias("crowded")))
            marked = measured_join(rows, crowded, "key")
            rows, prints = marked.filter("crowded is null"), pin(marked.filter("crowded").select("print").distinct())
        found = pin(bucket_links(rows, blocks))
        links = found if links is None else links.unionByName(found)
        if crowded is None or prints.isEmpty():
            break
    return links


def simhash_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id its links reach).

    Documents link when their fingerprints differ in at most two bits. Texts without words, null ones too, have the
    fingerprint zero, which links like any other. Rows without a doc_id have a fingerprint, link with nothing and have no component.
    Repeated rows give repeated rows; extra columns are ignored; whole texts are read.

    Equal fingerprints are one class, found with map-side combine. Distances to the references make the buckets in
    which classes meet, discard pairs, and survivors are verified; components follow by alternating stars.
    """

    def work(ids, texts):
        return [ids, [fingerprint(t) for t in texts]]

    marked = pin(by_batch(docs.select("doc_id", text), "doc_id long, print long", lambda: work))
    classes = pin(marked.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first_id")))
    comps = connected(fingerprint_links(classes))
    named = classes.join(comps.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component"))
    known = named.join(firsts, "root").select("print", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return marked.join(known, "print", "left").select("doc_id", digits.alias("fingerprint"), own.alias("component_id"))
