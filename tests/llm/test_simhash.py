"""SimHash groups against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from yieldloom.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(f.encode(), seed=42).intdigest() for f in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Least id reachable for (id, print) rows, by all pairs."""
    distinct = sorted({p for _, p in prints})
    near = {p: [q for q in distinct if (p ^ q).bit_count() <= 2] for p in distinct}
    ids, comp = {}, {}
    for i, p in prints:
        ids[p] = min(i, ids.get(p, i))
    for p in distinct:
        if p not in comp:
            seen, todo = {p}, [p]
            while todo:
                for q in near[todo.pop()]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            least = min(ids[q] for q in seen)
            comp |= dict.fromkeys(seen, least)
    return {i: comp[p] for i, p in prints}


def flipped(rng, p, times):
    for b in rng.sample(range(64), times):
        p ^= 1 << b
    return p


@pytest.mark.parametrize("blocks", simhash.DIVISIONS)
def test_pivots(blocks):
    """No pair within two bits is discarded or misses all common buckets; families tell their blocks apart."""
    rng = random.Random(blocks)
    pivots = simhash.Pivots(blocks)
    assert len(set(pivots.references.tolist())) == 65
    for _ in range(300):
        p = rng.getrandbits(64)
        pair = np.array([p, flipped(rng, p, rng.randrange(3))], np.uint64)
        table = pivots.table(pair)
        assert np.abs(table[0] - table[1]).max() <= 2
        assert (pivots.keys(table)[0] == pivots.keys(table)[1]).any()
    size = 64 // blocks
    if size <= 8:
        block = np.arange(1 << size, dtype=np.uint64)
        table = pivots.table(block)
        assert len(np.unique(table[:, 1 : size + 1] - table[:, :1], axis=0)) == 1 << size


@pytest.mark.parametrize("crowded", [2, 256])
def test_links(spark, monkeypatch, crowded):
    """Chains, balls and strangers; crowded buckets go on to finer divisions without loss."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    prints |= {flipped(rng, centre, 3) for _ in range(400)} | {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(20), 2)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain = flipped(rng, chain, 2)
        prints.add(chain)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "print long"))
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in found)
    want = brute_groups([(p, p) for p in prints])
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert {p: top(p) for p in prints} == want


def test_linear_rows(spark):
    """One group of many near fingerprints gives links in proportion to its size."""
    rng = random.Random(7)
    centre = rng.getrandbits(63)
    prints = list({flipped(rng, centre, 4) for _ in range(4000)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    assert simhash.fingerprint_links(spark.createDataFrame(signed, "print long")).count() < 20 * len(prints)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    comps = brute_groups(prints)
    got = queries.QUERIES["op12_simhash"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", comps[i]) for i, p in prints)
    assert len(set(comps.values())) < len(comps)


def test_odd_rows(spark):
    long_text = " ".join(f"w{k % 7001}" for k in range(120_000))
    texts = [None, "", " \n", "One", "one", "A b", "a b c", "a b c d", "É x y z", "a b c d", long_text, long_text + " end"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b c d", "x"), (3, "one", "x"), (3, "other words here now", "x"), (20, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = simhash.simhash_groups(docs).collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows if i is not None]
    by_print = {p: c for p, c in ((p, brute_groups([(k, q) for k, (_, q) in enumerate(prints)])[n]) for n, (_, p) in enumerate(prints))}
    want = [(i, f"{p:016x}", None) for i, p in [(None, brute_print("a b c d"))]]
    want += [(i, f"{p:016x}", min(j for j, q in prints if by_print[q] == by_print[p])) for i, p in prints]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
