"""Periodic runs against a brute-force search."""

import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import queries, runs

FOLDER = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words, least=6, exponent=4):
    """Every maximal stretch of every period whose smallest period it is."""
    found, n = [], len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None,) * 3
    text_of = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (text_of, kept)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=90))
def test_two_words(words):
    assert runs.find_runs(words) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), st.integers(1, 14), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8), st.integers(1, 6))
def test_repeats_of_repeats(block, times, rest, again):
    words = (block * times + rest) * again + block * 3
    assert runs.find_runs(words) == brute(words)
    assert runs.find_runs(words, 4, 2) == brute(words, 4, 2)


@pytest.mark.parametrize("seed", range(12))
def test_planted(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"x", b"y", b"z", b"%d" % rng.randrange(40)]) for _ in range(rng.randrange(300, 700))]
    for _ in range(4):
        at, q = rng.randrange(len(words)), rng.randrange(1, 60)
        words[at:at] = words[at : at + q] * rng.randrange(2, 7)
    assert runs.find_runs(words) == brute(words)


def test_near_linear():
    """Runs of one word, of nested periods and of a long period take no quadratic time."""
    for words in ([b"a"] * 300_000, ([b"a"] * 7 + [b"b"]) * 30_000, [b"%d" % (k % 20_011) for k in range(200_000)], [b"ab"[k.bit_count() & 1 :][:1] for k in range(100_000)]):
        start = time.monotonic()
        found = runs.find_runs(words)
        assert time.monotonic() - start < 20
        assert all(words[s : s + m - q] == words[s + q : s + m] for s, m, q in found)
    assert runs.find_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert runs.find_runs([b"%d" % (k % 20_011) for k in range(200_000)]) == [(0, 200_000, 20_011)]


def test_collapse(spark):
    rows = [(1, "so so so so so so it goes", "x"), (2, None, "x"), (None, "a b a b a b a b", "x"), (2, "", "x"), (1, "so so so so so so it goes", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    assert sorted(r.text for r in runs.collapse_runs(docs).collect()) == ["", "", "a b", "so it goes", "so it goes"]
    found = sorted((r.doc_id or 0, r.start, r.length, r.period) for r in runs.periodic_runs(docs).collect())
    assert found == [(0, 0, 8, 2), (1, 0, 6, 1), (1, 0, 6, 1)]
    assert runs.run_report(docs.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_report(d.doc_id, d.text) for d in docs)
    got = queries.QUERIES["op13_periodic_runs"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[1] for r in want) > 5


def test_odd_rows(spark):
    long_text = "w " * 50_000 + "end"
    rows = [(k, t) for k in (0, 5, 19, 23, None) for t in (None, "", " \t\n", "one", "a b " * 9, "é é " * 9)] + [(77, long_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = runs.run_report(docs).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r) for r in got if r.doc_id != 77), key=key) == sorted((brute_report(*r) for r in rows[:-1]), key=key)
    assert next(r for r in got if r.doc_id == 77)["n_runs"] == 1
