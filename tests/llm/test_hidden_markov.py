"""The hidden Markov model's blocks, rounds and recursion against plain versions."""

import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from yieldloom.llm import hmm


def test_hidden_markov_keeps_a_word_once(spark, monkeypatch):
    """Between rounds the disk has one row of shares per trained word, and no rows of earlier rounds while a round is counted."""
    paths, before = [], []

    def path(*args):
        paths.append(shared_path(*args))
        return paths[-1]

    def step(coded, *args):
        before.append([spark.read.parquet(p).count() if Path(p.removeprefix("file:")).exists() else 0 for p in paths])
        return by_block(coded, *args)

    shared_path, by_block = hmm.scratch_path, hmm.by_block
    monkeypatch.setattr(hmm, "scratch_path", path)
    monkeypatch.setattr(hmm, "by_block", step)
    rows = [(d, " ".join(f"w{(d * 7 + k) % 40}" for k in range(60)) + f" only{d}") for d in range(40)]
    assert hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == 40
    words = {w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in t.split()} | {""}
    kept = spark.read.parquet(paths[1]).agg(F.sum(F.length("shares"))).first()[0]
    assert kept == len(words) * hmm.WIDTH * (hmm.STATES - 1)
    assert len(before) == hmm.ROUNDS + 1 and all(min(x) == 0 < max(x) for x in before[: hmm.ROUNDS])


def test_hidden_markov_scaled_at_intervals():
    """Counts and likelihoods of texts that end before, at and after a scaling are those of a recursion over single states."""
    rng = np.random.default_rng(8)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T)
    texts = [rng.integers(0, 4, n) for n in (1, 7, 8, 9, 16, 17, 30, 30)]
    for some, table, sizes in hmm.groups(texts):
        like, got = m.log_likelihood(table, sizes), m.expected(table, sizes)
        want = [np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))]
        for lane, k in enumerate(some):
            t = texts[k]
            a, b = [m.start * m.emit[t[0]]], [np.ones(3)]
            for x in t[1:]:
                a.append((a[-1] @ m.step) * m.emit[x])
            for x in t[:0:-1]:
                b.insert(0, m.step @ (m.emit[x] * b[0]))
            whole = a[-1].sum()
            assert math.isclose(like[lane], math.log(whole))
            want[0] += a[0] * b[0] / whole
            for x in range(len(t)):
                want[2][t[x]] += a[x] * b[x] / whole
                if x:
                    want[1] += np.outer(a[x - 1], m.emit[t[x]] * b[x]) * m.step / whole
        assert all(np.allclose(x, y, rtol=1e-10) for x, y in zip(got, want)) and math.isclose(got[3], like.sum())


def test_hidden_markov_lots_of_texts(monkeypatch):
    """Texts added together have the words of texts added one by one, and a block ends with the text that fills it."""
    texts = ["  a  B ", "", " \t\n\x0b\x0c\r", None, "\x1ca\x0bb\x85c É é", "x\x00y  z A b", "ABC", "word " * 30, "one more"]
    alone, together = hmm.Block(), hmm.Block()
    for k, x in enumerate(texts):
        alone.add(k, k == 2, x)
    flags = [k == 2 for k in range(len(texts))]
    assert together.extend(pa.array(range(len(texts))), pa.array(flags), pa.array(texts)) == len(texts)
    want = [[*(x or "").encode().lower().split(), b""] for x in texts]
    for b in (alone, together):
        names = list(b.number)
        assert [names[k] for k in np.concatenate(b.parts)] == [w for ws in want for w in ws] and b.sizes == [len(ws) for ws in want]
        assert b.docs == list(range(len(texts))) and b.held == flags and b.tokens == sum(b.sizes)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 5)
    block = hmm.Block()
    assert block.extend(pa.array(range(len(texts))), pa.array(flags), pa.array(texts)) == 3 and block.sizes == [3, 1, 1]


def test_hidden_markov_packed_numbers():
    for x in (np.zeros(0, np.int64), np.array([-1, 1 << 40, 7]), np.arange(999, dtype=np.uint32) << 20, np.array([0, 1], np.uint8)):
        got = hmm.unpacked(hmm.packed_array(x), x.dtype)
        assert got.dtype == x.dtype and np.array_equal(got, x)
    steps = np.array([0, 5, 9, 0, 3, -1, -1, 1 << 20])
    assert np.array_equal(hmm.from_steps(hmm.steps_of(steps)), steps) and hmm.restored(hmm.squeezed(b"")) == b""
