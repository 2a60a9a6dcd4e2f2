"""Alignment of tokenizers against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from yieldloom.llm import alignment, queries
from yieldloom.llm.common import PIECES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.BYTES_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def known():
    return alignment.Tokenizers()


def byte_table():
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    table, free = {}, 256
    for b in range(256):
        if b in plain:
            table[chr(b)] = b
        else:
            table[chr(free)] = b
            free += 1
    return table


def tokens(text, libraries):
    """(ids, ends) of both, by the libraries' own tokens; None where they don't give the text back."""
    if not text:
        return None
    a, b = libraries
    table = byte_table()
    found = a.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(table[c] for c in t) for t in found.tokens]
    ids = b.encode(text)
    b_bytes = []
    for piece in (b.id_to_piece(i) for i in ids):
        b_bytes.append(bytes([int(piece[1:-1], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode())
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    return (found.ids, a_bytes), (ids, b_bytes)


def brute(rows, libraries):
    """The whole contract by walking over single bytes' offsets."""
    walked, count = [], Counter()
    for _, text in rows:
        both = tokens(text, libraries)
        links, groups = [], []
        if both:
            offsets = []
            for ids, parts in both:
                end, found = 0, {}
                for i, p in zip(ids, parts):
                    end += len(p)
                    found[end] = i
                offsets.append(found)
            cut = sorted(offsets[0].keys() & offsets[1].keys())
            links = [(offsets[0][e], offsets[1][e]) for e in cut]
            at, listed = [0, 0], [sorted(f) for f in offsets]
            for e in cut:
                sides = []
                for k, f in enumerate(offsets):
                    start = at[k]
                    while listed[k][at[k]] != e:
                        at[k] += 1
                    at[k] += 1
                    sides.append(",".join(str(f[x]) for x in listed[k][start : at[k]]))
                groups.append("|".join(sides))
        count.update(links)
        walked.append((both, links, groups))
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for (doc_id, _), (both, links, groups) in zip(rows, walked):
        sizes = [len(x[0]) for x in both] if both else [0, 0]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, *sizes, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)), st.integers(2, 30))
def test_merge_path(a, b, size):
    """Pieces are a partition of both lists, of equal work but for one end, in order of the merge; shared ends stay together."""
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    cuts = alignment.merge_path(a, b, size)
    assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
    for (i, j), (p, q) in zip(cuts, cuts[1:]):
        assert i <= p and j <= q and (p - i) + (q - j) <= size + 1
        assert not (set(a[i:p]) & set(b[:j])) and not (set(a[i:p]) & set(b[q:]))
        if len(a[:p]) and len(b[q:]):
            assert a[p - 1] < b[q]
        if len(b[:q]) and len(a[p:]):
            assert b[q - 1] < a[p]
    assert len(cuts) - 1 == max(1, -(-(len(a) + len(b)) // size))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["", "<s> </s><unk>", "<|endoftext|>", "<0x41>", "▁", "naïve 東京 😀́", "\n\n\t x  "]))
def test_ids(libraries, known, text, odd):
    """Ids are those of the libraries, on any text."""
    given_ = text + odd + text[::-1]
    want = tokens(given_, libraries)
    got = known.encode([given_])[0]
    assert (got is None) == (want is None)
    if want:
        assert got[0].tolist() == want[0][0] and got[1].tolist() == want[1][0]


@pytest.mark.parametrize(("size", "room"), [(alignment.PIECE, alignment.BROADCAST_PAIRS), (7, 40), (2, 0)])
def test_documents(spark, libraries, size, room):
    """Pieces of any size and any number of broadcast pairs give the same rows."""
    rng = random.Random(size)
    vocabulary = ["alpha", "Beta,", "naïve", "東京", "😀", "x1y2", "\n", "  ", "Straße", "<s>", "aaaa" * 9]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "a▁b"), (54, "same"), (54, "same"), (None, "no id"), (55, "<|endoftext|>"), (56, "\x00\x01é")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, n_a long")
    got = alignment.align_tokens(docs.repartition(3), size=size, room=room)
    assert ordered(got.collect()) == ordered(brute(rows, libraries))


def test_empty_and_long(spark, libraries):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(docs).collect() == []
    rows = [(1, "word " * 30_000 + "é" * 5_000 + " " * 3_000), (2, "z" * 40_000)]
    assert ordered(alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == ordered(brute(rows, libraries))


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_merge_path"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(brute(rows, libraries))
