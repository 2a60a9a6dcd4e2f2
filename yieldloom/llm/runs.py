"""Periodic runs of words, found online along the diagonals of a sparse table of earlier occurrences."""

from __future__ import annotations

import hashlib
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from yieldloom.llm.common import by_batch

#: A run has at least so many words, and at least so many periods.
LEAST, EXPONENT = 6, 4
#: Lags are treated in classes from a power of this to the next.
STEP = 4
#: An odd multiplier and its inverse modulo 2^64, for digests of word windows.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


def numbered(words: list[bytes]) -> list[int]:
    """Each word's number by first appearance."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


class Lags:
    """A class of lags: diagonals of the lags ``low`` to ``high`` - 1 are followed once ``width`` words in a row match.

    ``width`` is the least number of matches that any run with such a lag has, so no run is lost, and a window of that
    many words returns within ``high`` words only in repetitive places.
    """

    def __init__(self, low: int, high: int, width: int, digests: list[int]):
        self.low, self.high, self.width, self.digests = low, high, width, digests
        self.seen: dict[int, dict[int, deque]] = {}  # window -> word before it -> places, oldest first

    def earlier(self, at: int, before: int):
        """Lags to earlier occurrences of the window that ends here, if the words before the windows differ: with equal

        words the diagonal was met one word ago. Remembers this occurrence.
        """
        places = self.seen.setdefault(self.digests[at], {})
        found = []
        for left, old in places.items():
            if left != before:
                while old and at - old[0] >= self.high:
                    old.popleft()
                found.extend(at - p for p in old if at - p >= self.low)
        places.setdefault(before, deque()).append(at)
        return found


def classes(codes: list[int], least: int, exponent: int) -> list[Lags]:
    """The classes of lags in which some window of words returns at all."""
    n, found, low = len(codes), [], 1
    if n < least:
        return found
    up, down = powers(MULTIPLIER, n), powers(INVERSE, n)
    scrambled = (np.asarray(codes, np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    scrambled ^= scrambled >> np.uint64(32)
    total = np.r_[np.uint64(0), np.cumsum(scrambled * up[:n], dtype=np.uint64)]
    while low * exponent <= n:
        high = low * STEP
        width = max(1, min(max(least, exponent * d) - d for d in range(low, min(high, low + least))))
        digests = (total[width:] - total[:-width]) * down[: n - width + 1]
        order = np.argsort(digests, kind="stable")
        if np.any((digests[order[1:]] == digests[order[:-1]]) & (np.diff(order) < high)):
            found.append(Lags(low, high, width, [0] * (width - 1) + digests.tolist()))
        low = high
    return found


def find_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with the smallest period q, of at least max(least, exponent * q) words (``exponent`` 2 or more),
    that no neighbouring word extends keeping q.

    Words are read once. A lag becomes active when the words up to here repeat an earlier occurrence; each further word
    that equals the word a lag ago lengthens it, and a diagonal that ends long enough is a run at that moment. A lag is not taken up when
    an active divisor reaches back as far: its whole stretch then has the smaller period. So texts of one repeated
    word, too, take time in proportion to their length.
    """
    codes = numbered(words)
    n, runs, active = len(codes), [], {}
    lags = classes(codes, least, exponent)
    if not lags:
        return runs
    for at, code in enumerate(codes):
        if active:
            for lag in [lag for lag in active if codes[at - lag] != code]:
                start = active.pop(lag)
                if at - start >= max(least, exponent * lag):
                    runs.append((start, at - start, lag))
        for group in lags:
            first = at - group.width + 1  # of the window that ends here
            if first < 0:
                break
            for lag in group.earlier(at, codes[first - 1] if first else -1):
                start = first - lag
                if start + max(least, exponent * lag) > n or lag in active:
                    continue
                if any(lag % q == 0 and s <= start for q, s in active.items()):
                    continue
                if codes[first : at + 1] == codes[start : at + 1 - lag]:  # equal digests are not yet equal words
                    active[lag] = start
    runs += [(start, n - start, lag) for lag, start in active.items() if n - start >= max(least, exponent * lag)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per run of each text: doc_id, start (word number from 0), length, period (in words).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and short texts have no runs. Rows that share a doc_id give their runs each;
    a null doc_id stays null. Extra columns are ignored, whole texts are read.
    """

    def work(ids, texts):
        rows = [(i, *run) for i, t in zip(ids, texts) for run in find_runs((t or "").encode().split(), least, exponent)]
        return [list(c) for c in zip(*rows)] if rows else [[]] * 4

    return by_batch(docs.select("doc_id", text), "doc_id long, start long, length long, period long", lambda: work)


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id and the text with one period left of each run, words joined by one space; null texts become empty."""

    def work(ids, texts):
        words = [(t or "").encode().split() for t in texts]
        return [ids, [b" ".join(collapsed(w, find_runs(w, least, exponent))).decode() for w in words]]

    return by_batch(docs.select("doc_id", text), "doc_id long, text string", lambda: work)


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their id, repeat a stretch of their own words to the end."""
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if checksum % 10 or not words:
        return words
    n, g = len(words), checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def report(doc_id: int | None, text: str | None) -> tuple:
    words = with_planted_run(doc_id, (text or "").encode().split())
    runs = find_runs(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(collapsed(words, runs))
    exponent = 1000 * length // period if runs else None
    return doc_id, len(runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def run_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period, exponent_milli of the longest run, digests of all runs and of the

    collapsed text, after a run was planted in a tenth of the documents. A null text has no words; a null doc_id gets
    no planted run. Repeated rows give repeated rows, extra columns are ignored.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def work(ids, texts):
        return [list(c) for c in zip(*map(report, ids, texts))] if ids else [[]] * 8

    return by_batch(docs.select("doc_id", text), schema, lambda: work)
