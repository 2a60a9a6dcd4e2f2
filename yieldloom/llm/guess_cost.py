"""Secret scans: fixed patterns, and guess costs of values in a credential context."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log10

from pyspark.sql import DataFrame

from yieldloom.llm.common import WORD_BPE, by_batch, once

# Fixed values of the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "guess")

#: Names before a value that make it a credential; the value may hold any visible sign but quotes.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:(?ai:bearer|basic)\x20+)?["'`]?([^\s"'`<>]+)"""
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: A value is a secret from so many guesses (log10) and so many characters on.
LEAST_GUESSES, LEAST_VALUE = 8.0, 6
#: Words from so many characters on come from the vocabulary; its order stands for frequency. Runs have at least so many, too.
SHORTEST_WORD = SHORTEST_RUN = 3
#: log10 of the guesses of a repeat and of a walk, to which that of its length is added.
REPEAT, WALK = 2.0, 2.5
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
CLASSES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[!-/:-@\\[-`{-~]"), 33), (re.compile("[^!-~]"), 100))
YEARS, DAYS = 120, 372
DATE = re.compile(r"(?a:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)")
YEAR = re.compile(r"(?a:(?:19|20)\d\d)")


def neighbours() -> set[tuple[str, str]]:
    """Keys beside each other in a row, and those above and below, in both directions."""
    across = {(r[k], r[k + 1]) for r in ROWS for k in range(len(r) - 1)}
    down = {(a[k + d], b[k]) for a, b in zip(ROWS, ROWS[1:]) for k in range(len(b)) for d in (1, 2) if k + d < len(a)}
    return {p for a, b in across | down for p in ((a, b), (b, a))}


class GuessCost:
    """Least number of guesses (log10) over all segmentations of a value.

    Segments are vocabulary words (rank times the variants of their case), dates, repeats of one character, keyboard
    walks, and single characters guessed by brute force among the value's character classes. Costs of segments add up.
    Repeats and walks may begin and end anywhere in a run.
    """

    def __init__(self, words: str = WORD_BPE):
        import json

        with open(words, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        whole = (t[:-4] for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>"))
        self.rank = {w: k for k, w in enumerate((w for w in whole if len(w) >= SHORTEST_WORD and w.isascii() and w.isalpha()), 1)}
        self.longest = max(map(len, self.rank), default=0)
        self.keys = neighbours()

    def segments(self, value: str, low: str):
        """(start, end, cost) of every word and date."""
        n = len(value)
        for i in range(n):
            for j in range(i + SHORTEST_WORD, min(n, i + self.longest) + 1):
                if (rank := self.rank.get(low[i:j])) is not None:
                    word = value[i:j]
                    case = 0.0 if word == low[i:j] else log10(2) if word.isupper() or word.istitle() else (j - i) * log10(2)
                    yield i, j, log10(rank + 1) + case
            for date, guesses in ((DATE, YEARS * DAYS * 8), (YEAR, YEARS)):
                if m := date.match(value, i):
                    yield i, m.end(), log10(guesses)

    def cost(self, value: str) -> float:
        """log10 of the guesses; 0 for an empty value.

        The state of the program is the place and, for each kind of run, the starts inside the open run that can still
        be the best ones: a later start is kept only if it is cheaper than going on from an earlier one. Such starts
        are few, so time is linear in the value's length.
        """
        low = value.lower() if len(value.lower()) == len(value) else value
        each = log10(sum(size for sort, size in CLASSES if sort.search(value)) or 1)
        ending: dict[int, list[tuple[int, float]]] = {}
        for i, j, c in self.segments(value, low):
            ending.setdefault(j, []).append((i, c))
        best = [0.0]
        kinds = ((REPEAT, lambda a, b: a == b), (WALK, lambda a, b: (a, b) in self.keys))
        open_: list[list[int]] = [[0], [0]]
        for j in range(1, len(value) + 1):
            ways = [best[j - 1] + each, *(best[i] + c for i, c in ending.get(j, ()))]
            for kind, (single, joined) in enumerate(kinds):
                if j > 1 and not joined(low[j - 2], low[j - 1]):
                    open_[kind] = [j - 1]  # the run begins with the character before this place
                ways += [best[i] + single + log10(j - i) for i in open_[kind] if j - i >= SHORTEST_RUN]
            best.append(min(ways))
            for starts in open_:
                # From here on an earlier start costs most more than this one at the first place where this one may end.
                if all(best[j] < best[i] + log10((j + SHORTEST_RUN - i) / SHORTEST_RUN) for i in starts):
                    starts.append(j)
        return best[-1]


def guesser(words: str = WORD_BPE) -> GuessCost:
    return once(("guesses", words), lambda: GuessCost(words))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed. A match that is too short is dropped whole."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    marks = text.encode("ascii", "replace").translate(HEX_MARKS)
    if LONG_HEX in marks:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


HEX_MARKS = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
LONG_HEX = b"h" * LEAST_HEX


def guess_spans(text: str, guesses: GuessCost, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Values in a credential context that cost many guesses and don't lie inside a base span."""
    low = text.lower()
    if not any(w in low for w in HINTS):
        return []
    starts, furthest, out = [], [], []
    for start, end, _ in base:
        starts.append(start)
        furthest.append(max(end, furthest[-1]) if furthest else end)
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        start, end = m.start(1), m.start(1) + len(value)
        k = bisect_right(starts, start)
        if len(value) >= LEAST_VALUE and not (k and furthest[k - 1] >= end) and guesses.cost(value) >= LEAST_GUESSES:
            out.append((start, end, "guess"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan_secrets(docs: DataFrame, text: str = "text", words: str = WORD_BPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Spans are kind:start:end in code points. Base spans are those of the three fixed patterns and always stay; a value
    in a credential context is added where its guess cost is high and no base span covers it. A null or empty text has
    no spans. Each row stands alone: repeated rows give repeated rows, other columns are ignored, whole texts are read.
    """

    def make():
        guesses = guesser(words)

        def one(t):
            base = base_spans(t) if t else []
            more = guess_spans(t, guesses, base) if t else []
            kinds = [s[2] for s in base]
            return *(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])

        return lambda ids, texts: [ids, *(map(list, zip(*map(one, texts))) if ids else [[]] * 6)]

    return by_batch(docs.select("doc_id", text), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string", make)
