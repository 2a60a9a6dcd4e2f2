"""BPE encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import regex
from pyspark.sql import DataFrame

from yieldloom.llm.common import WORD_BPE, by_batch, once

#: Entries of a task's memory of fragments and words before it starts afresh.
MEMORY = 150_000
#: From so many symbols a fragment is merged with a heap instead of repeated scans.
LONG = 40
END = "</w>"
#: Characters without any canonical composition whose lower case doesn't depend on their neighbours.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*")


class ForcedBoundaryBpe:
    """Encodes with a public vocabulary whose words carry an end mark.

    Two neighbouring symbols that never stand next to each other inside any vocabulary token can't be merged
    over, so every such place is a certain cut. The fragments between cuts are encoded on their own (and
    remembered); their ids in order are the word's ids.
    """

    def __init__(self, path: str = WORD_BPE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = dict(spec["model"]["vocab"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.inside = {pair for token in self.vocab for pair in self._pairs(self._symbols_of(token))}
        #: Number, id bytes and decoded text of each single token; the same of fragments, words and pieces seen lately.
        self.known = {t: (1, i.to_bytes(4, "little"), t.encode()) for i, t in self.tokens.items()}
        self.fragments: dict[tuple[str, ...], tuple[int, bytes, bytes]] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        # The byte alphabet: visible Latin-1 characters stand for themselves, the others for U+0100 onwards.
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]

    @staticmethod
    def _pairs(symbols):
        return zip(symbols, symbols[1:])

    @staticmethod
    def _symbols_of(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and token != END else [*token]

    def cuts(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between the places that no token spans."""
        out, start = [], 0
        for k, pair in enumerate(self._pairs(symbols), 1):
            if pair not in self.inside:
                out.append(tuple(symbols[start:k]))
                start = k
        out.append(tuple(symbols[start:]))
        return out

    def _scan(self, parts: list[str]) -> list[str]:
        """Merges the pair of lowest rank, the leftmost of them, until no pair has a rank."""
        none = len(self.ranks)
        rank = [self.ranks.get(pair, none) for pair in self._pairs(parts)]
        while rank and (low := min(rank)) < none:
            k = rank.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del rank[k]
            if k < len(rank):
                rank[k] = self.ranks.get((parts[k], parts[k + 1]), none)
            if k:
                rank[k - 1] = self.ranks.get((parts[k - 1], parts[k]), none)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        """The same merges for a long fragment: lowest rank first, then leftmost."""
        n, ranks = len(parts), self.ranks
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(ranks[p], k, p) for k, p in enumerate(self._pairs(parts)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            right = after[k]
            if not live[k] or right >= n or (parts[k], parts[right]) != pair:
                continue
            parts[k], live[right], after[k] = parts[k] + parts[right], False, after[right]
            if after[k] < n:
                before[after[k]] = k
            for left, at in ((before[k], k), (k, after[k])):
                if left >= 0 and at < n and (p := (parts[left], parts[at])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, p))
        return [p for p, on in zip(parts, live) if on]

    def fragment(self, symbols: tuple[str, ...]) -> tuple[int, bytes, bytes]:
        """Number of ids, their bytes and their decoded texts."""
        if (entry := self.fragments.get(symbols)) is None:
            parts = (self._scan if len(symbols) < LONG else self._heap)([*symbols])
            entry = self._joined([self.known[p] for p in parts if p in self.known])
        return entry

    @staticmethod
    def _joined(entries: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        if len(entries) == 1:
            return entries[0]
        return sum([e[0] for e in entries]), b"".join([e[1] for e in entries]), b" ".join([e[2] for e in entries if e[0]])

    @staticmethod
    def _remember(memory: dict, key, entry) -> None:
        if len(key) <= 64:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[key] = entry

    def word(self, word: str) -> tuple[int, bytes, bytes]:
        """One pre-split word in the byte alphabet."""
        pieces = self.cuts([*word[:-1], word[-1] + END])
        if len(pieces) == 1:
            return self.fragment(pieces[0])
        entries = [self.fragment(piece) for piece in pieces]
        for piece, entry in zip(pieces, entries):
            self._remember(self.fragments, piece, entry)
        return self._joined(entries)

    def _latin(self, piece: str) -> tuple[int, bytes, bytes]:
        if (entry := self.words.get(piece)) is None:
            entry = self.word(piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()]))
            self._remember(self.words, piece, entry)
        return entry

    def _plain(self, text: str) -> tuple[int, bytes, bytes]:
        """Latin letters and visible signs need no composition; everything else is split by the library's own rules."""
        if LATIN.fullmatch(text):
            return self._joined([self._latin(piece) for piece in self.split(text.lower())])
        return self._joined([self.word(piece) for piece, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def _with_special(self, text: str) -> tuple[int, bytes, bytes]:
        """Special tokens are found first, leftmost; what lies between them is normalised and split."""
        parts = [self.known[t] if t in self.special else self._plain(t) for t in self.specials.split(text) if t]
        return self._joined(parts)

    def _chunk(self, raw: bytes) -> tuple[int, bytes, bytes]:
        if raw.isalpha():
            entry = self.word(raw.decode().lower())
        else:
            text = raw.decode("utf-8")
            entry = self._with_special(text) if "<|" in text else self._plain(text)
        self._remember(self.chunks, raw, entry)
        return entry

    def encode(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as little-endian unsigned 32-bit integers, the decoded text in UTF-8.

        No token reaches over ASCII white space and normalisation doesn't either, so pieces between white space
        are encoded one by one.
        """
        raw, known = (text or "").encode("utf-8"), self.chunks.get
        if b"<|" not in raw:
            raw = raw.lower()  # A-Z only; special tokens are told apart by case, so texts that may hold one stay
        return self._joined([known(c) or self._chunk(c) for c in raw.split()])

    def decode(self, ids) -> str:
        """The tokens' texts joined by one space, special ones included; unknown ids have none."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def codec(path: str = WORD_BPE) -> ForcedBoundaryBpe:
    """The process's own coder: a Python worker reads the vocabulary once and remembers words from task to task."""
    return once(("bpe", path), lambda: ForcedBoundaryBpe(path))


def encode_documents(docs: DataFrame, text: str = "text", path: str = WORD_BPE) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (text).

    A null or empty text has no ids and decodes to an empty text. Repeated rows give repeated rows; other columns are
    ignored. Long words are merged with a heap, so time stays near linear in the text.
    """

    def make():
        bpe = codec(path)

        def work(ids, texts):
            done = [bpe.encode(t) for t in texts]
            return [ids, [d[0] for d in done], [d[1] for d in done], [d[2].decode() for d in done]]

        return work

    return by_batch(docs.select("doc_id", text), "doc_id long, n_tokens long, ids binary, decoded string", make)


def token_digests(docs: DataFrame, text: str = "text", path: str = WORD_BPE) -> DataFrame:
    """``encode_documents`` with the digests taken inside the task, so that neither ids nor texts travel."""

    def make():
        bpe = codec(path)

        def work(ids, texts):
            done = [bpe.encode(t) for t in texts]
            return [ids, [d[0] for d in done], [hashlib.sha256(d[1]).hexdigest() for d in done], [hashlib.sha256(d[2]).hexdigest() for d in done]]

        return work

    return by_batch(docs.select("doc_id", text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
