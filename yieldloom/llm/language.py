"""Language identification by unigram models of pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import PIECES, by_batch, fold_of, once

LETTERS = regex.compile(r"\p{L}+").findall
#: Faster, but it also takes numerals that are no digits; such runs are split again.
RUNS = re.compile(r"[^\W\d_]+").findall
MARK = "▁"  # begins a word in the vocabulary
FOLDS, HELD_OUT = 4, 2
#: Pseudo-count of each piece in each language.
SMOOTHING = 0.1
#: Passes of expectation-maximisation; the first one starts from equal pieces, the same for all languages.
ROUNDS = 1
#: Cells (words times positions) of one lattice, words remembered by a process.
CELLS, HELD = 400_000, 400_000
#: Sums below this are scaled up, which is looked after every so many positions, far from the least double.
TINY, EVERY = 1e-60, 4
UNDETERMINED = "und"
#: Bits of a piece's length and id within a span's number.
LENGTH_BITS, ID_BITS = 6, 20


class Pieces:
    """The fixed vocabulary: ids of pieces, and all their beginnings."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.size = len(pieces) + 1  # the last id is any single character that is no piece
        self.tree: list = [-1, {}]  # id of the piece that ends here, and what may follow
        for p, k in self.ids.items():
            node = self.tree
            for c in p:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = k
        if max(map(len, self.ids)) >= 1 << LENGTH_BITS or self.size > 1 << ID_BITS:
            raise ValueError("the vocabulary has too many or too long pieces")

    def spans(self, word: str) -> list[int]:
        """Start, length and id of all pieces in a word with its mark, each in one number. A character that is no piece is one, too."""
        text = MARK + word
        out, n, other = [], len(text), self.size - 1
        add, first = out.append, self.tree[1]
        for i in range(n):
            place, j = i << (LENGTH_BITS + ID_BITS), i + 1
            node = first.get(text[i])
            if node is None or node[0] < 0:
                add(place | 1 << ID_BITS | other)
            while node is not None:
                if node[0] >= 0:
                    add(place | (j - i) << ID_BITS | node[0])
                node = node[1].get(text[j]) if j < n else None
                j += 1
        return out


def load_pieces(path: str = PIECES) -> Pieces:
    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        return Pieces([model.id_to_piece(k) for k in every if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))])

    return once(("pieces", path), make)


def lots(words: list[str]):
    """The words' places in lots of similar lengths and at most CELLS cells; a longer word is a lot of its own."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    start = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or (at - start + 1) * (len(words[order[at]]) + 2) > CELLS:
            yield order[start:at]
            start = at


class Lattice:
    """All pieces of a batch of words as one set of edges.

    Sums over segmentations shrink with a word's length. They are kept as doubles and logarithms of scales: as soon as all sums of
    the last positions that pieces can still start from are tiny, these are scaled up together. So words of
    any length have a probability.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        found, counts = [], []
        for w in words:
            some = pieces.spans(w)
            found += some
            counts.append(len(some))
        spans = np.array(found, np.int64)
        self.word = np.repeat(np.arange(len(words)), counts)
        self.start, self.id = spans >> (LENGTH_BITS + ID_BITS), spans & ((1 << ID_BITS) - 1)
        self.end = self.start + ((spans >> ID_BITS) & ((1 << LENGTH_BITS) - 1))
        self.length = np.array([len(w) + 1 for w in words])
        self.words = len(words)
        self.reach = int((self.end - self.start).max()) if len(spans) else 1

    def _scaled(self, sums: np.ndarray, scale: np.ndarray | None, j: int, window: slice) -> np.ndarray | None:
        """Scales the window's sums up, by word and model, where all of them are tiny. scale: ln of what was multiplied, None for nothing."""
        rows = np.flatnonzero(((sums[:, j] < TINY) & (sums[:, j] > 0)).any(axis=1))
        if not len(rows):
            return scale
        if scale is None:
            scale = np.zeros_like(sums)
        top = sums[rows, window].max(axis=1)
        factor = np.where((top < TINY) & (top > 0), 1 / np.where(top > 0, top, 1.0), 1.0)
        sums[rows, window] *= factor[:, None]
        scale[rows, window] += np.log(factor)[:, None]
        return scale

    def _walk(self, p: np.ndarray, sums: np.ndarray, back: bool) -> np.ndarray | None:
        """Fills the sums position by position and returns their scales."""
        top, models, scale = int(self.length.max()), p.shape[1], None
        here, there = (self.start, self.end) if back else (self.end, self.start)
        order = np.argsort(here, kind="stable")
        cuts = np.searchsorted(here[order], np.arange(top + 2))
        step = -1 if back else 1
        for j in range(top - 1, -1, -1) if back else range(1, top + 1):
            e = order[cuts[j] : cuts[j + 1]]
            add = sums[self.word[e], there[e]] * p[self.id[e]]
            for m in range(models):
                sums[:, j, m] += np.bincount(self.word[e], add[:, m], self.words)
            if scale is not None:  # a word's end has scale 0 on the way back, other positions their neighbour's
                going = self.length > j if back else slice(None)
                scale[going, j] = scale[going, j - step]
            if j % EVERY == 0:
                scale = self._scaled(sums, scale, j, slice(j, min(top, j + self.reach) + 1) if back else slice(max(0, j - self.reach), j + 1))
        return scale

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over all segmentations of the first positions [word, position, model] and ln of their scales. p: piece by model."""
        alpha = np.zeros((self.words, int(self.length.max()) + 1, p.shape[1]))
        alpha[:, 0] = 1
        return alpha, self._walk(p, alpha, False)

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta = np.zeros((self.words, int(self.length.max()) + 1, p.shape[1]))
        beta[np.arange(self.words), self.length] = 1
        return beta, self._walk(p, beta, True)

    def log_probabilities(self, p: np.ndarray) -> np.ndarray:
        alpha, scale = self.forward(p)
        whole = np.arange(self.words), self.length
        return np.log(alpha[whole]) - (0.0 if scale is None else scale[whole])

    def shares(self, p: np.ndarray) -> np.ndarray:
        """Of each edge and model, the share of the word's probability that runs through it."""
        (alpha, up), (beta, down) = self.forward(p), self.backward(p)
        whole = np.arange(self.words), self.length
        share = alpha[self.word, self.start] * p[self.id] * beta[self.word, self.end] / alpha[whole][self.word]
        if up is None and down is None:
            return share
        up, down = (np.zeros_like(alpha) if s is None else s for s in (up, down))
        return share * np.exp(up[whole][self.word] - up[self.word, self.start] - down[self.word, self.end])

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts by model; weight: word by model."""
        share = self.shares(p)
        return np.stack([np.bincount(self.id, share[:, m] * weight[self.word, m], len(p)) for m in range(p.shape[1])], axis=1)


class Scorer:
    """ln P(word | language) for whole words, remembered within bounds."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.row: dict[str, int] = {}
        self.table = np.empty((0, p.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.p.shape[1]))
        for some in lots(words):
            out[some] = Lattice([words[k] for k in some], self.pieces).log_probabilities(self.p)
        return out

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over each text's words."""
        if len(self.row) > HELD:
            self.row, self.table = {}, self.table[:0]
        new = [*{w for t in texts for w in t if w not in self.row}]
        if new:
            self.row |= {w: k for k, w in enumerate(new, len(self.row))}
            self.table = np.concatenate([self.table, self.words(new)])
        rows = self.row.__getitem__
        return np.array([self.table[np.fromiter(map(rows, t), np.int64, len(t))].sum(axis=0) for t in texts]).reshape(len(texts), -1)


def letters(text: str | None) -> list[str]:
    """Runs of letters of the text's lower case."""
    runs = RUNS(text.lower()) if text else []
    return runs if "".join(runs).isalpha() else [w for r in runs for w in LETTERS(r)]


def expected_pieces(docs: DataFrame, text: str, lang: str, path: str, langs: list[str] | None, p: np.ndarray | None) -> DataFrame:
    """lang, piece, n: expected piece counts over all texts, summed within tasks before the shuffle.

    Without a model, pieces are equal and the expectation is the same in all languages.
    """
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())])

    def run(batches):
        pieces = load_pieces(path)
        seen: dict[str, Counter] = {}

        def flushed():
            names = sorted(seen)
            words = sorted({w for c in seen.values() for w in c}, key=len)
            total = np.zeros((pieces.size, len(names)))
            equal = np.full((pieces.size, len(names)), 1 / pieces.size) if p is None else p[:, [langs.index(n) for n in names]]
            for places in lots(words):
                some = [words[k] for k in places]
                weight = np.array([[seen[n][w] for n in names] for w in some], float)
                lattice = Lattice(some, pieces)
                if p is None:  # one lattice pass serves all languages
                    share = lattice.shares(np.full((pieces.size, 1), 1 / pieces.size))[:, 0]
                    for m in range(len(names)):
                        total[:, m] += np.bincount(lattice.id, share * weight[lattice.word, m], pieces.size)
                else:
                    total += lattice.expected(equal, weight)
            k, m = np.nonzero(total)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x in m], pa.string()), pa.array(k), pa.array(total[k, m])], schema=schema)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(name, Counter()).update(letters(value))
            if sum(map(len, seen.values())) > HELD:
                yield flushed()
        if seen:
            yield flushed()

    counts = docs.select(lang, text).mapInArrow(run, "lang string, piece long, n double")
    return counts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", path: str = PIECES, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, piece probabilities (piece by language) and ln of the languages' shares of documents.

    What reaches the driver is one row per language and piece of the fixed vocabulary.
    """
    labelled = docs.filter(F.col(lang).isNotNull())
    shares = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    p = None
    for _ in range(rounds if langs else 0):
        total = np.full((load_pieces(path).size, len(langs)), SMOOTHING)
        for r in expected_pieces(labelled, text, lang, path, langs, p).collect():
            total[r["piece"], langs.index(r["lang"])] += r["n"]
        p = total / total.sum(axis=0)
    share = np.array([shares[k] for k in langs], float)
    return langs, p, np.log(share / share.sum()) if langs else share


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", path: str = PIECES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its posterior probability).

    Learnt from text and non-null lang of the documents outside the held-out fold (crc32 of doc_id modulo 4 is 2).
    A text is the letter runs of its lower case; a word's probability sums over all its segmentations into pieces of
    the vocabulary, and a text's is the product over words. Ties go to the first language by name. Null texts, texts
    without a letter, and all texts where nothing was learnt are ``und`` with score 0. Repeated rows give repeated
    rows; other columns are ignored; whole texts are read.
    """
    langs, p, prior = train(docs.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT), text, lang, path)
    if not langs:
        blank = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
        return blank.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast((langs, p, prior))

    def make():
        names, probabilities, shares = model.value
        scorer = once(("language", hash(probabilities.tobytes())), lambda: Scorer(load_pieces(path), probabilities))

        def work(ids, held, values):
            texts = [letters(v) for v in values]
            sums = scorer.texts(texts) + shares
            best = sums.argmax(axis=1)
            score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            return [ids, held, [names[b] if t else UNDETERMINED for b, t in zip(best, texts)], [float(s) if t else 0.0 for s, t in zip(score, texts)]]

        return lambda ids, held, values: work(ids, held, values) if ids else [ids, held, [], []]

    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), text)
    return by_batch(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)
