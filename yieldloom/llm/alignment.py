"""Alignment of two tokenizers' tokens by merging their end offsets along merge paths."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import PIECES, TOKENIZERS, once, pin

BYTES_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Fixed value: how the byte-level tokenizer cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends of both tokenizers that one piece merges.
PIECE = 1 << 13
#: Characters of the texts that a task encodes at a time, pieces that it aligns at a time, pairs that it counts at a time.
CHARACTERS, PIECES_AT_A_TIME, PAIRS_AT_A_TIME = 1 << 18, 128, 1 << 19
#: Pairs whose counts are broadcast, most frequent first (17 bytes each); counts of rarer pairs are joined.
BROADCAST_PAIRS = 1 << 20
#: Digests of documents without tokens are this.
NOTHING = ""

TOKENS = "row long, doc_id long, pieces long, piece long, a_at long, b_at long, a binary, b binary"
PART = "row long, doc_id long, pieces long, piece long, n_a long, n_b long, n_groups long, n_best long, count_sum long, head_a binary, head_b binary, closed binary, tail_a binary, tail_b binary"
TOTALS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = arrow(schema)
    given = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(given, fields.types)], schema=fields)


class Tokenizers:
    """Both tokenizers with their tokens' bytes; A by byte-level merges, B by pieces that put a space first."""

    def __init__(self, a_path: str = BYTES_BPE, b_path: str = PIECES):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        with open(a_path, encoding="utf-8") as file:
            read = json.load(file)
        special = {t["content"] for t in read["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})  # an id is its merge's rank
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        #: Ids travel in as few bytes as the vocabularies allow.
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        # An entry for each way a token can be followed: A within a group, A at its end, B within it, B at its end.
        self.entries = [b"%d%c" % (i, end) for end in b",|,;" for i in range(self.size)]

    @property
    def size(self) -> int:
        return max(len(self.a_bytes), len(self.b_bytes))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both ids of each text; None for an empty text or one whose tokens don't give its bytes."""
        found: list = [None] * len(texts)
        b_all = self.b.encode([t or "" for t in texts], num_threads=1)
        for k, (text, b) in enumerate(zip(texts, b_all)):
            if not text:
                continue
            raw = (" " + text).encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                continue
            a = self.a.encode_ordinary(" " + text)
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw:
                found[k] = np.array(a, self.dtype), np.array(b, self.dtype)
        return found


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return once(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))


def merge_path(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Cuts the merge of two ascending lists of distinct ends into pieces of ``size`` elements: (taken of a, taken of b) at each cut.

    On a diagonal the numbers taken of both add up to a multiple of ``size``; a binary search along it finds where the
    merge crosses, for all diagonals at once and without merging what lies before. An end of both lists stays in one
    piece, which may so have one element more.
    """
    across = np.arange(size, len(a) + len(b), size)
    low, high = np.maximum(0, across - len(b)), np.minimum(across, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = np.zeros(len(across), bool)
        before[open_] = a[middle[open_]] <= b[across[open_] - middle[open_] - 1]  # at equal ends a comes first
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    i, j = low, across - low
    both = (i > 0) & (j < len(b))
    both[both] = a[i[both] - 1] == b[j[both]]
    return [(0, 0), *zip(i.tolist(), (j + both).tolist()), (len(a), len(b))]


def ends(ids: np.ndarray, sizes: np.ndarray, at: int = 0) -> np.ndarray:
    return at + np.cumsum(sizes[ids])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends that both ascending lists hold."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return hit, at[hit]


def overlaps(pieces: list[tuple], known: Tokenizers):
    """For each piece its ids and the indices of its common ends: every link lies inside one piece."""
    for row in pieces:
        a, b = np.frombuffer(row[6], known.dtype), np.frombuffer(row[7], known.dtype)
        yield row, a, b, *common_ends(ends(a, known.a_sizes, row[4]), ends(b, known.b_sizes, row[5]))


def closed_groups(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, known: Tokenizers) -> bytes:
    """``a1,a2|b1;`` for each group; a group ends with the token i of a and j of b."""
    if not len(i):
        return b""
    a, b = a[: i[-1] + 1].astype(np.int64), b[: j[-1] + 1].astype(np.int64)
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[i], b_last[j] = True, True
    # A token of a stands behind the tokens of b of all earlier groups, one of b behind those of a of its own group, too.
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    place = np.empty(len(a) + len(b), np.int64)
    place[np.arange(len(a)) + np.r_[0, j + 1][a_group]] = a + known.size * a_last
    place[np.arange(len(b)) + (i + 1)[b_group]] = b + known.size * (2 + b_last)
    return b"".join(map(known.entries.__getitem__, place.tolist()))


def group_text(a: np.ndarray, b: np.ndarray) -> bytes:
    return b",".join(b"%d" % x for x in a) + b"|" + b",".join(b"%d" % x for x in b) + b";"


def token_pieces(docs: DataFrame, text: str, a_path: str, b_path: str, size: int) -> DataFrame:
    """TOKENS: the ids of each document, cut by merge paths; documents without tokens have one piece without ids."""

    def cut(row, doc_id, found, known):
        if found is None:
            return [(row, doc_id, 1, 0, 0, 0, b"", b"")]
        a, b = found
        a_ends, b_ends = ends(a, known.a_sizes), ends(b, known.b_sizes)
        cuts = merge_path(a_ends, b_ends, size)
        rows = []
        for k, ((i, j), (p, q)) in enumerate(zip(cuts, cuts[1:])):
            starts = int(a_ends[i - 1]) if i else 0, int(b_ends[j - 1]) if j else 0
            rows.append((row, doc_id, len(cuts) - 1, k, *starts, a[i:p].tobytes(), b[j:q].tobytes()))
        return rows

    def run(batches):
        known = tokenizers(a_path, b_path)
        for batch in batches:
            held, length = [], 0
            for k in range(batch.num_rows):
                held.append(tuple(batch.column(c)[k].as_py() for c in range(3)))
                length += len(held[-1][2] or "")
                if length >= CHARACTERS or k == batch.num_rows - 1:
                    yield from written(held, known)
                    held, length = [], 0

    def written(held, known):
        rows = []
        for (row, doc_id, _), found in zip(held, known.encode([h[2] for h in held])):
            rows += cut(row, doc_id, found, known)
        for at in range(0, len(rows), PIECES_AT_A_TIME):
            yield columns(TOKENS, rows[at : at + PIECES_AT_A_TIME])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text).mapInArrow(run, TOKENS)


def piece_rows(batch: pa.RecordBatch):
    """The batch's pieces, some at a time."""
    for at in range(0, batch.num_rows, PIECES_AT_A_TIME):
        part = batch.slice(at, PIECES_AT_A_TIME)
        yield list(zip(*[c.to_pylist() for c in part.columns]))


def linked_pairs(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (A's id times 2^32 plus B's), n: how many links of all documents hold it; counted in tasks first."""

    def run(batches):
        known, held, size = tokenizers(a_path, b_path), [], 0

        def counted():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for rows in piece_rows(batch):
                for _, a, b, i, j in overlaps(rows, known):
                    held.append(a[i].astype(np.int64) << 32 | b[j])
                    size += len(i)
                if size >= PAIRS_AT_A_TIME:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return pieces.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned_pairs(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair, n, best: whether n is the highest of the pairs with the same id of B; ties are all best."""
    counts = pin(linked_pairs(pieces, a_path, b_path).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return pin(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def frequent(pairs: DataFrame, room: int) -> tuple[int, tuple[np.ndarray, ...]]:
    """The least count whose pairs are broadcast, and those pairs: whole powers of two that fit ``room``, from the top."""
    least = None
    levels = pairs.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("size")).orderBy(F.desc("level"))
    for row in levels.collect():  # at most 63 rows
        if row["size"] > room:
            break
        room, least = room - row["size"], 2 ** row["level"]
    if least is None:
        least = 2**63 - 1
    kept = pairs.filter(F.col("n") >= F.lit(least)).orderBy("pair").toPandas()  # bounded by ``room``
    return least, (kept["pair"].to_numpy(np.int64), kept["n"].to_numpy(np.int64), kept["best"].to_numpy(bool))


def looked_up(pair: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair, whether the table holds it, its count and whether it is best (0 where it is absent)."""
    keys, n, best = table
    if not len(keys):
        return np.zeros(len(pair), bool), np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    hit = keys[at] == pair
    return hit, np.where(hit, n[at], 0), hit & best[at]


def aligned_pieces(pieces: DataFrame, shared, a_path: str, b_path: str) -> DataFrame:
    """PART: each piece's closed groups and what stands before the first and after the last common end."""

    def run(batches):
        known, table = tokenizers(a_path, b_path), shared.value
        for batch in batches:
            for rows in piece_rows(batch):
                found = list(overlaps(rows, known))
                pair = np.concatenate([a[i].astype(np.int64) << 32 | b[j] for _, a, b, i, j in found])
                _, n, best = looked_up(pair, table)
                out, at = [], 0
                for row, a, b, i, j in found:
                    mine = slice(at, at := at + len(i))
                    p, q = (i[0] + 1, j[0] + 1) if len(i) and row[3] else (0, 0)  # a first piece has no head
                    head_a, head_b = a[:p], b[:q]
                    s, t = (i[-1] + 1, j[-1] + 1) if len(i) else (0, 0)
                    inner = len(i) - (p > 0)
                    closed = closed_groups(a[p:s], b[q:t], i[len(i) - inner :] - p, j[len(j) - inner :] - q, known) if len(i) else b""
                    sums = int(best[mine].sum()), int(n[mine].sum())
                    out.append((*row[:4], len(a), len(b), len(i), *sums, head_a.tobytes(), head_b.tobytes(), closed, a[s:].tobytes(), b[t:].tobytes()))
                yield columns(PART, out)

    return pieces.mapInArrow(run, PART)


def stitched(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """TOTALS: pieces of a document in order; a group that a cut divides is put together from the tail and the next head.

    A task reads its pieces sorted and holds one of them, whatever the document's length.
    """

    def total(state):
        row, doc_id, sums, digest, listed = state[:5]
        groups = digest.hexdigest() if listed else NOTHING
        return (row, doc_id, *sums[:3], sums[2], *sums[3:], groups)

    def run(batches):
        state, dtype = None, tokenizers(a_path, b_path).dtype
        for batch in batches:
            out = []
            for row, doc_id, _, _, n_a, n_b, n_groups, n_best, count_sum, head_a, head_b, closed, tail_a, tail_b in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state[0] != row:
                    if state is not None:
                        out.append(total(state))
                    state = [row, doc_id, [0] * 5, hashlib.sha256(), False, b"", b""]
                state[2] = [x + y for x, y in zip(state[2], (n_a, n_b, n_groups, n_best, count_sum))]
                open_a, open_b = state[5] + head_a, state[6] + head_b
                written = b""
                if head_a or head_b:
                    written = group_text(np.frombuffer(open_a, dtype), np.frombuffer(open_b, dtype))
                    open_a = open_b = b""
                if written + closed:
                    # The separator before a group is written with it, so that none follows the last one.
                    state[3].update((b";" if state[4] else b"") + (written + closed)[:-1])
                    state[4] = True
                state[5], state[6] = open_a + tail_a, open_b + tail_b
            yield columns(TOTALS, out)
        if state is not None:
            yield columns(TOTALS, [total(state)])

    return parts.mapInArrow(run, TOTALS)


def rare_links(pieces: DataFrame, pairs: DataFrame, shared, least: int, a_path: str, b_path: str) -> DataFrame:
    """row, rare_best, rare_sum: over links whose pair is not in the broadcast table. Such a pair has few links, so none is hot."""

    def run(batches):
        known, table = tokenizers(a_path, b_path), shared.value
        for batch in batches:
            for rows in piece_rows(batch):
                for row, a, b, i, j in overlaps(rows, known):
                    pair = a[i].astype(np.int64) << 32 | b[j]
                    pair, times = np.unique(pair[~looked_up(pair, table)[0]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row[0], np.int64)), pa.array(pair), pa.array(times.astype(np.int64))], names=["row", "pair", "times"])

    rare = pairs.filter(F.col("n") < F.lit(least))
    met = pieces.mapInArrow(run, "row long, pair long, times long").join(rare, "pair")
    return met.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))


def align_tokens(docs: DataFrame, text: str = "text", a_path: str = BYTES_BPE, b_path: str = PIECES, size: int = PIECE, room: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of both tokenizers are laid over the bytes of a space and the text. Where a token of A and one of B end
    together they are linked and a group ends; no token is empty, so there are as many links as groups. A text that is
    null, empty or not given back by its tokens has none, zeros and an empty digest. Special tokens' strings are plain
    text. Repeated rows give repeated rows and count as often, a null doc_id stays null, extra columns are ignored.

    Each document's two lists of ends are cut by merge paths into pieces of ``size`` ends, which are rows of their own:
    pieces are merged, counted and written one by one, and the groups over a cut are put together afterwards. Pair
    counts are combined in tasks before they are summed; the ``room`` most frequent ones are broadcast, others joined.
    """
    pieces = pin(token_pieces(docs, text, a_path, b_path, size))
    pairs = aligned_pairs(pieces, a_path, b_path)
    least, table = frequent(pairs, room)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    whole = stitched(aligned_pieces(pieces.filter("pieces = 1"), shared, a_path, b_path), a_path, b_path)
    parts = aligned_pieces(pieces.filter("pieces > 1"), shared, a_path, b_path)
    totals = whole.unionByName(stitched(parts.repartition("row").sortWithinPartitions("row", "piece"), a_path, b_path))
    if not pairs.filter(F.col("n") < F.lit(least)).isEmpty():
        rare = rare_links(pieces, pairs, shared, least, a_path, b_path)
        totals = totals.join(rare, "row", "left")
        totals = totals.withColumn("n_best", F.col("n_best") + F.coalesce("rare_best", F.lit(0)))
        totals = totals.withColumn("count_sum", F.col("count_sum") + F.coalesce("rare_sum", F.lit(0)))
    return totals.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
