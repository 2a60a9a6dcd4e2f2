"""Hidden Markov language model over words."""

from __future__ import annotations

from itertools import chain
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import fold_of, freed, hand_back, lots, pin, settings
from yieldloom.llm.jaccard import MIX, mixed
from yieldloom.session import scratch_path

FOLDS, HELD_OUT = 7, 2
STATES, ROUNDS = 8, 4
#: Words (of all blocks) whose counts are summed in one group, and the bytes that long words may have there on average.
GROUP_WORDS, WORD_BYTES = 1 << 19, 16
#: Tokens of a block: its distinct words are looked up together.
BLOCK_TOKENS = 1 << 22
#: Texts, and their bytes, that are split into words at a time.
LOT_ROWS, LOT_BYTES = 1 << 13, 1 << 23
#: Texts processed side by side, and cells (texts by longest length) of such a group.
LANES, CELLS = 512, 1 << 18
#: Every so many words probabilities are scaled to add up to one: far fewer than take them below the least number.
SCALED = 8
SMOOTHING, STAY, NOISE, SEED = 0.05, 0.9, 0.3, 6
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary()), ("load", pa.int64())])
LIST = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])
REPLY = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("shares", pa.binary())])
#: A block's number is its task's (up to 2^22) and, in the lowest bits, its own among the task's blocks; a place is a
#: block's number and, in the lowest bits, a word's number in the block's list. A text of Spark's largest size has fewer words.
SERIAL_BITS, PLACE_BITS = 13, 28
PACKED = "block long, docs array<long>, held array<boolean>, sizes array<long>, tokens binary, words binary, load long"
NUMBERED = "part long, block long, counts binary, ranks binary, first binary"
CODED = "block long, docs array<long>, held array<boolean>, sizes array<long>, tokens binary, counts binary, at binary, ranks binary, ways binary, total long, distinct long, first array<double>"
COUNTED = "part long, block long, ranks binary, sizes binary, shares binary, sums array<double>"
MERGED = "part long, blocks binary, sizes binary, ranks binary, shares binary, sums array<double>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Sums over blocks and words have parts from here down.
SUMS = -1
#: A word's share of a state is kept as a root in so many steps: three bytes, fine for small shares, too.
STEPS, WIDTH = (1 << 24) - 1, 3
#: Sums are exact at ten decimals, whatever order tasks end in.
EXACT = "decimal(28,10)"
#: Rows are large, so a writer checks their memory row by row.
ROW_BY_ROW = ("parquet.page.size.row.check.min", "1")
#: Tasks that blocks are dealt to, beyond the session's own number of shuffle partitions.
MOST_TASKS = 1 << 14


def noise(hashes: np.ndarray) -> np.ndarray:
    """A fixed number for each word and state, of mean 0 and standard deviation NOISE."""
    shifts = np.array([(SEED * STATES + k + 1) * int(MIX) % (1 << 64) for k in range(STATES)], np.uint64)
    even = (mixed(hashes[:, None] + shifts) >> np.uint64(11)) / float(1 << 53)
    return NOISE * 12**0.5 * (even - 0.5)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """Texts as numbers into their block's own list of words; the empty word is the end of a text. One row per block."""

    def run(batches):
        hand_back()
        held = Block()
        for lot in (lot for batch in batches for lot in lots(batch, LOT_ROWS, LOT_BYTES)):
            at = 0
            while at < lot.num_rows:
                at += held.extend(*lot.slice(at).columns)
                if held.tokens >= BLOCK_TOKENS:
                    yield held.row()
                    held = Block(held.serial + 1)
                    hand_back()
        if held.docs:
            yield held.row()

    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), text)
    return rows.mapInArrow(run, PACKED)


class Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    def __init__(self, serial: int = 0):
        self.serial, self.tokens, self.docs, self.held, self.sizes, self.parts = serial, 0, [], [], [], []
        self.number = Numbers({b"": 0})

    def add(self, doc, held, text) -> None:
        self.extend(*(pa.array([x], t) for x, t in zip((doc, held, text), (pa.int64(), pa.bool_(), pa.string()))))

    def extend(self, docs: pa.Array, held: pa.Array, texts: pa.Array) -> int:
        """Adds texts up to the one that fills the block; returns how many. Only a lot's distinct words are looked up."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves empty words
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes)) + 1
        ends = np.cumsum(sizes)
        taken = min(int(np.searchsorted(ends, BLOCK_TOKENS - self.tokens)) + 1, len(ends))
        ends = ends[:taken]
        coded = words.filter(pa.array(real)).slice(0, int(ends[-1]) - taken).dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_buffer().to_pybytes().split()
        numbers = np.fromiter(map(self.number.__getitem__, names), np.uint32, len(names))
        ids, inner = np.zeros(ends[-1], np.uint32), np.ones(ends[-1], bool)
        inner[ends - 1] = False
        ids[inner] = numbers[coded.indices.to_numpy()]
        self.parts.append(ids)
        self.docs.extend(docs[:taken].to_pylist())
        self.held.extend(held[:taken].to_pylist())
        self.sizes.extend(sizes[:taken].tolist())
        self.tokens += int(ends[-1])
        return taken

    def row(self):
        block = block_number(TaskContext.get().partitionId(), self.serial)
        if len(self.number) >> PLACE_BITS:
            raise OverflowError(f"{len(self.number)} distinct words in one block")
        words = b" ".join(self.number)
        load = max(len(self.number), len(words) // WORD_BYTES)
        data = [[block], [self.docs], [self.held], [self.sizes], [packed_array(np.concatenate(self.parts))], [squeezed(words)], [load]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, BLOCK.types)], schema=BLOCK)


def block_number(task: int, serial: int) -> int:
    if serial >> SERIAL_BITS or task >> (63 - PLACE_BITS - SERIAL_BITS):
        raise OverflowError(f"block {serial} of task {task}: read the texts with more or fewer tasks")
    return (task << SERIAL_BITS) + serial


def places(block: int, words: int) -> np.ndarray:
    """Numbers that tell apart the words of all blocks."""
    return (block << PLACE_BITS) + np.arange(words)


def squeezed(x: bytes) -> bytes:
    """Compressed, after the number of bytes."""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def restored(x: bytes) -> bytes:
    return pa.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def packed_array(x: np.ndarray) -> bytes:
    """First the lowest bytes of all numbers, then the next ones: the high bytes, mostly zero, take little room."""
    return squeezed(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(restored(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps_of(x: np.ndarray) -> bytes:
    """Numbers that mostly rise, by their differences."""
    return packed_array(np.diff(x, prepend=0).astype(np.int32))


def from_steps(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x, np.int32), dtype=np.int64)


def names_in(words: bytes) -> list[bytes]:
    return restored(words).split(b" ")


def dealt(names: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's words in the order of their parts, which their hashes tell, and how many each part has."""
    part = (hashes_of(names) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)


def trained(row: dict, words: int) -> np.ndarray:
    """Counts of a block's words in its training texts."""
    train = np.repeat(~np.array(row["held"], bool), row["sizes"])
    return np.bincount(unpacked(row["tokens"], np.uint32)[train], minlength=words)


def block_words(packed: DataFrame, parts: int) -> DataFrame:
    """One row per part and block: the block's distinct words of the part and their counts in its training texts."""

    def run(batches):
        hand_back()
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                names = names_in(row["words"])
                n = trained(row, len(names))
                order, sizes = dealt(names, parts)
                names = np.array(names, object)
                lists = [(part, x) for part, x in enumerate(np.split(order, np.cumsum(sizes)[:-1])) if len(x)]
                data = [[part for part, _ in lists], [row["block"]] * len(lists), [squeezed(b" ".join(names[x])) for _, x in lists], [packed_array(n[x]) for _, x in lists]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, LIST.types)], schema=LIST)

    return packed.select("block", "held", "sizes", "tokens", "words").mapInArrow(run, "part long, block long, words binary, n binary")


def numbered(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of a part's words in all training texts and ranks of those that several blocks have, for each block that lists them."""
    hand_back()
    group = group.sort_values("block")
    lists = [names_in(x) for x in group["words"]]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    word = pa.array(chain.from_iterable(lists), pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    c = np.bincount(word, np.concatenate([unpacked(x, np.int64) for x in group["n"]])).astype(np.int64)
    shared = (c > 0) & (np.bincount(word) > 1)
    rank = np.where(shared, np.cumsum(shared) - 1, -1)
    first = np.diff(np.maximum.accumulate(word), prepend=-1) > 0  # words are told apart in the order in which they first come
    columns = [c[word], rank[word], first.astype(np.uint8)]
    return named([*zip(group["part"], group["block"], *(map(packed_array, np.split(x, cuts)) for x in columns))], NUMBERED)


def named(rows: list[tuple], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")])
    return frame.astype({"doc_id": "Int64"}) if "doc_id" in frame else frame


def exact_sums(rows: DataFrame, column: str) -> np.ndarray:
    """Sums of an array column by place, combined within tasks; empty without rows."""
    cells = rows.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(EXACT)).alias("x"))
    return np.array([float(r["x"]) for r in cells.orderBy("at").collect()])  # at most STATES * (STATES + 2) rows


def coded_blocks(packed: DataFrame, parts: int) -> DataFrame:
    """One row per block: its texts, its words' counts in all training texts, and the way of its trained words.

    A block lists its words by part, and a part answers with counts and ranks, so no list of all words is ever in one
    place. The first block that has a word adds it to the number of distinct words and to the sums of first emissions.
    ``at`` has a block's trained words in the order of their parts and ranks (``ways`` counts them by part; those that no
    other block has come last). Both ways between blocks and parts keep this order, so no list of words travels back.
    """

    def code(blocks_: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        hand_back()
        replies, out = replies.sort_values("part"), []
        for row in blocks_.to_dict("records"):
            names = names_in(row["words"])
            order, sizes = dealt(names, parts)
            c, rank, part, first = (np.empty(len(names), np.int64) for _ in range(4))
            c[order], rank[order] = (np.concatenate([unpacked(x, np.int64) for x in replies[y]]) for y in ("counts", "ranks"))
            first[order] = np.concatenate([unpacked(x, np.uint8) for x in replies["first"]])
            part[order] = np.repeat(np.arange(parts), sizes)
            at = np.flatnonzero(c > 0)
            part = np.where(rank < 0, parts, part)[at]
            by = np.lexsort((rank[at], part))
            mine = np.flatnonzero((c > 0) & (first > 0))
            sums = first_emissions([names[k] for k in mine], c[mine]).sum(axis=0)
            facts = [packed_array(c), packed_array(at[by].astype(np.uint32)), steps_of(rank[at][by]), packed_array(np.bincount(part, minlength=parts + 1))]
            kept = [row[x] for x in ("block", "docs", "held", "sizes", "tokens")]
            out.append((*kept, *facts, int(trained(row, len(names)).sum()), len(mine), sums))
        return named(out, CODED)

    answers = block_words(packed, parts).groupBy("part").applyInPandas(numbered, NUMBERED)
    return packed.drop("load").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(code, CODED)


def first_emissions(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    return (counts + 1)[:, None] * np.exp(noise(hashes_of(words)))


class Model:
    """Start, step and emission probabilities. Emission is symbol by state."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, spaces: dict[str, np.ndarray] | None = None):
        self.start, self.step, self.emit, self.spaces = start, step, emit, {} if spaces is None else spaces

    def forward(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward recursion, scaled after every SCALED words. symbols: time by text, padded; sizes fall.

        Returns alpha, the scales (1 beyond a text's end), the emissions and what alpha adds up to at each text's end.
        """
        t_max, lanes = symbols.shape
        seen = np.take(self.emit, symbols, axis=0, out=self.space("seen", symbols.shape), mode="clip")
        alpha = self.space("alpha", symbols.shape)
        scale = np.ones((t_max // SCALED, lanes))
        for t, live in enumerate(live_lanes(sizes, t_max)):
            now = alpha[t, :live]
            if t:
                np.matmul(alpha[t - 1, :live], self.step, out=now)
            else:
                now[:] = self.start
            if live < lanes:
                alpha[t, live:] = 0
            now *= seen[t, :live]
            if t % SCALED == SCALED - 1:
                scale[t // SCALED, :live] = now.sum(axis=1)
                now /= scale[t // SCALED, :live, None]
        return alpha, scale, seen, alpha[sizes - 1, np.arange(lanes)].sum(axis=1)

    def space(self, name: str, shape: tuple[int, int]) -> np.ndarray:
        """An array of a group (time by text by state) with any content, in memory that all groups share."""
        size = shape[0] * shape[1] * len(self.start)
        if name not in self.spaces or self.spaces[name].size < size:
            self.spaces[name] = np.empty(size)
        return self.spaces[name][:size].reshape(*shape, len(self.start))

    def log_likelihood(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        _, scale, _, ends = self.forward(symbols, sizes)
        return np.log(scale).sum(axis=0) + np.log(ends)

    def expected(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts: starts, steps, emissions (symbol by state), and the total ln likelihood."""
        alpha, scale, ahead, ends = self.forward(symbols, sizes)
        t_max, lanes = symbols.shape
        states = len(self.start)
        beta = self.space("beta", symbols.shape)
        lives = [*live_lanes(sizes, t_max), 0]
        back, last = np.ascontiguousarray(self.step.T), 1 / ends[:, None]
        for t in range(t_max - 1, -1, -1):
            live, now = lives[t], ahead[t, : lives[t]]
            if lives[t + 1] < lanes:
                beta[t, lives[t + 1] :] = last[lives[t + 1] :]  # texts that end here; of no account beyond their end
            if t:  # from here on: emission by scale, times beta
                if t % SCALED == SCALED - 1:
                    now /= scale[t // SCALED, :live, None]
                now *= beta[t, :live]
                if live < lanes:
                    ahead[t, live:] = 0
                np.matmul(now, back, out=beta[t - 1, :live])
        steps = alpha[:-1].reshape(-1, states).T @ ahead[1:].reshape(-1, states) * self.step
        beta *= alpha  # 0 beyond a text's end, as alpha is
        cells = (symbols[..., None] * states + np.arange(states)).ravel()
        emitted = np.bincount(cells, beta.ravel(), len(self.emit) * states).reshape(-1, states)
        return beta[0].sum(axis=0), steps, emitted, float(np.log(scale).sum() + np.log(ends).sum())


def live_lanes(sizes: np.ndarray, t_max: int) -> list[int]:
    """How many texts (sizes fall) are longer than each time."""
    return np.searchsorted(-sizes, -np.arange(t_max), side="left").tolist()


def groups(symbols: list[np.ndarray]):
    """Indices of texts of similar length and their symbols, time by text, longest first."""
    order = sorted(range(len(symbols)), key=lambda k: -len(symbols[k]))
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(LANES, CELLS // len(symbols[order[at]])))]
        at += len(some)
        sizes = np.array([len(symbols[k]) for k in some])
        table = np.zeros((sizes[0], len(some)), np.int64)
        for lane, k in enumerate(some):
            table[: sizes[lane], lane] = symbols[k]
        yield some, table, sizes


class Round:
    """What all blocks need of a round: start and step probabilities and, by state, the sum of all words' emissions."""

    def __init__(self, number: int, start: np.ndarray, step: np.ndarray, sums: np.ndarray, distinct: int):
        self.number, self.start, self.step, self.sums, self.distinct = number, start, step, sums, distinct

    def model(self, row: dict, replies: pd.DataFrame | None) -> tuple[Model, np.ndarray]:
        """The model with emissions of this block's words, and their counts. Unknown words are one.

        Replies are the block's words in the first round, and then the shares of the trained ones by part.
        """
        c = unpacked(row["counts"], np.int64)
        if not self.number:
            emit = np.ones((len(c), STATES))
            if replies is not None:
                emit = first_emissions(names_in(replies["words"].iloc[0]), c)
                emit[c == 0] = 1
            return Model(self.start, self.step, emit / (self.sums + 1)), c
        at = unpacked(row["at"], np.uint32)
        emit = np.full((len(c), STATES), SMOOTHING)
        if len(at):
            emit[at] += c[at, None] * shares_of(b"".join(replies.sort_values("part")["shares"]))
        emit /= self.sums + SMOOTHING * (self.distinct + 1)
        return Model(self.start, self.step, emit), c


def kept_shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Roots of the shares of all states but the last, as bytes, one row per word. The last one has the rest."""
    roots = np.rint(np.sqrt(np.clip(counts[:, :-1] / sizes[:, None], 0, 1)) * STEPS).astype("<u4")
    return np.ascontiguousarray(roots).view(np.uint8).reshape(len(counts), STATES - 1, 4)[:, :, :WIDTH].reshape(len(counts), -1)


def shares_of(kept: bytes | np.ndarray) -> np.ndarray:
    """Words by states."""
    low = np.frombuffer(kept, np.uint8) if isinstance(kept, bytes) else kept
    roots = np.zeros((low.size // (WIDTH * (STATES - 1)), STATES - 1, 4), np.uint8)
    roots[:, :, :WIDTH] = low.reshape(-1, STATES - 1, WIDTH)
    shares = (roots.view("<u4")[:, :, 0] / STEPS) ** 2
    return np.column_stack([shares, np.maximum(1 - shares.sum(axis=1), 0)])


def texts_in(row: dict, some: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(row["sizes"])
    tokens = unpacked(row["tokens"], np.uint32)
    return [tokens[ends[k] - row["sizes"][k] : ends[k]] for k in some]


def replied(merged: DataFrame) -> DataFrame:
    """part, block, shares: a part's shares by word, dealt to the blocks that have the words, in each block's order."""

    def run(batches):
        hand_back()
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                kept = np.frombuffer(row["shares"], np.uint8).reshape(-1, WIDTH * (STATES - 1))
                to, sizes = unpacked(row["blocks"], np.int64), unpacked(row["sizes"], np.int64)
                lists = np.split(from_steps(row["ranks"]), np.cumsum(sizes)[:-1]) if row["ranks"] else [slice(None)]
                data = [[row["part"]] * len(to), to, [kept[x].tobytes() for x in lists]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, REPLY.types)], schema=REPLY)

    return merged.filter(F.col("part") > SUMS).select("part", "blocks", "sizes", "ranks", "shares").mapInArrow(run, "part long, block long, shares binary")


def by_block(coded: DataFrame, replies: DataFrame | None, work, schema: str) -> DataFrame:
    """Applies ``work`` to each block's row and what was sent to the block."""

    def run(blocks_: pd.DataFrame, answers: pd.DataFrame | None = None) -> pd.DataFrame:
        hand_back()
        return named([out for row in blocks_.to_dict("records") for out in work(row, answers)], schema)

    if replies is None:
        return coded.groupBy("block").applyInPandas(lambda rows: run(rows), schema)
    return coded.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


def baum_welch(coded: DataFrame, replies: DataFrame, now: Round, parts: int, path: str) -> tuple[DataFrame, Round]:
    """One round over all training texts: shares by word and state for the blocks that have the word, and the next round.

    Each block sends the counts of its words by part; a part's counts are summed by word. ``path`` gets the shares once per
    word, and they are dealt to the blocks that have it when these rows are read. Words of one block only are not summed,
    but take the same way.
    """
    shared = coded.sparkSession.sparkContext.broadcast(now)

    def count(row: dict, answers: pd.DataFrame | None):
        model, c = shared.value.model(row, answers)
        start, steps, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(c), STATES))
        local, n = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for some, table, sizes in groups(texts := texts_in(row, np.flatnonzero(~np.array(row["held"], bool)))):
            n += np.bincount(np.concatenate([texts[k] for k in some]), minlength=len(c))
            met = np.flatnonzero(np.bincount(table.ravel(), minlength=len(c)))
            local[met] = np.arange(len(met))
            a, b, e, _ = Model(model.start, model.step, model.emit[met], model.spaces).expected(local[table], sizes)
            start, steps = start + a, steps + b
            emitted[met] += e
        yield SUMS - 1 - row["block"] % parts, row["block"], b"", b"", b"", np.concatenate([start, steps.ravel(), np.zeros(STATES)])
        del model, local, answers
        at, rank, ways = unpacked(row["at"], np.uint32), from_steps(row["ranks"]), unpacked(row["ways"], np.int64)
        n = n[at]
        # A word that only other blocks' training texts have keeps its place with a count of 0.
        kept = kept_shares(emitted[at], np.maximum(n, 1))
        for part, x, y in zip(range(parts + 1), np.cumsum(ways) - ways, np.cumsum(ways)):
            if x < y:
                alone = part == parts
                yield part + alone * row["block"], row["block"], b"" if alone else steps_of(rank[x:y]), packed_array(n[x:y]), kept[x:y].tobytes(), None

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        hand_back()
        group = group.sort_values("block")
        part = group["part"].iloc[0]
        if part <= SUMS:
            return named([(part, None, None, None, None, np.sum(list(group["sums"]), axis=0))], MERGED)
        counts = [unpacked(x, np.int64) for x in group["sizes"]]
        sizes, shares = np.concatenate(counts), shares_of(b"".join(group["shares"]))
        word = np.concatenate([from_steps(x) for x in group["ranks"]]) if part < parts else np.arange(len(sizes))
        whole = np.bincount(word, sizes)
        kept = kept_shares(np.stack([np.bincount(word, sizes * shares[:, k]) for k in range(STATES)], axis=1), whole)
        # The sums that emissions are divided by are those of the shares as kept.
        sums = np.concatenate([np.zeros(STATES + STATES**2), whole @ shares_of(kept)])
        lengths = np.array([len(x) for x in counts])
        return named([(part, packed_array(group["block"].to_numpy()), packed_array(lengths), steps_of(word) if part < parts else b"", kept.tobytes(), sums)], MERGED)

    spark = coded.sparkSession
    # What lies there from earlier on goes first: the plan below would replace it only after its shuffles.
    spark.range(0).write.mode("overwrite").parquet(path)
    with freed(spark):
        by_block(coded, replies, count, COUNTED).groupBy("part").applyInPandas(merge, MERGED).write.mode("overwrite").option(*ROW_BY_ROW).option("compression", "none").parquet(path)
    stored = spark.read.schema(MERGED).parquet(path)
    sums = exact_sums(stored, "sums")
    start, steps, emitted = sums[:STATES], sums[STATES : STATES + STATES**2].reshape(STATES, STATES), sums[-STATES:]
    smooth = lambda x, axis: (x + SMOOTHING) / (x + SMOOTHING).sum(axis=axis, keepdims=True)
    return replied(stored), Round(now.number + 1, smooth(start, 0), smooth(steps, 1), emitted, now.distinct)


def score_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words in lower case (A-Z) and one end. ``base_score`` is the add-one unigram score. ``score`` is log10
    of the exact probability of the text under a hidden Markov model trained by Baum-Welch on all documents outside the
    held-out fold (crc32 of doc_id modulo 7 is 2): its states emit words, every training word with counts of its own by
    state; all unknown words are one. A null or empty text is one end. Without training documents all counts are 0 and
    the model is its first guess. Repeated rows give repeated rows; other columns are ignored; whole texts are read.

    Blocks of about four million tokens list their distinct words once; each round's counts are summed by word and state
    and sent back to the blocks that have the word, so memory is bounded by a block, however many words there are. Between
    rounds a word's count is exact and its shares of the states are kept in three bytes each; what emissions are divided by is summed from
    these shares, so probabilities add up to one.
    """
    spark = docs.sparkSession
    paths = [scratch_path(spark, "word-counts") for _ in range(2)]  # a round's rows replace those of the round before the last
    blocks(docs, text).write.option(*ROW_BY_ROW).option("compression", "none").parquet(paths[1])  # the second round replaces these rows
    packed = spark.read.schema(PACKED).parquet(paths[1])
    listed = packed.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("load"), F.lit(0)).alias("load")).first()
    tasks, parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * listed["blocks"], MOST_TASKS)), max(16, -(-listed["load"] // GROUP_WORDS))
    # Dealt once, by a plan whose partitioning the checkpoint keeps: a round then shuffles no texts.
    with freed(spark), settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        coded = pin(coded_blocks(packed, parts).repartition(tasks, "block"))
    facts = coded.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "distinct")]).first()
    total, distinct = facts["total"], facts["distinct"]
    step = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(step, STAY)  # states that tend to stay, and words' shares with a fixed noise: rounds then tell states apart
    first = exact_sums(coded, "first")
    now, replies = Round(0, np.full(STATES, 1 / STATES), step, first if len(first) else np.zeros(STATES), distinct), packed.select("block", "words") if total else None
    for k in range(ROUNDS if total else 0):
        replies, now = baum_welch(coded, replies, now, parts, paths[k % 2])
    shared = spark.sparkContext.broadcast(now)

    def score(row: dict, answers: pd.DataFrame | None):
        model, c = shared.value.model(row, answers)
        base = np.log10((c + 1) / (total + distinct + 1))
        texts = texts_in(row, np.arange(len(row["sizes"])))
        result = np.zeros(len(texts))
        for some, table, sizes in groups(texts):
            result[some] = model.log_likelihood(table, sizes)
        for doc, held, t, like in zip(row["docs"], row["held"], texts, result / log(10)):
            yield doc, bool(held), len(t), int((c[t] > 0).sum()), total, base[t].sum(), like

    return by_block(coded, replies, score, SCORED)
