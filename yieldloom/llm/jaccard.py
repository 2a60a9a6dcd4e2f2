"""N-gram Jaccard join with prefix filters under several global token orders."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import by_batch, pin
from yieldloom.llm.components import connected

WIDTH, PERCENT = 4, 85
#: Global orders: the first makes candidates, the others filter them.
ORDERS = 3
#: Tokens of at least so many documents rank behind rarer ones, by powers of two; the table of such tokens is broadcast
#: and holds at most so many entries (5 bytes each): the threshold rises until they fit.
FREQUENT, FREQUENT_ENTRIES = 8, 1 << 20
#: Tokens counted in one group, and tokens a task sorts at a time.
GROUP_TOKENS, FLUSH_TOKENS = 1 << 22, 1 << 21
#: Token lists up to this size are compared pair by pair; longer ones in blocks of about so many tokens in all.
SHORT_LIST, BLOCK_TOKENS = 64, 1 << 20
#: Document ids of at most so many candidates are broadcast to read their texts again.
BROADCAST_IDS = 500_000
#: Sets that a comparing task turns into Python objects at a time.
SETS_AT_A_TIME = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFTS = [np.uint64(k * int(MIX) % (1 << 64)) for k in range(ORDERS)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct codes of the text's word windows; with fewer words, of the whole sequence; none without words."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    code = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * MIX + code[k : len(words) - size + 1 + k]
    total = np.sort(mixed(total))
    return total[np.append(True, total[1:] != total[:-1])]


def set_key(tokens: np.ndarray) -> int | None:
    """A digest that equal sets share; None for an empty one."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def needed(n, percent: int = PERCENT):
    """Least tokens shared with any partner."""
    return -(-percent * n // 100)


def least_overlap(a, b, percent: int = PERCENT):
    """Least tokens that sets of these sizes share when they link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class Orders:
    """Global token orders: rarer level first, then by a scramble that differs from order to order."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels  # sorted 32-bit heads of frequent tokens

    def prefixes(self, tokens: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
        """Of each order the first tokens (the first order's in order); two linked sets share one under every order."""
        level = np.zeros(len(tokens), np.uint64)
        if len(self.tokens):
            head = (tokens >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.tokens, head), len(self.tokens) - 1)
            level = np.where(self.tokens[at] == head, self.levels[at], 0).astype(np.uint64)
        size = len(tokens) - needed(len(tokens), percent) + 1
        out = []
        for k in range(ORDERS):
            rank = (level << np.uint64(56)) | (mixed(tokens + SHIFTS[k]) >> np.uint64(8))
            first = np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
            out.append(tokens[first[np.argsort(rank[first])]] if k == 0 else tokens[first])
        return out


def frequent_tokens(docs: DataFrame, text: str, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit heads and levels (log2 of the document count) of the most frequent tokens, counted over all documents.

    Heads travel sorted and packed, two to four bytes each, and are counted in groups of bounded size.
    """
    bits = max(8, min(24, int(total // GROUP_TOKENS).bit_length() + 1))

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append((shingles(value, width) >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held):
        heads = np.sort(np.concatenate(held))
        group = heads >> np.uint32(32 - bits)
        cuts = np.flatnonzero(np.diff(group)) + 1
        rows = {"part": [], "heads": []}
        for piece in np.split(heads, cuts):
            rows["part"].append(int(piece[0] >> np.uint32(32 - bits)))
            gaps = np.diff(piece, prepend=piece[:1] & ~np.uint32((1 << (32 - bits)) - 1))
            rows["heads"].append(b"2" + gaps.astype(np.uint16).tobytes() if gaps.max() < 1 << 16 else b"4" + gaps.tobytes())
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("heads", pa.binary())]))

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        start = np.uint32(key[0] << (32 - bits))
        heads = np.concatenate([start + np.cumsum(np.frombuffer(h[1:], np.uint16 if h[:1] == b"2" else np.uint32), dtype=np.uint32) for h in group["heads"]])
        values, counts = np.unique(heads, return_counts=True)
        often = counts >= FREQUENT
        levels = np.log2(counts[often]).astype(np.uint8)
        rows = [(int(k), values[often][levels == k]) for k in np.unique(levels)]
        return pd.DataFrame({"level": [r[0] for r in rows], "n": [len(r[1]) for r in rows], "heads": [r[1].tobytes() for r in rows]}).astype({"level": "int32", "n": "int64"})

    heads = docs.select(text).mapInArrow(pack, "part int, heads binary")
    counted = pin(heads.groupBy("part").applyInPandas(count, "level int, n long, heads binary"))
    room, least = FREQUENT_ENTRIES, 64
    for row in counted.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # at most 33 rows
        if row["n"] > room:
            break
        room, least = room - row["n"], row["level"]
    kept = counted.filter(F.col("level") >= least).select("level", "heads").collect()  # bounded by FREQUENT_ENTRIES
    tokens = np.concatenate([np.frombuffer(r["heads"], np.uint32) for r in kept]) if kept else np.empty(0, np.uint32)
    levels = np.concatenate([np.full(len(r["heads"]) // 4, r["level"], np.uint8) for r in kept]) if kept else np.empty(0, np.uint8)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def short_lists(percent: int):
    """Reads postings sorted by token, size and key. Lists of up to SHORT_LIST members give their pairs (kind 0: keys a

    and b) that pass the size and position filters; longer ones pass on member by member (kind 1: token, key, size).
    """
    schema = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def pairs(token, key, n, pos):
        found = []
        for step in range(1, SHORT_LIST):
            same = np.flatnonzero(token[step:] == token[:-step])
            if not len(same):
                break
            i, j = same, same + step
            small, large = n[i], n[j]
            rest = np.minimum(small - pos[i], large - pos[j])
            good = (100 * small >= percent * large) & (rest >= least_overlap(small, large, percent)) & (key[i] != key[j])
            found.append((key[i[good]], key[j[good]]))
        if not found:
            return
        a, b = (np.concatenate(c) for c in zip(*found))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        if both.shape[1]:
            zero = np.zeros(both.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(both[0]), pa.array(both[1])], schema=schema)

    def longer(token, key, n):
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.array(token), pa.array(key), pa.array(n)], schema=schema)

    def run(batches):
        held, streaming = None, None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            token, key = columns[:2]
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1])  # copies met in several tasks
            if again.any():
                columns = [c[~again] for c in columns]
                token, key = columns[:2]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            last = starts[-1]
            size = np.repeat(sizes, sizes)
            is_long = (size > SHORT_LIST) | (token == streaming if streaming is not None else False)
            # The last list may go on in the next batch; it is passed on at once when it is long already.
            wait = np.arange(len(token)) >= last
            if is_long[last]:
                streaming = token[last]
                wait[:] = False
            ready = ~wait
            if (go := ready & is_long).any():
                yield from longer(token[go], key[go], columns[2][go])
            if (go := ready & ~is_long).any():
                yield from pairs(*[c[go] for c in columns])
            held = [c[wait] for c in columns] if wait.any() else None
        if held is not None:
            yield from pairs(*held)

    return run


def block_links(percent: int):
    """Links between a group's members and probes, compared in full: only those that join what was apart leave.

    Rows: key, comp (its component so far), n, tokens, the prefixes of the further orders, member, probe, twice (a member that
    is a probe of another group, too). Two sets are compared when one is a member and one a probe, their components
    differ, their sizes allow a link and their prefixes share a token under each further order.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        roles = group.groupby("key")[["member", "probe"]].max()
        group = group.drop_duplicates("key").drop(columns=["member", "probe"]).join(roles, on="key")
        group = group.sort_values(["n", "key"], kind="stable").reset_index(drop=True)
        key, n = group["key"].to_numpy(), group["n"].to_numpy()
        member, probe, twice = group["member"].to_numpy() > 0, group["probe"].to_numpy() > 0, group["twice"].to_numpy()
        label = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        sets = Ragged([np.frombuffer(t, np.uint64) for t in group["tokens"]])
        orders = [Ragged([np.asarray(h, np.int32) for h in group[f"p{k}"]]) for k in range(1, ORDERS)]
        out: list[tuple[int, int]] = []
        for i in range(len(key) - 1):
            end = np.searchsorted(n, 100 * n[i] // percent, side="right")
            others = np.arange(i + 1, end)
            # Two probes meet as member and probe in two groups; that of the member with the smaller key counts.
            as_member = member[i] & probe[others] & ((twice[i] == 0) | (key[i] < key[others]))
            as_probe = probe[i] & member[others] & ((twice[others] == 0) | (key[others] < key[i]))
            others = others[(label[others] != label[i]) & (as_member | as_probe)]
            for order in orders:
                if len(others):
                    others = others[order.common(i, others) > 0]
            if not len(others):
                continue
            common = sets.common(i, others)
            linked = others[100 * common >= percent * (n[i] + n[others] - common)]
            for k in linked.tolist():
                if label[k] != label[i]:
                    out.append((min(key[i], key[k]), max(key[i], key[k])))
                    label[label == label[k]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


class Ragged:
    """Sets of numbers one after the other; counts what one shares with some others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        distinct, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.numbers[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[others] - np.r_[0, ends[:-1]], sizes)
        total = np.add.reduceat(self.mark[self.numbers[places]], np.r_[0, ends[:-1]])
        self.mark[own] = 0
        return total


def texts_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """doc_id and text of one document of each set; ids are broadcast where they were counted to be few."""
    wanted = pin(classes.join(keys.distinct(), "key", "left_semi").select(F.col("first_id").alias("doc_id")))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("doc_id", text).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def listed_sets(keys: DataFrame, docs: DataFrame, classes: DataFrame, facts: DataFrame, text: str, width: int) -> DataFrame:
    """key, tokens and the further orders' prefixes of the sets that lie in long lists."""

    def make():
        def work(ids, values):
            sets = [shingles(v, width) for v in values]
            return [[set_key(s) for s in sets], [s.tobytes() for s in sets]]

        return work

    sets = by_batch(texts_of(keys, docs, classes, text), "key long, tokens binary", make).filter("key is not null").dropDuplicates(["key"])
    orders = facts.select("key", *[f"p{k}" for k in range(1, ORDERS)]).join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"])
    return sets.join(orders, "key")


def dealt(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among rows (token, key, n, comp, probe) of lists: between probes and all, between probes once.

    Members are cut into blocks, and so are the probes among them; each block of the one meets each of the other in a
    group of bounded size. A row travels as often as the other side has blocks: once for most lists, whose probes fill one block.
    """
    sizes = rows.groupBy("token").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"), F.greatest(F.ceil(F.sum(F.when(F.col("probe"), F.col("n"))) / BLOCK_TOKENS), F.lit(1)).cast("int").alias("probe_blocks"))
    placed = rows.join(sizes, "token").withColumns(
        {"x": F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), "y": F.pmod(F.xxhash64("key", F.lit(1)), F.col("probe_blocks")).cast("int")}
    )
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    same = ["token", "key", "n", "comp", F.col("probe").cast("int").alias("twice")]
    members = placed.select(*same, "x", across("probe_blocks").alias("y"), F.lit(1).alias("member"), F.lit(0).alias("probe"))
    probes = placed.filter("probe").select(*same, across("blocks").alias("x"), "y", F.lit(0).alias("member"), F.lit(1).alias("probe"))
    both = members.unionByName(probes).groupBy("token", "x", "y", "key", "n", "comp", "twice").agg(F.max("member").alias("member"), F.max("probe").alias("probe"))
    return both.join(sets, "key").groupBy("token", "x", "y").applyInPandas(block_links(percent), "a long, b long")


def own_list_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of long lists (token, key, n), each set in its longest list only: there a group of near copies falls together."""
    lengths = lists.groupBy("token").agg(F.count("*").alias("length"))
    own = lists.join(lengths, "token").groupBy("key", "n").agg(F.max_by("token", F.struct("length", "token")).alias("token"))
    return dealt(own.select("token", "key", "n", F.col("key").alias("comp"), F.lit(True).alias("probe")), sets, percent)


def mixed_list_links(lists: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links of long lists between different components: in each list all sets but those of its largest component are probes."""
    rows = lists.join(comps.select(F.col("node").alias("key"), F.col("root").alias("comp")), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    counts = rows.groupBy("token", "comp").agg(F.count("*").alias("size"))
    largest = counts.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("comps")).filter("comps > 1")
    rows = rows.join(largest, "token").withColumn("probe", F.col("comp") != F.col("largest"))
    return dealt(rows.select("token", "key", "n", "comp", "probe"), sets, percent)


def surviving(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs that share a prefix token under each of the further orders, too."""
    orders = [f"p{k}" for k in range(1, ORDERS)]
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    facts = pin(facts.join(keys, "key", "left_semi").select("key", *orders).dropDuplicates(["key"]))  # several tasks may have met a set
    left = facts.select(F.col("key").alias("a"), *[F.col(p).alias(f"{p}_a") for p in orders])
    right = facts.select(F.col("key").alias("b"), *[F.col(p).alias(f"{p}_b") for p in orders])
    joined = pairs.join(left, "a").join(right, "b")
    for p in orders:
        joined = joined.filter(F.arrays_overlap(f"{p}_a", f"{p}_b"))
    return joined.select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The pairs whose sets link, compared in full.

    One document of each set is read again. A set travels once to each pair that needs it; both sets of a pair meet by
    sorting, so a task holds two sets at a time.
    """
    sides = pairs.select(F.col("a").alias("key"), "a", "b").union(pairs.select(F.col("b").alias("key"), "a", "b"))
    texts = texts_of(sides.select("key"), docs, classes, text)

    def make():
        def work(ids, values):
            sets = [shingles(v, width) for v in values]
            return [[set_key(s) for s in sets], [s.tobytes() for s in sets]]

        return work

    sets = by_batch(texts, "key long, tokens binary", make).filter("key is not null")
    meet = sides.join(sets, "key").repartition("a", "b").sortWithinPartitions("a", "b", "key")

    def compare(batches):
        held = None
        for batch in (whole.slice(at, SETS_AT_A_TIME) for whole in batches for at in range(0, whole.num_rows, SETS_AT_A_TIME)):
            a_out, b_out = [], []
            for a, b, key, tokens in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if held and held[:2] == (a, b) and held[2] != key:
                    x, y = np.frombuffer(held[3], np.uint64), np.frombuffer(tokens, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        a_out.append(a)
                        b_out.append(b)
                    held = None
                elif not held or held[:2] != (a, b):
                    held = a, b, key, tokens
            yield pa.RecordBatch.from_pydict({"a": a_out, "b": b_out}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return meet.select("a", "b", "key", "tokens").mapInArrow(compare, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that its links reach).

    Two documents link when 100 * common >= percent * union of their shingle sets; components are those of all links.
    Texts without words (null too) have no shingles and stand alone. Rows without a doc_id link with nothing and have
    no component. Repeated rows give repeated rows, extra columns are ignored, whole texts are read.

    Plan. Equal sets become one class. Tokens are counted over all documents, so that frequent ones come last in every
    order. Classes that share a token of their first prefix are candidates; the size, position, further orders' prefixes
    and then the whole sets decide. Lists of up to SHORT_LIST classes give their pairs. Longer ones never do: their sets
    meet in blocks, where all orders' filters and the whole sets decide, and only links that join something leave. First
    each set is compared in its longest list, which makes one component of a group of near copies; then, in all lists,
    sets of different components. Nothing is capped.
    """

    def make_keys():
        def work(ids, values):
            sets = [shingles(v, width) for v in values]
            return [ids, [len(s) for s in sets], [set_key(s) for s in sets]]

        return work

    keyed = pin(by_batch(docs.select("doc_id", text), "doc_id long, n_shingles long, key long", make_keys))
    docs = docs.filter("doc_id is not null")
    classes = keyed.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, text, width, total))

    def make_prefixes():
        orders, seen = Orders(*shared.value), set()

        def work(values):
            out = []
            for v in values:
                tokens = shingles(v, width)
                key = set_key(tokens)
                if key is not None and key not in seen:  # copies within a task are read once
                    seen.add(key)
                    first, *others = orders.prefixes(tokens, percent)
                    heads = [(p >> np.uint64(32)).astype(np.uint32).view(np.int32) for p in others]  # heads may only let more pass
                    out.append((key, len(tokens), first.view(np.int64), *heads))
            return [list(c) for c in zip(*out)] if out else [[]] * (2 + ORDERS)

        return work

    prefix_fields = ", ".join(f"p{k} array<int>" for k in range(1, ORDERS))
    facts = pin(by_batch(docs.select(text), f"key long, n long, p0 array<long>, {prefix_fields}", make_prefixes))
    postings = facts.select(F.posexplode("p0").alias("pos", "token"), "key", "n").select("token", "key", "n", F.col("pos").cast("long").alias("pos"))
    lists = postings.repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(short_lists(percent), "kind int, token long, a long, b long")
    lists = pin(lists)
    long_lists = lists.filter("kind = 1").select("token", F.col("a").alias("key"), F.col("b").alias("n")).distinct()
    short_pairs = lists.filter("kind = 0").select("a", "b")
    some_long = not long_lists.isEmpty()
    links = pin(verified(pin(surviving(short_pairs.distinct(), facts)), docs, classes, text, width, percent))
    if some_long:
        sets = pin(listed_sets(long_lists.select("key"), docs, classes, facts, text, width))
        links = links.union(pin(own_list_links(long_lists, sets, percent)))
    comps = connected(links)
    if some_long:
        more = pin(mixed_list_links(long_lists, sets, comps, percent))
        if not more.isEmpty():
            comps = connected(comps.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    named = classes.join(comps.withColumnRenamed("node", "key"), "key", "left")
    firsts = named.filter("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    known = named.join(firsts, "root", "left").select("key", F.coalesce("least_id", "first_id").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return keyed.join(known, "key", "left").select("doc_id", "n_shingles", own.alias("component_id"))
