"""Benchmark decontamination by templates, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import BROADCAST_ROWS

WINDOW = 8
#: A window counts with at least so many literal tokens; more than half of any window, so two of them are neighbours.
LEAST_LITERAL = 5
#: A document is contaminated by an item from so many consistent windows on (or all windows of a shorter item).
LEAST_WINDOWS = 3
#: Signs between words that carry no template token.
NOISE = r"[^\p{L}\p{M}\p{N}.,:;!?'/\x20\x09-\x0D-]+"
#: How a document's window meets an item's: by its template, by that of a text's start, or by all its words.
AS_READ, AS_START, SAME_WORDS = range(3)
#: Words of a text that rows are made of together: no row holds more of a text, however long it is.
BLOCK = 128
#: Rows of 64 bits in a broadcast table at most, whatever the size of the benchmark.
SLOTS = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"
EDGES = ".,:;!?'/-"
NUMBER = "^[0-9][0-9.,:/-]*$"
NAME = r"^\p{Lu}\p{Ll}+$"
SENTENCE_END = "[.!?:]$"
NUM, UNIT, PERSON = "<num>", "<unit>", "<name>"
# Units of measure and money that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ton tons tonne tonnes l ml liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres"
).split()


def words_of(text: Column) -> Column:
    """Words of a text without noise signs; a null text has none."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, " "), SPACE), lambda w: w != "")


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGES))


def token(word: Column, before: Column) -> Column:
    """Template token of a word: a typed placeholder for numbers, their units and names, else the word in lower case."""
    plain = bare(word)
    return (
        F.when(plain.rlike(NUMBER), NUM)
        .when(bare(before).rlike(NUMBER) & F.lower(plain).isin(UNITS), UNIT)
        .when(plain.rlike(NAME) & ~before.rlike(SENTENCE_END), PERSON)
        .otherwise(F.lower(plain))
    )


def tokens_from(words: Column, start: Column, size: Column) -> Column:
    """Template tokens of ``size`` words from the zero-based ``start``; the first word of a text starts a sentence."""
    at = lambda k: F.get(words, start + k)
    before = lambda k: F.coalesce(F.get(words, F.when(start + k > 0, start + k - 1)), F.lit("."))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: token(at(k), before(k)))


def literal(t: Column) -> Column:
    return ~t.isin(NUM, UNIT, PERSON) & (t != "")


def said(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(bare(w))), " ")


def pair_key(first: Column, second: Column) -> Column:
    return F.xxhash64(F.lower(bare(first)), F.lower(bare(second)))


def bit_of(digest: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(digest, 6).bitwiseAND(F.lit(SLOTS - 1)), digest.bitwiseAND(F.lit(63)).cast("int")


def maybe(rows: DataFrame, digest: Column, of: DataFrame, known: Column) -> DataFrame:
    """``rows`` whose ``digest`` may be one of the ``known`` ones of ``of``: all that are, and those that share a bit with one.

    The bits are broadcast.
    """
    (group, low), (slot, at) = bit_of(known), bit_of(digest)
    table = of.select(group.alias("_slot"), low.alias("_low")).groupBy("_slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_low"))).alias("_bits"))
    met = rows.select("*", slot.alias("_slot"), at.alias("_at")).join(F.broadcast(table), "_slot").filter(F.getbit("_bits", F.col("_at")) == 1)
    return met.drop("_slot", "_at", "_bits")


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, start, lead and words: BLOCK words from the place ``start`` on, with ``lead`` + 1 words before them ("." stands

    before a text's first word) and WINDOW behind them, as far as there are so many.
    """
    whole = docs.select("doc_id", F.concat(F.array(F.lit(".")), words_of(F.col(text))).alias("words"))
    lead = lambda start: F.least(start, F.lit(WINDOW - 2))
    cut = lambda start: F.struct(start.alias("start"), lead(start).alias("lead"), F.slice("words", start - lead(start) + 1, lead(start) + BLOCK + WINDOW).alias("words"))
    return whole.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0)), F.lit(BLOCK)), cut)))


def benchmark_windows(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, start, size, windows (strong ones of the item), total (all of them), strong, template, words (of the

    window), and an anchor: the key and offset of the longest two neighbouring literal words. A window with too few
    literals for that is not strong: it counts where all its words are the item's, and any two neighbours anchor it.
    """
    worded = items.select("item_id", words_of(F.col(text)).alias("all")).filter(F.size("all") > 0).distinct()
    size = F.least(F.lit(WINDOW), F.size("all"))
    starts = worded.select("item_id", "all", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("all") - size)).alias("start"))
    # Made by a generator, tokens are worked out once: filters below would else hold their expression many times.
    made = starts.select("*", F.explode(F.array(tokens_from(F.col("all"), F.col("start"), F.col("size")))).alias("tokens"))
    literals = F.size(F.filter("tokens", literal))
    enough = literals >= F.when(F.col("size") == WINDOW, LEAST_LITERAL).otherwise(F.floor(F.col("size") / 2) + 1)
    first, second = lambda k: F.get("tokens", k), lambda k: F.get("tokens", k + 1)
    sites = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.col("size") - 2, F.lit(0))), lambda k: literal(first(k)) & literal(F.coalesce(second(k), F.lit("")))),
        lambda k: F.struct((F.length(first(k)) + F.length(second(k))).alias("chars"), (-k).alias("back")),
    )
    word = lambda k: F.length(bare(F.coalesce(F.get("all", F.col("start") + k), F.lit(""))))
    any_two = F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - 2, F.lit(0))), lambda k: F.struct((word(k) + word(k + 1)).alias("chars"), (-k).alias("back")))
    made = made.withColumn("site", F.array_max(sites)).withColumn("strong", enough & F.col("site").isNotNull()).filter("strong or size > 1")
    made = made.withColumn("anchor", F.when(F.col("strong"), F.col("site")).otherwise(F.array_max(any_two))).withColumn("offset", -F.col("anchor.back"))
    words = F.slice("all", F.col("start") + 1, F.col("size"))
    kept = made.select(
        "item_id", "start", "size", "strong", F.array_join("tokens", " ").alias("template"), "tokens", words.alias("item_words"), "offset",
        pair_key(F.get("all", F.col("start") + F.col("offset")), F.when(F.col("size") > 1, F.get("all", F.col("start") + F.col("offset") + 1))).alias("key"),
    ).persist()
    totals = kept.groupBy("item_id").agg(F.sum(F.col("strong").cast("long")).alias("windows"), F.count("*").alias("total"))
    return kept.join(totals, "item_id")


def few(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast where it was counted to be small, as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, n_item_windows, n_slots, n_changed.

    Numbers, units after numbers and names inside sentences become typed placeholders. Windows of eight template tokens
    are hash-joined between documents and items; those of one alignment (document position minus item position) count
    together, and their slots must be consistent: one value of the item always stands for the same value in the
    document. n_changed counts the slots with another value than the item's, over zero in re-parameterised questions.
    The best alignment of a document and an item is reported.

    Pairs that this doesn't find are looked at again with all windows: those with few literals count where their words are
    the item's, and an item's first window also where the document's first word is read without its left neighbour.

    Null and empty texts match nothing; repeated documents count as one where they have the same doc_id; null ids are
    kept as an id of their own; extra columns are ignored. Items with fewer words than a window match as a whole.

    A document's windows are not all built. Texts are cut into blocks, and only places whose two words anchor a window of the
    benchmark go on, then only windows whose template is one of its. Broadcast bits tell which may be (``maybe``); what they let
    through in vain the join by template drops. No row holds more of a text than a block. Windows of the benchmark are broadcast
    where they were counted to be few and shuffled otherwise.
    """
    windows = benchmark_windows(items).persist()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    placed = blocks(docs, text)
    placed = placed.select("doc_id", "start", "lead", "words", F.posexplode(F.slice("words", F.col("lead") + 2, F.lit(BLOCK))).alias("nth", "word"))
    key = pair_key(F.col("word"), F.coalesce(F.get("words", F.col("lead") + F.col("nth") + 2), F.lit("")))
    placed = maybe(placed.select("doc_id", "start", "lead", "words", "nth", key.alias("key")), F.col("key"), windows, F.col("key"))
    places = [F.struct(F.lit(size).alias("size"), F.lit(offset).alias("offset")) for size in sizes for offset in range(size - 1)]
    placed = placed.select("*", F.inline(F.array(*places) if places else F.lit(None).cast("array<struct<size:int,offset:int>>")))
    met = maybe(placed, F.xxhash64("key", "size", "offset"), windows, F.xxhash64("key", "size", "offset"))
    # The window's words and the one before them.
    before = F.greatest(F.col("lead") + F.col("nth") - F.col("offset") + 1, F.lit(1))
    met = met.select("doc_id", (F.col("start") + F.col("nth") - F.col("offset")).alias("at"), "size", F.slice("words", before, F.col("size") + 1).alias("around"))
    met = met.filter((F.col("at") >= 0) & (F.size("around") > F.col("size")))
    met = met.select(
        "doc_id", "at", F.slice("around", 2, WINDOW).alias("doc_words"),
        F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: token(F.get("around", k + 1), F.get("around", k))).alias("doc_tokens"),
    )
    fresh = F.concat(F.array(token(F.get("doc_words", F.lit(0)), F.lit("."))), F.slice("doc_tokens", 2, WINDOW))
    probe = lambda sort, text: F.struct(F.lit(sort).alias("sort"), text.alias("template"))
    probes = F.array(probe(AS_READ, F.array_join("doc_tokens", " ")), probe(AS_START, F.array_join(fresh, " ")), probe(SAME_WORDS, said(F.col("doc_words"))))
    met = met.select("doc_id", "at", "doc_words", F.inline(probes))
    facts = windows.select("item_id", "start", "windows", "total", "tokens", "item_words", F.inline(F.filter(F.array(
        F.when(F.col("strong"), probe(AS_READ, F.col("template"))),
        F.when(F.col("strong") & (F.col("start") == 0), probe(AS_START, F.col("template"))),
        F.when(~F.col("strong"), probe(SAME_WORDS, said(F.col("item_words")))),
    ), lambda p: p.isNotNull())))
    met = maybe(met, F.xxhash64("sort", "template"), facts, F.xxhash64("sort", "template")).distinct()
    joined = met.join(few(facts), ["sort", "template"])
    slots = F.filter(
        F.transform(F.arrays_zip("tokens", "item_words", "doc_words"), lambda z: F.struct(
            z["tokens"].alias("kind"), F.lower(bare(z["item_words"])).alias("was"), F.lower(bare(z["doc_words"])).alias("now"))),
        lambda s: s["kind"].isin(NUM, UNIT, PERSON),
    )
    joined = joined.select("doc_id", "item_id", (F.col("at") - F.col("start")).alias("shift"), "windows", "total", "start", "sort", F.explode(F.array(slots)).alias("slots"))
    first = F.col("sort") == AS_READ
    gathered = lambda rows: F.array_distinct(F.flatten(F.collect_set(rows)))
    shifts = joined.groupBy("doc_id", "item_id", "shift", "windows", "total").agg(
        F.count(F.when(first, 1)).alias("n_read"), gathered(F.when(first, F.col("slots"))).alias("read_slots"),
        F.size(F.collect_set("start")).cast("long").alias("n_every"), gathered(F.col("slots")).alias("every_slots"),
    )

    def judged(n: str, of: str, slots: str) -> Column:
        sources = F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["was"]))))
        changed = F.size(F.filter(slots, lambda s: s["was"] != s["now"]))
        found = F.struct(F.lit(n == "n_read").alias("read"), F.col(n).alias("n_windows"), F.col(of).alias("windows"), F.size(slots).alias("n_slots"), changed.alias("n_changed"), (-F.col("shift")).alias("order"))
        return F.when((F.col(n) > 0) & (sources == F.size(slots)) & (F.col(n) >= F.least(F.lit(LEAST_WINDOWS), F.col(of))), found)

    best = shifts.withColumn("best", F.coalesce(judged("n_read", "windows", "read_slots"), judged("n_every", "total", "every_slots"))).filter("best is not null")
    best = best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", "best.n_windows", F.col("best.windows").alias("n_item_windows"),
        F.col("best.n_slots").cast("long").alias("n_slots"), F.col("best.n_changed").cast("long").alias("n_changed"),
    )
