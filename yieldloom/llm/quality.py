"""Quality rules on documents, tightened by the verdict on their host."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import by_batch, measured_join, pin

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A host is bad when its shrunk rate of failing documents reaches this.
BAD_HOST = 0.5
#: In a bad host a document is also rejected beyond these percentages: symbols of word characters, repeated words of words, repeated lines of words.
STRICT_SYMBOLS, STRICT_REPEATED, STRICT_LINES = 5, 10, 10
#: Weight of the prior, in documents, where hosts don't differ enough to estimate one; never more than the upper bound.
WEAKEST, STRONGEST = 2.0, 10_000.0
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more. Exact: windows get dense ranks by doubling."""
    n = len(words)
    if n <= width:
        return 0
    number: dict = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = 1
    while size < width:
        step = min(size, width - size)
        code = np.unique(code[: len(code) - step] * (int(code.max()) + 1) + code[step:], return_inverse=True)[1]
        size += step
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all zero for a null one."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8").split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def host_rates(rules: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, n_failed and the failure rate shrunk by a beta prior fitted to all hosts by moments.

    The prior's mean is the mean of the hosts' rates; its weight follows from how much more they vary than chance
    alone explains. Sums run over hosts, each already one row. Null hosts form one host.
    """
    hosts = rules.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"), F.avg(1 / F.col("n_docs")).alias("chance")
    )
    between = F.col("mean") * (1 - F.col("mean"))
    real = F.col("spread") - F.col("chance") * between
    weight = F.when(real > 0, F.least(F.greatest(between / real - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
    prior = F.broadcast(moments.select("mean", weight.alias("weight")))  # one row
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.crossJoin(prior).select(host, "n_docs", "n_failed", shrunk.alias("host_rate"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, host_rate, host_bad, kept.

    Rule failures are counted by host and shrunk towards the prior; the host's verdict comes back to each document:
    in a bad host a document must also pass stricter limits on symbols, repeated windows and repeated lines. So a
    clean document is never lost for its neighbours' sake. A null or empty text has no words and fails. Null hosts
    count as one host. Repeated rows each count and each return. Other columns are ignored.

    Hosts are summed before they are shuffled; verdicts are broadcast when counted to be few and salted otherwise,
    so a host with a third of the rows is not one task. The measures are kept by a checkpoint between the two uses.
    """

    def make():
        return lambda ids, hosts, texts: [ids, hosts, *map(list, zip(*map(measure, texts)))] if ids else [ids, hosts, [], [], [], [], []]

    measured = by_batch(docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text), f"doc_id long, host string, {MEASURES}", make)
    rules = pin(measured.withColumn("base_failed", base_failed()))
    joined = measured_join(rules, host_rates(rules, "host").select("host", "host_rate"), "host")
    bad = F.coalesce(F.col("host_rate") >= BAD_HOST, F.lit(False))
    strict = (
        (100 * F.col("n_symbols") > STRICT_SYMBOLS * F.col("word_chars"))
        | (100 * F.col("n_repeat_words") > STRICT_REPEATED * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > STRICT_LINES * F.col("n_words"))
    )
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_rate", bad.alias("host_bad"), (~F.col("base_failed") & ~(bad & strict)).alias("kept"),
    )
