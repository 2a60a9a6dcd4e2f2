"""Keyed joins with their contracts checked, set lookups and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.functions.text import normalize_colname, normalize_lot_id
from yieldloom.operators.contracts import ContractError, duplicate_keys, require_empty
from yieldloom.plans import measured


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join whose keys are unique on both sides."""
    for side, name in ((left, "left"), (right, "right")):
        require_empty(duplicate_keys(side, keys), f"{name} side repeats join keys")
    return left.join(right, list(keys))


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join whose keys are unique on the right; Spark broadcasts it when it is small enough."""
    require_empty(duplicate_keys(right, keys), "right side repeats join keys")
    return left.join(right, list(keys))


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti").select(*keys).distinct()


def join_label_complete(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one inner join in which every label must find its features."""
    require_empty(unmatched_keys(labels, features, keys), "labels without features")
    return join_one_to_one(features, labels, keys)


def join_folds_left(reference: DataFrame, folds: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Left join of fold numbers; a row without one is an error."""
    require_empty(duplicate_keys(reference, keys), "reference repeats keys")
    out = reference.join(folds.select(*keys, fold).dropDuplicates(list(keys)), list(keys), "left")
    require_empty(out.filter(F.col(fold).isNull()).select(*keys), "rows without a fold")
    return out


def align_probability(reference: DataFrame, source: DataFrame, column: str, keys: Sequence[str] = ("lot", "wafer")) -> DataFrame:
    """Left join of a score onto reference keys; gaps stay NULL, repeated source keys are an error."""
    require_empty(duplicate_keys(source, keys), "score source repeats keys")
    require_empty(source.filter(F.abs(column) == float("inf")).select(*keys), "scores contain infinite values")
    out = reference.join(source.select(*keys, column), list(keys), "left")
    if out.filter(F.col(column).isNotNull()).isEmpty():
        raise ContractError("no score aligns to the reference")
    return out


def probe_final_join(probe: DataFrame, final: DataFrame, key: str = "parent_folder") -> DataFrame:
    """Lot features of both stages side by side, prefixed TP_ and FT_."""
    named = lambda df, p: df.select(key, *[F.col(c).alias(p + c) for c in df.columns if c != key])
    return named(probe, "TP_").join(named(final, "FT_"), key)


def file_prefix(name: Column) -> Column:
    """Upper-cased part of a file name before its probe or final-test marker."""
    return F.split(F.upper(name), "_PRB_|_FIN_")[0]


def match_final_test_file(probe: DataFrame, final: DataFrame) -> DataFrame:
    """Final-test file of each probe file: same name prefix, else same lot, else same bare lot id.

    Both sides carry (filename, lot_id). Each rule keeps the first file name per key.
    """
    firsts = lambda key: final.groupBy(key.alias("_key")).agg(F.min("filename").alias("_hit"))
    out = probe
    rules = (file_prefix(F.col("filename")), F.col("lot_id"), normalize_lot_id(F.col("lot_id")))
    for i, rule in enumerate(rules):
        found = firsts(rule).withColumnRenamed("_key", f"_key{i}").withColumnRenamed("_hit", f"_hit{i}")
        out = out.withColumn(f"_own{i}", rule).join(found, F.col(f"_own{i}") == F.col(f"_key{i}"), "left")
    return out.select(*probe.columns, F.coalesce("_hit0", "_hit1", "_hit2").alias("final_filename"))


def matched_keys(stages: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys present in every stage."""
    first, *rest = [stage.select(*keys).distinct() for stage in stages]
    return reduce(lambda a, b: a.join(b, list(keys), "left_semi"), rest, first)


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is absent from the new batch, plus the batch."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def limit_lookup(tests: DataFrame, limits: DataFrame, test: str = "test_id") -> DataFrame:
    """Adds (lsl, usl) by exact test id, else by normalised name; of several rows the least (id, lsl, usl) counts.

    Both tables have one row per name and are counted, so that tests are shuffled only for very long lists of limits.
    """
    least = F.min(F.struct(F.col(test).alias("id"), "lsl", "usl"))
    exact = limits.groupBy(F.col(test).alias("_test")).agg(least.alias("_e"))
    loose = limits.groupBy(normalize_colname(F.col(test)).alias("_norm")).agg(least.alias("_n"))
    exact = measured(exact.select("_test", F.col("_e.lsl").alias("_l0"), F.col("_e.usl").alias("_u0"), F.lit(True).alias("_hit")))
    loose = measured(loose.select("_norm", F.col("_n.lsl").alias("_l1"), F.col("_n.usl").alias("_u1")))
    out = tests.join(exact, F.col(test) == F.col("_test"), "left")
    out = out.join(loose, normalize_colname(F.col(test)) == F.col("_norm"), "left")
    pick = lambda a, b: F.when(F.col("_hit"), F.col(a)).otherwise(F.col(b))
    return out.select(*tests.columns, pick("_l0", "_l1").alias("lsl"), pick("_u0", "_u1").alias("usl"))


def current_test_mapping(columns: DataFrame, known: DataFrame, limit_keys: DataFrame, *, column: str = "column", exact: str = "test_id", limit: str = "limit_key") -> DataFrame:
    """Maps current column names to known test ids: exact, then normalised, then limit-key prefix.

    Prefix pairs are found by equality on every prefix of the longer name, so no
    name meets a name it does not start with.
    """
    norm = columns.select(column, normalize_colname(F.col(column)).alias("_norm")).distinct()
    by_name = known.groupBy(F.col("name").alias("_name")).agg(F.min(exact).alias("_exact"))
    by_norm = known.groupBy(normalize_colname(F.col(exact)).alias("_nk")).agg(F.min(exact).alias("_loose"))
    keys = limit_keys.select(F.col(limit).alias("_limit"), normalize_colname(F.col(limit)).alias("_lnorm")).distinct()
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(c, F.lit(1), n)))
    forward = norm.select(column, prefixes(F.col("_norm")).alias("_p")).join(keys, F.col("_p") == F.col("_lnorm"))
    backward = keys.select("_limit", prefixes(F.col("_lnorm")).alias("_p")).join(norm, F.col("_p") == F.col("_norm"))
    prefix = forward.select(column, "_limit").unionByName(backward.select(column, "_limit"))
    prefix = prefix.groupBy(F.col(column).alias("_pc")).agg(F.min("_limit").alias("_prefix"))
    out = norm.join(by_name, F.col(column) == F.col("_name"), "left")
    out = out.join(by_norm, F.col("_norm") == F.col("_nk"), "left").join(prefix, F.col(column) == F.col("_pc"), "left")
    return out.select(column, F.coalesce("_exact", "_loose", "_prefix", "_norm").alias("test_id"))


def golden_overlap(candidate: DataFrame, golden: DataFrame, test: str = "test_id") -> DataFrame:
    """Candidate and golden statistics of the tests both have."""
    gold = golden.select(test, F.col("mean").alias("golden_mean"), F.col("std").alias("golden_std"))
    return candidate.join(gold, test)


def golden_fallback(golden: DataFrame, current: DataFrame, actual: DataFrame, test: str = "test_id") -> DataFrame:
    """Per golden test: current statistics, else actual ones, else the golden ones."""
    side = lambda df, p: df.select(test, F.col("mean").alias(p + "_mean"), F.col("std").alias(p + "_std"))
    out = side(golden, "golden").join(side(current, "_c"), test, "left").join(side(actual, "_a"), test, "left")
    pick = lambda s: F.coalesce(f"_c_{s}", f"_a_{s}", f"golden_{s}").alias(s)
    return out.select(test, "golden_mean", "golden_std", pick("mean"), pick("std"))


def positional_align_check(left: DataFrame, right: DataFrame, time: str = "time") -> DataFrame:
    """Row and mismatch counts of two sequences that must share their times one to one."""
    counts = lambda df, n: df.groupBy(time).agg(F.count(F.lit(1)).alias(n))
    both = counts(left, "_l").join(counts(right, "_r"), time, "full_outer")
    l, r = F.coalesce("_l", F.lit(0)), F.coalesce("_r", F.lit(0))
    return both.agg(
        F.sum(l).alias("left_rows"), F.sum(r).alias("right_rows"),
        F.sum(F.abs(l - r)).alias("unaligned_rows"), F.sum(F.greatest(l - 1, F.lit(0))).alias("repeated_left_times"),
    )


def align_trace_to_features(traces: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traces of the feature keys; a feature key without a trace is an error."""
    require_empty(unmatched_keys(features, traces, keys), "feature keys without traces")
    return traces.join(features.select(*keys).distinct(), list(keys), "left_semi")


def verify_label_identity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("lot", "wafer"), tolerance: float = 1e-12) -> DataFrame:
    """How many common keys disagree on response or class."""
    side = lambda df, n: df.select(*keys, F.col("response").alias(n + "r"), F.col("class").alias(n + "c"))
    both = side(a, "a").join(side(b, "b"), list(keys))
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.abs(F.col("ar") - F.col("br")) > tolerance).alias("response_mismatches"),
        F.count_if(~F.col("ac").eqNullSafe(F.col("bc"))).alias("class_mismatches"),
    )


def key_number_dataset(first: DataFrame, second: DataFrame, labels: DataFrame, features: DataFrame, keys: Sequence[str] = ("lot", "wafer"), prefix: str = "KN", expected: int = 50) -> DataFrame:
    """Two expert tables and labels, one row per key, limited to the engineered feature keys."""
    tables = [t.dropDuplicates(list(keys)) for t in (first, second)]
    joined = tables[0].join(tables[1], list(keys)).join(labels.dropDuplicates(list(keys)), list(keys))
    found = [c for c in joined.columns if c.startswith(prefix)]
    if len(found) != expected:
        raise ContractError(f"expected {expected} {prefix} columns, found {len(found)}")
    return joined.join(features.select(*keys).distinct(), list(keys), "left_semi")


def table_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """One row per compared column: rows on each side, mismatches and the largest absolute difference."""
    columns = [c for c in before.columns if c in after.columns and c not in keys]
    numeric = {f.name for f in before.schema.fields if isinstance(f.dataType, T.NumericType)}
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in columns], F.lit(True).alias(p + "_in"))
    both = side(before, "b_").join(side(after, "a_"), list(keys), "full_outer")
    matched = F.col("b__in") & F.col("a__in")
    aggs: list[Column] = [F.count("b__in").alias("_before"), F.count("a__in").alias("_after"), F.count_if(matched).alias("_both")]
    for c in columns:
        b, a = F.col("b_" + c), F.col("a_" + c)
        if c in numeric:
            gap = F.abs(a.cast("double") - b.cast("double"))
            close = (b.isNull() & a.isNull()) | F.coalesce(gap <= atol + rtol * F.abs(a), F.lit(False))
            aggs.append(F.max(F.when(matched, gap)).alias("d_" + c))
        else:
            close = a.eqNullSafe(b)
            aggs.append(F.max(F.lit(None).cast("double")).alias("d_" + c))
        aggs.append(F.count_if(matched & ~close).alias("m_" + c))
    one = both.agg(*aggs)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col("m_" + c).alias("mismatches"), F.col("d_" + c).alias("max_abs_diff")) for c in columns]
    )
    flat = one.select("_before", "_after", "_both", F.explode(entries).alias("e"))
    return flat.select(
        "e.column", F.col("_before").alias("rows_before"), F.col("_after").alias("rows_after"),
        F.col("_both").alias("rows_matched"), "e.mismatches", "e.max_abs_diff",
        ((F.col("_before") == F.col("_after")) & (F.col("_both") == F.col("_after")) & (F.col("e.mismatches") == 0)).alias("equal"),
    )


def resolve_limits(wafers: DataFrame, candidates: DataFrame) -> DataFrame:
    """One limit file per wafer: its own lot's file beats the product's shared file; no other product counts.

    ``wafers`` has (product, lot), ``candidates`` has (product, lot or NULL, limit_file).
    """
    own = candidates.filter("lot IS NOT NULL").groupBy("product", "lot").agg(F.min("limit_file").alias("_own"))
    shared = candidates.filter("lot IS NULL").groupBy("product").agg(F.min("limit_file").alias("_shared"))
    joined = wafers.join(measured(own), ["product", "lot"], "left").join(measured(shared), "product", "left")
    return joined.select("product", "lot", *[c for c in wafers.columns if c not in ("product", "lot")], F.coalesce("_own", "_shared").alias("limit_file"))
