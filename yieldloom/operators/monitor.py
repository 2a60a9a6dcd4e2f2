"""Drift monitoring: population stability, control limits, capability, leave-one-lot-out stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.grades import cpk
from yieldloom.plans import group_stats, measured, running_totals

BINS = 10
EMPTY_SHARE = 1e-4


def _edge(low: Column, high: Column, i: int, bins: int) -> Column:
    return low + i * ((high - low) / bins)


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; edges belong to the upper bin, the maximum to the last."""
    return sum(((v >= _edge(low, high, i, bins)).cast("int") for i in range(1, bins)), F.lit(0))


def _psi_terms(current: Sequence[Column], baseline: Sequence[Column], n_current: Column, n_baseline: Column) -> Column:
    """Sum of (c - b) ln(c / b) over bins, an empty bin counting as a share of 1e-4."""
    total = F.lit(0.0)
    for c, b in zip(current, baseline):
        cs = F.when(c == 0, EMPTY_SHARE).otherwise(c / n_current)
        bs = F.when(b == 0, EMPTY_SHARE).otherwise(b / n_baseline)
        total = total + (cs - bs) * F.ln(cs / bs)
    return total


def psi_status(score: Column) -> Column:
    return F.when(score > 0.25, "Major Shift").when(score >= 0.10, "Minor Shift").otherwise("Normal")


def _flags(score: Column) -> list[Column]:
    is_minor = F.when(score.isNotNull(), F.when(score >= 0.10, 1.0).otherwise(0.0))
    is_major = F.when(score.isNotNull(), F.when(score > 0.25, 1.0).otherwise(0.0))
    return [is_minor.alias("is_minor"), is_major.alias("is_major")]


def psi(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("test_id",), value: str = "value", *, bins: int = BINS, min_baseline: int = 5) -> DataFrame:
    """Population stability index of each key against a pooled baseline.

    Bins span the joint minimum and maximum; all counts are mergeable sums, so
    the shuffle carries at most ``2 * bins`` numbers per key and task.
    """
    side = lambda df, c: df.select(*keys, F.col(value).alias("_v"), F.lit(c).alias("_cur")).filter("_v IS NOT NULL")
    rows = side(current, True).unionByName(side(baseline, False))
    span = measured(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    slot = _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
    binned = rows.join(span, list(keys)).withColumn("_b", slot)
    count = lambda cond: F.count_if(cond)
    aggs = [count(F.col("_cur")).alias("_nc"), count(~F.col("_cur")).alias("_nb"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")]
    aggs += [count(F.col("_cur") & (F.col("_b") == i)).alias(f"_c{i}") for i in range(bins)]
    aggs += [count(~F.col("_cur") & (F.col("_b") == i)).alias(f"_b{i}") for i in range(bins)]
    counts = binned.groupBy(*keys).agg(*aggs)
    terms = _psi_terms([F.col(f"_c{i}") for i in range(bins)], [F.col(f"_b{i}") for i in range(bins)], F.col("_nc"), F.col("_nb"))
    usable = (F.col("_nc") > 0) & (F.col("_nb") >= min_baseline)
    score = F.when(usable, F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(terms))
    return counts.withColumn("psi", score).select(*keys, "psi", *_flags(F.col("psi")))


def psi_pairwise_min(current: DataFrame, history: DataFrame, *, lot: str = "lot", test: str = "test_id", value: str = "value", bins: int = BINS, hot_rows: int | None = None) -> DataFrame:
    """Smallest PSI of the current rows against each historical lot.

    Each (lot, test) has its own bin edges. Current rows are not repeated per
    lot: edges and values are merged in one ordered running count per test.
    """
    cur = current.filter(F.col(value).isNotNull())
    hist = history.filter(F.col(value).isNotNull())
    cur_span = cur.groupBy(test).agg(F.min(value).alias("_clo"), F.max(value).alias("_chi"), F.count(F.lit(1)).alias("_nc"))
    spans = hist.groupBy(lot, test).agg(F.min(value).alias("_hlo"), F.max(value).alias("_hhi"), F.count(F.lit(1)).alias("_nh"))
    spans = spans.join(cur_span, test).select(
        lot, test, "_nc", "_nh", F.least("_hlo", "_clo").alias("_lo"), F.greatest("_hhi", "_chi").alias("_hi")
    )
    spans = measured(spans)
    own = hist.join(spans, [lot, test]).withColumn("_b", _bin(F.col(value), F.col("_lo"), F.col("_hi"), bins))
    own = own.groupBy(lot, test).agg(*[F.count_if(F.col("_b") == i).alias(f"_h{i}") for i in range(bins)])

    inner = [F.struct(F.lit(i).alias("i"), _edge(F.col("_lo"), F.col("_hi"), i, bins).alias("at")) for i in range(1, bins)]
    edges = spans.select(lot, test, F.explode(F.array(*inner)).alias("_e"))
    # Equal positions sort edges first, so the running count holds the values strictly below the edge.
    edge_rows = edges.select(
        test, F.col("_e.at").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_w"), F.col(lot).alias("_lot"), F.col("_e.i").alias("_i")
    )
    value_rows = cur.groupBy(test, F.col(value).alias("_at")).agg(F.count(F.lit(1)).alias("_w")).select(
        test, "_at", F.lit(1).alias("_kind"), "_w", F.lit(None).cast(history.schema[lot].dataType).alias("_lot"), F.lit(None).cast("int").alias("_i")
    )
    ladder = running_totals(
        edge_rows.unionByName(value_rows), [test], ["_at", "_kind"], {"_below": F.col("_w")}, hot_rows=hot_rows
    )
    below = ladder.filter("_kind = 0").groupBy(F.col("_lot").alias(lot), test).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_below"))).alias(f"_u{i}") for i in range(1, bins)]
    )
    joined = spans.join(own, [lot, test]).join(below, [lot, test])
    upto = [F.lit(0), *[F.col(f"_u{i}") for i in range(1, bins)], F.col("_nc")]
    cur_counts = [upto[i + 1] - upto[i] for i in range(bins)]
    terms = _psi_terms(cur_counts, [F.col(f"_h{i}") for i in range(bins)], F.col("_nc"), F.col("_nh"))
    scored = joined.select(test, F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(terms).alias("_psi"))
    out = scored.groupBy(test).agg(F.min("_psi").alias("psi"), F.count(F.lit(1)).alias("lots"))
    return out.withColumn("psi_status", psi_status(F.col("psi")))


def _moments(df: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias(prefix + "n"), F.avg(v).alias(prefix + "mean"), F.stddev_samp(v).alias(prefix + "std")
    )


def _spc_columns(n_cur: Column, cur_mean: Column, n_base: Column, mean: Column, std: Column) -> dict[str, Column]:
    """Control limits and shift; all NULL without data, only centre and current mean when sigma vanishes."""
    usable = (n_cur > 0) & (n_base >= 5)
    spread = usable & (std > 1e-12)
    shift = F.when(spread, F.abs(cur_mean - mean) / std)
    outside = (cur_mean > mean + 3 * std) | (cur_mean < mean - 3 * std)
    return {
        "cl": F.when(usable, mean),
        "ucl": F.when(spread, mean + 3 * std),
        "lcl": F.when(spread, mean - 3 * std),
        "current_mean": F.when(usable, cur_mean),
        "mean_shift": shift,
        "is_shift": F.when(spread, F.when(outside, 1.0).otherwise(0.0)),
    }


def spc_mean_shift(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("test_id",), value: str = "value") -> DataFrame:
    """Three-sigma limits of the baseline and whether the current mean lies outside."""
    both = _moments(current, keys, value, "_c").join(_moments(baseline, keys, value, "_b"), list(keys))
    rules = _spc_columns(F.col("_cn"), F.col("_cmean"), F.col("_bn"), F.col("_bmean"), F.coalesce(F.col("_bstd"), F.lit(0.0)))
    return both.select(*keys, *[c.alias(n) for n, c in rules.items()])


def spc_median_shift(current: DataFrame, history: DataFrame, keys: Sequence[str] = ("test_id",), value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Shifted when the medians differ by more than 1.5 historical IQR."""
    cur = group_stats(current, keys, value, [], {"current_median": 0.5}, hot_rows=hot_rows)
    past = group_stats(history, keys, value, [], {"_q25": 0.25, "history_median": 0.5, "_q75": 0.75}, hot_rows=hot_rows)
    iqr = F.col("_q75") - F.col("_q25")
    gap = F.abs(F.col("current_median") - F.col("history_median"))
    shifted = F.coalesce((iqr > 0) & (gap > 1.5 * iqr), F.lit(False))
    out = cur.join(past, list(keys)).withColumns({"history_iqr": iqr, "spc_shift": shifted})
    return out.select(*keys, "current_median", "history_median", "history_iqr", "spc_shift")


def ft_z_alert(current: DataFrame, history: DataFrame, keys: Sequence[str] = ("test_id",), value: str = "value") -> DataFrame:
    """Mean deviation in historical sigmas, alerting above two."""
    both = _moments(current, keys, value, "_c").join(_moments(history, keys, value, "_h"), list(keys))
    deviation = F.when(F.col("_hstd") > 0, F.abs(F.col("_cmean") - F.col("_hmean")) / F.col("_hstd"))
    out = both.withColumn("ft_deviation", F.coalesce(deviation, F.lit(0.0)))
    return out.select(*keys, "ft_deviation", (F.col("ft_deviation") > 2).alias("ft_alert"))


def shift_summary(current: DataFrame, history: DataFrame, limits: DataFrame, *, lot: str = "lot", test: str = "test_id", value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Per test common to both: PSI, both shift rules, mean, std and Cpk of current and history.

    Row order for display is ``operators.sets.severity_sort``.
    """
    moments = _moments(current, [test], value, "current_").join(_moments(history, [test], value, "history_"), test)
    out = moments.join(limits.select(test, "lsl", "usl"), test, "left")
    out = out.join(psi_pairwise_min(current, history, lot=lot, test=test, value=value, hot_rows=hot_rows), test, "left")
    out = out.join(spc_median_shift(current, history, [test], value, hot_rows).select(test, "spc_shift"), test, "left")
    sigma = F.col("history_std")
    deviation = F.coalesce(F.when(sigma > 0, F.abs(F.col("current_mean") - F.col("history_mean")) / sigma), F.lit(0.0))
    return out.select(
        test, "lsl", "usl", "psi", "psi_status", "spc_shift",
        deviation.alias("ft_deviation"), (deviation > 2).alias("ft_alert"),
        "current_mean", "current_std", cpk(F.col("current_mean"), F.col("current_std"), F.col("lsl"), F.col("usl")).alias("current_cpk"),
        "history_mean", "history_std", cpk(F.col("history_mean"), F.col("history_std"), F.col("lsl"), F.col("usl")).alias("history_cpk"),
    )


def distribution_shift(current: DataFrame, history: DataFrame, limits: DataFrame, selected_lots: DataFrame | None = None, *, lot: str = "lot", test: str = "test_id", value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """The whole current-versus-history analysis over the selected historical lots."""
    if selected_lots is not None:
        history = history.join(selected_lots.select(lot), lot, "left_semi")
    return shift_summary(current, history, limits, lot=lot, test=test, value=value, hot_rows=hot_rows)


def leave_one_out_baseline(df: DataFrame, *, lot: str = "lot", test: str = "test_id", value: str = "value") -> DataFrame:
    """Count, mean and std of every test over all lots but one, as totals minus the lot's own sums.

    Sums are taken around the test's overall mean, which keeps the subtraction accurate.
    """
    known = df.filter(F.col(value).isNotNull())
    centre = measured(known.groupBy(test).agg(F.avg(value).alias("_centre")))
    d = F.col(value) - F.col("_centre")
    own = known.join(centre, test).groupBy(test, lot).agg(F.count(F.lit(1)).alias("_n"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q"))
    total = own.groupBy(test).agg(*[F.sum(c).alias("_t" + c) for c in ("_n", "_s", "_q")])
    joined = own.join(total, test).join(centre, test)
    n, s, q = (F.col("_t" + c) - F.col(c) for c in ("_n", "_s", "_q"))
    mean = F.col("_centre") + s / F.when(n > 0, n)
    variance = (q - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1)
    std = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return joined.select(lot, test, n.alias("baseline_n"), F.when(n > 0, mean).alias("baseline_mean"), F.when(n > 1, std).alias("baseline_std"))


def lot_stability(df: DataFrame, *, lot: str = "lot", test: str = "test_id", value: str = "value", bins: int = BINS, min_lots: int = 5) -> DataFrame:
    """SPC and PSI of every lot against all other lots.

    The baseline of a lot is the total minus its own share, and because baseline
    plus lot is always everything, the PSI edges are the same for all lots of a
    test. Rows are touched twice: for the span, then for one count per
    (test, lot, bin). Fewer than ``min_lots`` lots give no rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(lot, test, F.col(value).alias("_v"))
    span = measured(known.groupBy(test).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("_centre")))
    d = F.col("_v") - F.col("_centre")
    slot = _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
    rows = known.join(span, test).withColumns({"_d": d, "_b": slot})
    own = rows.groupBy(test, lot).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q"),
        *[F.count_if(F.col("_b") == i).alias(f"_o{i}") for i in range(bins)],
    )
    sums = ["_n", "_s", "_q", *[f"_o{i}" for i in range(bins)]]
    total = own.groupBy(test).agg(*[F.sum(c).alias("_t" + c) for c in sums], F.count(F.lit(1)).alias("_present"))
    lots = own.select(lot).distinct().agg(F.count(F.lit(1)).alias("_lots"))
    common = total.crossJoin(F.broadcast(lots)).filter(  # one row
        (F.col("_lots") >= min_lots) & (F.col("_present") >= F.greatest(F.lit(2), F.floor(F.col("_lots") / 2)))
    )
    joined = own.join(common, test).join(span, test)
    n = F.col("_t_n") - F.col("_n")
    s = F.col("_t_s") - F.col("_s")
    q = F.col("_t_q") - F.col("_q")
    mean = F.when(n > 0, F.col("_centre") + s / F.when(n > 0, n))
    variance = F.when(n > 1, (q - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1))
    std = F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0))
    rules = _spc_columns(F.col("_n"), F.col("_centre") + F.col("_s") / F.col("_n"), n, mean, std)
    current = [F.col(f"_o{i}") for i in range(bins)]
    baseline = [F.col(f"_t_o{i}") - F.col(f"_o{i}") for i in range(bins)]
    terms = _psi_terms(current, baseline, F.col("_n"), F.when(n > 0, n))
    score = F.when(n >= 5, F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(terms))
    out = joined.withColumn("psi", score)
    return out.select(lot, test, *[c.alias(name) for name, c in rules.items()], "psi", *_flags(F.col("psi")))
