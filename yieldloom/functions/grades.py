"""Capability, grading and disposition rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from yieldloom.functions.numeric import clip


def cpk(mean: Column, sigma: Column, lsl: Column, usl: Column) -> Column:
    """Capability against one or both limits; NULL without limits."""
    spread = 3 * F.greatest(sigma, F.lit(1e-9))
    return F.least((usl - mean) / spread, (mean - lsl) / spread)


def shift_penalty(max_z: Column) -> Column:
    """20 plus 30 per sigma beyond one, at most 80; nothing up to one sigma."""
    return F.when(max_z > 1, clip(20 + 30 * (max_z - 1), 0.0, 80.0)).otherwise(0.0)


def zscore_closeness(mean_z: Column, max_z: Column) -> Column:
    """100 at no deviation, minus 25 per mean sigma, minus the penalty of the worst parameter."""
    near = clip(100 - 25 * mean_z, 0.0, 100.0)
    return F.when(mean_z.isNull(), 100.0).otherwise(F.greatest(near - shift_penalty(max_z), F.lit(0.0)))


def _corr_score(corr: Column, penalty: Column) -> Column:
    base = clip(F.greatest(F.coalesce(corr, F.lit(0.0)), F.lit(0.0)) * 100, 0.0, 100.0)
    return clip(base - penalty, 0.0, 100.0)


def reliability_score(
    golden_corr: Column, predicted_yield: Column, *, probe_corr: Column, probe_closeness: Column,
    final_corr: Column, final_closeness: Column, probe_max_z: Column, final_max_z: Column,
) -> Column:
    """struct(score and its components): half probe, half final similarity, minus a yield penalty."""
    probe_penalty, final_penalty = shift_penalty(probe_max_z), shift_penalty(final_max_z)
    golden = F.coalesce(golden_corr, F.lit(0.0))
    probe_score = _corr_score(F.coalesce(probe_corr, golden), probe_penalty)
    final_score = _corr_score(F.coalesce(final_corr, golden), final_penalty)
    probe_close = F.coalesce(probe_closeness, probe_score)
    final_close = F.coalesce(final_closeness, final_score)
    probe = 0.5 * probe_score + 0.5 * probe_close
    final = 0.5 * final_score + 0.5 * final_close
    penalty = F.when(predicted_yield < 0.80, clip((0.80 - predicted_yield) * 100, 0.0, 25.0)).otherwise(0.0)
    return F.struct(
        F.round(clip(0.5 * probe + 0.5 * final - penalty, 0.0, 100.0), 4).alias("risk_score"),
        golden.alias("golden_correlation"),
        _corr_score(golden, F.greatest(probe_penalty, final_penalty)).alias("golden_correlation_score"),
        penalty.alias("yield_penalty"),
        probe.alias("probe_similarity"),
        final.alias("final_similarity"),
        probe_score.alias("probe_correlation_score"),
        final_score.alias("final_correlation_score"),
        probe_close.alias("probe_closeness"),
        final_close.alias("final_closeness"),
    )


def product_grade(score: Column, golden_corr: Column, predicted_yield: Column) -> Column:
    """A, B, C or D; a low yield or a poor golden correlation forces D."""
    forced = (predicted_yield < 0.60) | F.coalesce(golden_corr < 0.20, F.lit(False))
    return F.when(forced, "D").when(score >= 90, "A").when(score >= 80, "B").when(score >= 60, "C").otherwise("D")


def grade_application(grade: Column) -> Column:
    return F.when(grade == "A", "Automotive").when(grade == "B", "Industrial").when(grade == "C", "Consumer").otherwise(
        "Scrap"
    )


def yield_grade(predicted: Column, thresholds: Mapping[str, float]) -> Column:
    """First class of Z, A, H, I, C whose threshold is reached, else F."""
    out = None
    for name in ("Z", "A", "H", "I", "C"):
        test = predicted >= thresholds[name]
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("F")


def confidence(predicted: Column, history: Column, thresholds: Mapping[str, float]) -> Column:
    """0.95 minus penalties for distance from history and nearness to a class edge."""
    gap = F.least(F.lit(0.20), F.abs(predicted - history) / 0.10 * 0.15)
    nearest = F.array_min(F.array(*[F.abs(predicted - thresholds[k]) for k in ("C", "I", "H", "A", "Z")]))
    edge = F.when(nearest < 0.005, 0.08).when(nearest < 0.015, 0.04).otherwise(0.0)
    return clip(0.95 - gap - edge, 0.80, 0.99)


def wafer_status(is_pass: Column, gdbn_flag: Column) -> Column:
    return F.when(gdbn_flag, "GDBN Risk").when(~is_pass, "Fail").otherwise("Pass")


def normalised_yield(raw: Column, pass_share: Column) -> Column:
    """One model's yield in percent: fractions are scaled, non-positive output falls back to the pass share."""
    scaled = F.when(raw > 1, raw).when(raw > 0, raw * 100).otherwise(0.0)
    fallback = pass_share * 100 * 0.92
    return clip(F.when((raw <= 0) & (pass_share > 0), fallback).otherwise(scaled), 0.0, 100.0)
