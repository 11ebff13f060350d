"""Score ladders and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, ScreenParams
from .rules import first_match


def score_tier(score: Column, threshold: float | None = None, p: ScreenParams = DEFAULTS) -> Column:
    """lead / hit / moderate / weak, or unknown without a score."""
    cut = p.moderate_score if threshold is None else threshold
    return first_match(
        [
            (score.isNull(), "unknown"),
            (score <= p.lead_score, "lead"),
            (score <= p.hit_score, "hit"),
            (score <= cut, "moderate"),
        ],
        "weak",
    )


def score_zone(score: Column, threshold: float | None = None, margin: float | None = None,
               p: ScreenParams = DEFAULTS) -> Column:
    """hit / near_miss / clear_fail; null stays null so that callers can skip it."""
    cut = p.hit_score if threshold is None else threshold
    band = p.near_miss_margin if margin is None else margin
    return first_match(
        [
            (score <= cut, "hit"),
            (score <= cut + band, "near_miss"),
            (score > cut + band, "clear_fail"),
        ]
    )


def stored_exhaustiveness(exh: Column, score: Column, p: ScreenParams = DEFAULTS) -> Column:
    """Recorded search effort; rows from before it was recorded are judged by score."""
    redockable = score <= p.hit_score + p.near_miss_margin
    return F.coalesce(
        exh,
        F.when(redockable, F.lit(p.legacy_exhaustiveness)).otherwise(F.lit(p.permanent_exhaustiveness)),
    )


def host_risk(identity: Column, p: ScreenParams = DEFAULTS) -> Column:
    return first_match(
        [
            (identity >= p.identity_high, "HIGH"),
            (identity >= p.identity_medium, "MEDIUM"),
            (identity >= p.identity_low, "LOW"),
            (identity < p.identity_low, "VERY LOW"),
        ]
    )


def identity_bucket(percent: Column) -> Column:
    """Risk colour band of a host identity in percent."""
    return first_match([(percent < 20, "low_risk"), (percent < 40, "medium_risk")], "high_risk")


def search_box(volume: Column, mode: str = "ceil", p: ScreenParams = DEFAULTS) -> Column:
    """Edge of the search box around a pocket, from its equivalent sphere."""
    edge = 2 * F.cbrt(3 * volume / (4 * F.pi())) + p.box_padding
    whole = (F.ceil(edge) if mode == "ceil" else F.floor(edge)).cast("int")
    sized = F.greatest(F.lit(p.min_box), F.least(F.lit(p.max_box), whole))
    return F.when(volume > 0, sized).otherwise(F.lit(p.min_box))


def search_effort(box: Column, p: ScreenParams = DEFAULTS) -> Column:
    """Exhaustiveness for a box edge, linear between the two limits."""
    effort = F.round(0.4 * F.coalesce(box, F.lit(p.min_box)) - 4).cast("int")
    return F.greatest(F.lit(p.min_exhaustiveness), F.least(F.lit(p.max_exhaustiveness), effort))


def selectivity_ratio(primary: Column, host: Column) -> Column:
    return F.when(primary != 0, F.try_divide(host, primary))


def selectivity_verdict(primary: Column, host: Column, tiers: int = 4,
                        p: ScreenParams = DEFAULTS) -> Column:
    """Verdict on host/primary; ``tiers=3`` leaves the risky class out."""
    ratio = selectivity_ratio(primary, host)
    ladder = [
        (host.isNull(), "docking failed"),
        (ratio.isNull(), "no primary score"),
        (ratio < p.selective_ratio, "SELECTIVE"),
        (ratio < p.moderate_ratio, "Mod selective"),
    ]
    if tiers == 4:
        ladder.append((ratio <= p.risky_ratio, "Non-selective"))
        return first_match(ladder, "RISKY")
    return first_match(ladder, "Non-selective")


def confidence_label(mean: Column, fraction: Column) -> Column:
    """Quality label of a predicted structure."""
    return first_match(
        [
            ((mean >= 90) & (fraction >= 0.9), "EXCELLENT"),
            ((mean >= 80) & (fraction >= 0.7), "GOOD"),
            ((mean >= 70) & (fraction >= 0.5), "USABLE"),
            (mean >= 60, "LOW"),
        ],
        "POOR",
    )


def ortholog_call(identity: Column, coverage: Column, p: ScreenParams = DEFAULTS) -> Column:
    return first_match(
        [
            (identity.isNull(), "No hit"),
            ((identity >= p.ortholog_identity) & (coverage >= p.ortholog_coverage), "Pan-tick ortholog"),
            (identity >= p.putative_identity, "Putative ortholog"),
        ],
        "Distant homolog",
    )


def score_bin(score: Column, width: float = 0.5) -> Column:
    """Lower edge of the histogram bin a score falls in."""
    return F.floor(score / width) * width


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600


def duration_text(seconds: Column) -> Column:
    """Elapsed seconds as ``XhYYmZZs``."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%dh%02dm%02ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def exact_avg(value: Column, scale: int = 12) -> Column:
    """Mean over decimals, so that it does not depend on the order in which tasks add up.

    Values are rounded to ``scale`` places. One with more than ``38 - scale`` digits before the point
    fails instead of being left out; NaN and infinities fail too.
    """
    exact = value.cast(f"decimal(38,{scale})")
    checked = F.when(value.isNotNull() & exact.isNull(), F.raise_error(F.lit("value does not fit an exact mean"))).otherwise(exact)
    return F.try_divide(F.sum(checked).cast("double"), F.count(value)).cast("double")
