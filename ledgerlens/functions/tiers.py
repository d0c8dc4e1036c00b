"""Tier arithmetic as column expressions (ordinal rank + clamp, no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (RAW_TIER_HIGH_MAX, RAW_TIER_MEDIUM_MAX, REVIEW_LABELS, LABEL_MONITOR,
                         TIER_ORDER)


def tier_rank(tier: Column) -> Column:
    """Monitor 0 < Low 1 < Medium 2 < High 3; unknown -> NULL."""
    expr = F.when(tier == TIER_ORDER[0], F.lit(0))
    for i, t in enumerate(TIER_ORDER[1:], start=1):
        expr = expr.when(tier == t, F.lit(i))
    return expr


def tier_at(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIER_ORDER]), rank + 1)


def downgrade_tier(tier: Column, steps: int = 1) -> Column:
    """One step down, clamped at Monitor; an unknown tier becomes Monitor."""
    r = tier_rank(tier)
    return F.when(r.isNull(), F.lit(TIER_ORDER[0])).otherwise(tier_at(F.greatest(r - steps, F.lit(0))))


def upgrade_tier(tier: Column, steps: int = 1) -> Column:
    """One step up, clamped at High; an unknown tier is returned unchanged."""
    r = tier_rank(tier)
    top = len(TIER_ORDER) - 1
    return F.when(r.isNull(), tier).otherwise(tier_at(F.least(r + steps, F.lit(top))))


def raw_tier(score: Column) -> Column:
    """Right-closed bins: (-inf, -0.15] High, (-0.15, -0.05] Medium, else Low."""
    return (F.when(score <= RAW_TIER_HIGH_MAX, F.lit("High"))
             .when(score <= RAW_TIER_MEDIUM_MAX, F.lit("Medium"))
             .when(score.isNotNull(), F.lit("Low")))


def review_label(tier: Column) -> Column:
    expr = None
    for t, label in REVIEW_LABELS.items():
        expr = F.when(tier == t, F.lit(label)) if expr is None else expr.when(tier == t, F.lit(label))
    return expr.otherwise(F.lit(LABEL_MONITOR))


def money_text(amount: Column) -> Column:
    """``$1,234.50`` (sign after the dollar, as the source's format does)."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def two_decimals(x: Column) -> Column:
    """``%.2f`` with round-half-even on the binary value and no grouping commas."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")
