"""Score arithmetic: clamping, trust, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings


def clamp_share(score: Column, floor: float) -> Column:
    """min(1, max(0, score) / floor); a floor of 0 or less gives 0; null stays null."""
    if floor <= 0:
        return F.when(score.isNotNull(), F.lit(0.0))
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score) / F.lit(float(floor))))


def text_trust(quality: Column) -> Column:
    """quality / 2 within [0, 1]; 1 where it is missing or no number."""
    number = quality.cast("string").try_cast("double").try_cast("int").cast("double")
    # least and greatest pass over nulls, so a missing number is told apart first
    return F.when(number.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number / 2)))


def bucket(raw: Column, settings: Settings = DEFAULTS) -> Column:
    """high above 0.7, medium above 0.4, both exclusive; else low; null for null."""
    return F.when(raw > settings.high_above, "high").when(raw > settings.medium_above, "medium").when(raw.isNotNull(), "low")
