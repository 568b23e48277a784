"""Text normalisation and the text-layer quality classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings

#: Characters up to U+0020 at either end; F.trim strips blanks only.
_EDGES = r"\A[\x00-\x20]+|[\x00-\x20]+\z"


def normalised(text: Column) -> Column:
    """Runs of three or more line feeds become two, then control characters and blanks at both ends go."""
    return trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space texts."""
    return text.isNull() | (normalised(text) == "")


def quality_class(chars: Column, settings: Settings = DEFAULTS) -> Column:
    """0 below the low threshold, 1 below the full one, else 2; null stays null."""
    return F.when(chars < settings.quality_low, 0).when(chars < settings.quality_full, 1).when(chars.isNotNull(), 2)


def safe_int(value: Column) -> Column:
    """An integer from a payload string; -1 where it is missing or no number. Fractions are cut off."""
    return F.coalesce(value.try_cast("int"), value.try_cast("double").try_cast("int"), F.lit(-1))


def page_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Page tags as read back from old rows: a start below 1 is 1, an end before the start is the start."""
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    return first, F.greatest(F.coalesce(end, first), first)
