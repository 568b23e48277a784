"""Confidence of hits and of whole responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.functions.scoring import bucket, clamp_share, text_trust


def raw_confidence(text_score: Column, score: Column, page_score: Column, quality: Column, agrees: Column, settings: Settings = DEFAULTS) -> Column:
    """0.4 text + 0.4 visual + 0.2 agreement. The text part takes the hit's own score where it has no text
    score, times the trust in its text layer; the visual part is 0 without a page score; agreement counts
    1 if the document is in both lists, else one half."""
    text = F.coalesce(clamp_share(F.coalesce(text_score, score), settings.text_floor), F.lit(0.0)) * text_trust(quality)
    visual = F.coalesce(clamp_share(page_score, settings.visual_floor), F.lit(0.0))
    agreed = F.when(agrees, 1.0).otherwise(0.5)
    return settings.confidence_text_weight * text + settings.confidence_visual_weight * visual + settings.confidence_agreement_weight * agreed


def annotate(hits: DataFrame, settings: Settings = DEFAULTS, quality: Column | None = None) -> DataFrame:
    """Adds raw_confidence and confidence to hits with text_score, score, page_score and agrees. Hits carry no
    text quality of their own unless quality (or a text_quality entry of a metadata column) gives it."""
    if quality is None:
        quality = F.col("metadata")["text_quality"] if "metadata" in hits.columns else F.lit(None).cast("string")
    raw = raw_confidence(F.col("text_score"), F.col("score"), F.col("page_score"), quality, F.col("agrees"), settings)
    return hits.withColumn("raw_confidence", raw).withColumn("confidence", bucket(F.col("raw_confidence"), settings))


def response_confidence(hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: the bucket of the best raw confidence; null without hits."""
    return hits.agg(F.max("raw_confidence").alias("best")).select(bucket(F.col("best"), settings).alias("confidence"))
