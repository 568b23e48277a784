"""Fusion of chunk hits and page hits by document and page range.

Chunk hits: doc_id, chunk_index, page_start, page_end, text_score, text_rank and any payload.
Page hits: doc_id, page_number, page_score, page_rank and any payload.
Both sides are short lists of positions (over-fetched top-k), so the page side is broadcast; its length is a
limit of the plan, not a property of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import InvalidRequest
from vellum.functions.scoring import clamp_share
from vellum.operators.pages import in_range
from vellum.operators.topk import ranked


@dataclass(frozen=True)
class FusionConfig:
    top_k: int = DEFAULTS.text_top_k
    rrf_k: int = DEFAULTS.rrf_k
    text_weight: float = DEFAULTS.text_weight
    visual_weight: float = DEFAULTS.visual_weight
    text_floor: float = DEFAULTS.text_floor
    visual_floor: float = DEFAULTS.visual_floor


def chunk_hits(df: DataFrame) -> DataFrame:
    """Positions of scored chunks: score becomes text_score with text_rank; ties go to document, then chunk."""
    order = Window.orderBy(F.desc("score"), F.asc("doc_id"), F.asc("chunk_index"))
    return df.withColumn("text_rank", F.row_number().over(order)).withColumnRenamed("score", "text_score")


def page_hits(df: DataFrame, tie: str = "page_id") -> DataFrame:
    """Positions of scored pages. Pages without a document are ranked like the rest and drop out later."""
    return ranked(df, "score", tie, "page_rank").withColumnRenamed("score", "page_score")


def page_match(chunks: DataFrame, pages: DataFrame, by: str = "rank") -> DataFrame:
    """Left join of chunks to the pages in their range. by "rank": the page of the lowest rank; "score": the
    highest page score. Adds page_rank and page_score, null where no page matches."""
    p = pages.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_doc"), "page_number", "page_rank", "page_score")
    joined = chunks.join(F.broadcast(p), (F.col("doc_id") == F.col("_doc")) & in_range(F.col("page_number"), F.col("page_start"), F.col("page_end")), "left")
    score = F.min_by("page_score", "page_rank") if by == "rank" else F.max("page_score")
    rest = [F.first(c).alias(c) for c in chunks.columns if c != "text_rank"]  # a rank is one hit
    return joined.groupBy("text_rank").agg(*rest, F.min("page_rank").alias("page_rank"), score.alias("page_score"))


def orphan_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of documents that have no chunk hit at all; a page outside the range of its document's chunk hits
    is no orphan."""
    docs = chunks.select("doc_id").distinct()
    return pages.where("doc_id IS NOT NULL").join(F.broadcast(docs), "doc_id", "left_anti")


def agreement(hits: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds agrees: whether the hit's document is in both lists before fusion."""
    both = chunks.select("doc_id").distinct().join(F.broadcast(pages.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("_both", F.lit(True))
    return hits.join(F.broadcast(both), "doc_id", "left").withColumn("agrees", F.coalesce("_both", F.lit(False))).drop("_both")


#: What a hit carries beside positions and scores; null where a side has none.
PAYLOAD = {"text": "string", "source": "string", "filename": "string", "metadata": "map<string,string>", "page_image_key": "string"}


def payload_of(df: DataFrame, *absent: str) -> list[Column]:
    """The payload columns of hits; null for those that are absent or not there."""
    return [(F.col(c).cast(t) if c in df.columns and c not in absent else F.lit(None).cast(t)).alias(c) for c, t in PAYLOAD.items()]


def _fused(chunks: DataFrame, pages: DataFrame, config: FusionConfig, by: str, matched_score, orphan_score) -> DataFrame:
    met = page_match(chunks, pages, by)
    matched = met.select(
        *payload_of(met, "page_image_key"), "doc_id", "chunk_index", "page_start", "page_end", "text_score", "page_score", matched_score.alias("score"), F.lit(False).alias("orphan"), F.col("text_rank").alias("position")
    )
    alone = orphan_pages(chunks, pages)
    orphans = alone.select(
        *payload_of(alone, "text"),
        "doc_id",
        F.lit(-1).alias("chunk_index"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        F.lit(None).cast("double").alias("text_score"),
        "page_score",
        orphan_score.alias("score"),
        F.lit(True).alias("orphan"),
        F.col("page_rank").alias("position"),
    )
    # equal scores keep the order of the lists: chunks first, then pages
    return matched.unionByName(orphans).orderBy(F.desc("score"), "orphan", "position").limit(config.top_k)


def rrf(chunks: DataFrame, pages: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Reciprocal ranks: 1/(k + text rank), plus 1/(k + page rank) where a page matches."""
    k = F.lit(float(config.rrf_k))
    page = 1 / (k + F.col("page_rank"))
    return _fused(chunks, pages, config, "rank", 1 / (k + F.col("text_rank")) + F.coalesce(page, F.lit(0.0)), page)


def weighted(chunks: DataFrame, pages: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Weighted sum of both scores, each as a clamped share of its floor; a floor of 0 or less means the default."""
    text_floor = config.text_floor if config.text_floor > 0 else DEFAULTS.text_floor
    visual_floor = config.visual_floor if config.visual_floor > 0 else DEFAULTS.visual_floor
    text = config.text_weight * F.coalesce(clamp_share(F.col("text_score"), text_floor), F.lit(0.0))
    page = config.visual_weight * F.coalesce(clamp_share(F.col("page_score"), visual_floor), F.lit(0.0))
    return _fused(chunks, pages, config, "score", text + page, page)


Strategy = Callable[[DataFrame, DataFrame, FusionConfig], DataFrame]
_strategies: dict[str, Strategy] = {}


def register_strategy(name: str, strategy: Strategy) -> None:
    _strategies[name.strip().lower()] = strategy


register_strategy("rrf", rrf)
register_strategy("weighted", weighted)


def strategy_named(name: str | None, settings: Settings = DEFAULTS) -> Strategy:
    """By name in any case; blank means the default."""
    wanted = (name or "").strip().lower() or settings.default_fusion
    if wanted not in _strategies:
        raise InvalidRequest(f"unknown fusion strategy {name!r}; known: {', '.join(sorted(_strategies))}")
    return _strategies[wanted]
