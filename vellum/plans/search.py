"""Search handlers. Each is one DataFrame plan with one action at the caller's end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.operators.confidence import annotate
from vellum.operators.fusion import PAYLOAD, FusionConfig, agreement, chunk_hits, page_hits, payload_of, strategy_named
from vellum.operators.topk import cosine_topk, metadata_filter, two_stage

#: Columns of every search result.
HIT_COLUMNS = ("doc_id", "chunk_index", "page_start", "page_end", "text_score", "page_score", "score", "raw_confidence", "confidence", *PAYLOAD)


def top_k_or_default(k: int | None, settings: Settings = DEFAULTS) -> int:
    return k if k and k > 0 else settings.text_top_k


def text_side(chunks: DataFrame, query: Sequence[float], k: int, wanted: Mapping[str, str] | None = None, vector: str = "vector", tie: str = "id") -> DataFrame:
    return chunk_hits(cosine_topk(metadata_filter(chunks, wanted), query, k, vector, tie))


def page_side(pages: DataFrame, query: Sequence[Sequence[float]], k: int, wanted: Mapping[str, str] | None = None, tie: str = "id") -> DataFrame:
    """The metadata filter holds before both prefetches. The class of a page's text layer goes into its metadata."""
    hits = page_hits(two_stage(metadata_filter(pages, wanted), query, k, tie), tie)
    if "text_quality" not in hits.columns:
        return hits
    none = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("metadata", none), lambda k, _: k != "text_quality") if "metadata" in hits.columns else none
    return hits.withColumn("metadata", F.map_concat(own, F.create_map(F.lit("text_quality"), F.col("text_quality").cast("string"))))


def _whole(hits: DataFrame, *absent: str) -> DataFrame:
    """Hits with all payload columns."""
    return hits.select(*[c for c in hits.columns if c not in PAYLOAD], *payload_of(hits, *absent))


def text_only(chunks: DataFrame, query: Sequence[float], k: int | None = None, wanted: Mapping[str, str] | None = None, vector: str = "vector", tie: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """The other side is empty, so agreement counts one half for every hit."""
    hits = text_side(chunks, query, top_k_or_default(k, settings), wanted, vector, tie)
    hits = hits.withColumns({"score": F.col("text_score"), "page_score": F.lit(None).cast("double"), "agrees": F.lit(False)})
    return annotate(_whole(hits, "page_image_key"), settings).select(*HIT_COLUMNS)


def pages_only(pages: DataFrame, query: Sequence[Sequence[float]], k: int | None = None, wanted: Mapping[str, str] | None = None, tie: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """Page hits in the shape of chunk hits: chunk -1, the page as its range. Their trust is that of the page."""
    hits = page_side(pages, query, top_k_or_default(k, settings), wanted, tie)
    hits = hits.withColumns(
        {
            "score": F.col("page_score"),
            "text_score": F.lit(None).cast("double"),
            "chunk_index": F.lit(-1),
            "page_start": F.col("page_number"),
            "page_end": F.col("page_number"),
            "agrees": F.lit(False),
        }
    )
    return annotate(_whole(hits, "text"), settings).select(*HIT_COLUMNS)


def fused(
    chunks: DataFrame,
    pages: DataFrame,
    text_query: Sequence[float],
    page_query: Sequence[Sequence[float]],
    k: int | None = None,
    wanted: Mapping[str, str] | None = None,
    strategy: str | None = None,
    config: FusionConfig = FusionConfig(),
    vector: str = "vector",
    tie: str = "id",
    page_tie: str = "id",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Both sides over-fetched, fused, cut to k and labelled. Agreement looks at the lists before fusion."""
    k = top_k_or_default(k, settings)
    fuse = strategy_named(strategy, settings)
    texts = text_side(chunks, text_query, k * settings.text_overfetch, wanted, vector, tie)
    found = page_side(pages, page_query, k * settings.page_overfetch, wanted, page_tie)
    hits = agreement(fuse(texts, found, replace(config, top_k=k)), texts, found)
    return annotate(hits, settings).select(*HIT_COLUMNS)
