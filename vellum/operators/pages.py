"""Page-level operators: the text-layer probe, blank pages, joined texts, page offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.functions.text import is_blank, normalised, quality_class, trimmed

#: Pages of one document are summed in blocks of this many page numbers, so that no task holds a whole document.
PAGE_BLOCK = 1024


def probe(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_number, char_count of the trimmed text and its quality class."""
    chars = F.coalesce(F.length(trimmed(F.col("text"))), F.lit(0))
    return pages.select("doc_id", "page_number", chars.alias("char_count"), quality_class(chars, settings).alias("text_quality"))


def probe_whole_file(files: DataFrame) -> DataFrame:
    """Files without pages count as one page of the best class, measured in bytes."""
    return files.select("filename", F.lit(1).alias("page_number"), F.length("content").alias("char_count"), F.lit(2).alias("text_quality"))


def non_blank(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.where(~is_blank(F.col(text)))


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per (doc_id, page_number): the latest extraction (a null time is the earliest), then the
    smaller text. max_by pre-aggregates before the shuffle."""
    newest = F.struct(F.coalesce(F.col("extracted_at"), F.lit("0001-01-01").cast("timestamp")), F.col("text"))
    return (
        pages.where("doc_id IS NOT NULL AND page_number IS NOT NULL")
        .groupBy("doc_id", "page_number")
        .agg(F.max_by("text", newest).alias("text"))
    )


def joined_texts(pages: DataFrame) -> DataFrame:
    """doc_id and the text of its non-blank pages in page order. For documents of ordinary size only:
    the text of one document must fit one row."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "clean")))
    return (
        pages.withColumn("clean", normalised(F.col("text")))
        .where("clean <> ''")
        .groupBy("doc_id")
        .agg(F.array_join(F.transform(listed, lambda p: p["clean"]), "\n\n").alias("text"))
    )


def page_offsets(pages: DataFrame, separator: int = 2) -> DataFrame:
    """doc_id, page_number, page_from, page_to: where each non-blank page lies in its document's joined text.

    A running sum in two levels: blocks of PAGE_BLOCK pages are added up first (with partial aggregation), the
    short list of blocks is summed, then each block by itself. No window ever holds a document's pages."""
    sized = (
        pages.select("doc_id", "page_number", F.length(normalised(F.col("text"))).alias("chars"))
        .where("chars > 0")
        .withColumn("block", F.floor(F.col("page_number") / PAGE_BLOCK))
    )
    blocks = sized.groupBy("doc_id", "block").agg(F.sum(F.col("chars") + separator).alias("block_chars"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("doc_id", "block", F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("block_from"))
    inside = Window.partitionBy("doc_id", "block").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block_from") + F.coalesce(F.sum(F.col("chars") + separator).over(inside), F.lit(0))
    return (
        sized.join(blocks, ["doc_id", "block"])
        .withColumn("page_from", start)
        .select("doc_id", "page_number", "page_from", (F.col("page_from") + F.col("chars")).alias("page_to"))
    )


def over_text_limit(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents whose pages hold more characters than allowed, or no text at all: doc_id, chars, problem."""
    total = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    some = F.bool_or(~is_blank(F.col("text")))
    return (
        pages.groupBy("doc_id")
        .agg(total.alias("chars"), some.alias("some_text"))
        .select("doc_id", "chars", F.when(F.col("chars") > settings.max_text_chars, "too long").when(~F.col("some_text"), "no text").alias("problem"))
        .where("problem IS NOT NULL")
    )


def with_quality(pages: DataFrame, quality: DataFrame) -> DataFrame:
    """Adds text_quality by (doc_id, page_number); 0 where there is none. Several rows for one page: the best."""
    best = quality.groupBy("doc_id", "page_number").agg(F.max("text_quality").alias("text_quality"))
    return pages.join(best, ["doc_id", "page_number"], "left").withColumn("text_quality", F.coalesce("text_quality", F.lit(0)))


def in_range(page: Column, start: Column, end: Column) -> Column:
    return (page >= start) & (page <= end)
