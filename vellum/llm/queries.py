"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, neighbours, offence, packing, quality, scans, similar, splitting

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.found(table(spark, folder, "page_texts"), table(spark, folder, "common_words"))


def p1_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.with_quality(table(spark, folder, "page_texts"), table(spark, folder, "page_quality"), table(spark, folder, "common_words"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.found(table(spark, folder, "chunks"), table(spark, folder, "ingest_jobs"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similar.groups(table(spark, folder, "chunks"), table(spark, folder, "ingest_jobs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found(table(spark, folder, "page_texts"), table(spark, folder, "common_words"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.paragraphs(table(spark, folder, "page_texts"), table(spark, folder, "common_words"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.found(table(spark, folder, "chunks"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"), table(spark, folder, "page_texts"))


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of every oversized chunk keep the limit, follow one another with the overlap and make up the
    text: its length and digest as put together from the pieces."""
    pieces = splitting.split(splitting.oversized(table(spark, folder, "chunks")).select("id", "text"))
    listed = F.array_sort(F.collect_list(F.struct("piece_index", "piece_start", "piece_end", "text")))
    rows = pieces.groupBy("id").agg(listed.alias("p"))
    zero = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"), F.lit(True).alias("fits"))

    def add(s, x):
        fits = s["fits"] & (F.length(x["text"]) <= splitting.LIMIT) & (x["piece_start"] <= s["end"]) & (x["piece_start"] >= s["end"] - splitting.OVERLAP)
        return F.struct(x["piece_end"].alias("end"), F.concat(s["text"], F.substring(x["text"], s["end"] - x["piece_start"] + 1, F.length(x["text"]))).alias("text"), fits.alias("fits"))

    whole = rows.select("id", F.aggregate("p", zero, add).alias("w"))
    return whole.select("id", F.length("w.text").cast("bigint").alias("chars"), F.md5("w.text").alias("digest"), F.col("w.fits").alias("fits"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of every text as decoded from its token ids."""
    decoded = bpe.decode_corpus(bpe.encode_corpus(table(spark, folder, "documents")))
    return decoded.select("doc_id", F.md5("text").alias("digest"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.found(table(spark, folder, "points"), table(spark, folder, "page_embeddings"))


def p5_points(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "points"), 64)


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pages_in_exact_order(table(spark, folder, "page_embeddings"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return offence.found(table(spark, folder, "documents"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return offence.scored(table(spark, folder, "documents"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return offence.rates(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_stats, p2_found, p2_groups, p3_found, p3_paragraphs, p4_found, p4_pieces, p4_cover, p5_found, p5_points, p5_pages, p6_ids, p6_round_trip, p7_pack, p8_found, p8_scores, p8_rates)}
ORACLE: dict[str, str] = {
    "p4_found": "SELECT DISTINCT id FROM chunks WHERE length(text) > 1500 AND id IS NOT NULL",
    "p4_cover": "SELECT id, max(length(text)) AS chars, md5(arg_max(text, length(text))) AS digest, true AS fits FROM chunks WHERE length(text) > 1500 AND id IS NOT NULL GROUP BY id",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
