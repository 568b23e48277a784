"""Queries of the core operators. Each takes (session, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import DEFAULTS
from vellum.functions import files as ff
from vellum.functions.ids import chunk_point_id, page_point_id
from vellum.functions.scoring import bucket, clamp_share, text_trust
from vellum.functions.text import normalised, page_range, quality_class, safe_int
from vellum.functions.vectors import cosine, doubles, same_length, vector_dim
from vellum.operators import catalog, chunking, confidence, fusion, jobs, pages, pooling, topk
from vellum.plans import ingest, search
from vellum.sources.embedding import HashEmbedder, embed_texts
from vellum.sources.extract import html_text
from vellum.sources.files import decoded_inline, source_type

Query = Callable[[SparkSession, str], DataFrame]

TEXT_QUERY_ID, PAGE_QUERY_IDS = 7, (3, 11, 42)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vector_of(spark: SparkSession, folder: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


# --- the virtual knowledge base on the embeddings table -------------------------------------------------------


def virtual_chunks(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    index = (v % 5).cast("int")
    return table(spark, folder, "embeddings").select(
        v.alias("id"),
        F.floor(v / 5).cast("string").alias("doc_id"),
        index.alias("chunk_index"),
        (F.floor(index / 2) + 1).cast("int").alias("page_start"),
        (F.floor((index + 1) / 2) + 1).cast("int").alias("page_end"),
        F.col("label"),
        F.concat(F.lit("passage "), v).alias("text"),
        F.lit("vectors").alias("source"),
        F.format_string("doc-%d.pdf", F.floor(v / 5)).alias("filename"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding").alias("vector"),
    )


def virtual_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Five consecutive vectors make a page: four patches in a grid of two, and one special token."""
    v = F.col("vec_id")
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda t: t["embedding"])
    grouped = table(spark, folder, "embeddings").groupBy(F.floor(v / 5).alias("id")).agg(tokens.alias("original"))
    return grouped.select(
        "id",
        F.floor(F.col("id") / 3).cast("string").alias("doc_id"),
        (F.col("id") % 3 + 1).cast("int").alias("page_number"),
        (F.col("id") % 3).cast("int").alias("text_quality"),
        F.format_string("doc-%d.pdf", F.floor(F.col("id") / 3)).alias("filename"),
        F.format_string("vectors/%d/%06d.png", F.floor(F.col("id") / 3), F.col("id") % 3 + 1).alias("page_image_key"),
        "original",
        pooling.pool_rows(F.col("original"), 2, 1).alias("pooled_rows"),
        pooling.pool_cols(F.col("original"), 2, 1).alias("pooled_cols"),
    )


def _text_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return search.text_side(virtual_chunks(spark, folder), _vector_of(spark, folder, TEXT_QUERY_ID), k)


def _page_query(spark: SparkSession, folder: str) -> list[list[float]]:
    return [_vector_of(spark, folder, v) for v in PAGE_QUERY_IDS]


def _page_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return search.page_side(virtual_pages(spark, folder), _page_query(spark, folder), k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


# --- scalars and scans ----------------------------------------------------------------------------------------


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").select("doc_id", "chunk_index").distinct()
    return c.select("doc_id", "chunk_index", chunk_point_id(F.col("doc_id"), F.col("chunk_index")).alias("point_id"))


def page_ids(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "page_texts").select("doc_id", "page_number").distinct()
    return p.select("doc_id", "page_number", page_point_id(F.col("doc_id"), F.col("page_number")).alias("point_id"))


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "ingest_jobs").select("job_id", F.col("request.source_type").alias("t"), F.col("request.source_value").alias("v")).distinct()
    named = j.select("job_id", source_type(F.col("t")).alias("source_type"), ff.filename_from_uri(F.col("v")).alias("name")).where("source_type <> 'inline'")
    return named.withColumn("content_type", ff.content_type_of(F.col("name"))).withColumn("pdf", ff.is_pdf(F.col("content_type"), F.col("name")))


def inline_sizes(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "ingest_jobs").where("lower(trim(request.source_type)) = 'inline'").select("job_id", F.col("request.source_value").alias("v")).distinct()
    text = decoded_inline(F.col("v"))
    return j.select("job_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "page_texts").select("doc_id", "page_number", normalised(F.col("text")).alias("t"))
    return p.select("doc_id", "page_number", F.md5("t").alias("digest"), F.length("t").alias("chars"))


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    return pages.probe(table(spark, folder, "page_texts"))


def quality_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    """Stored classes that differ from the class of the stored count."""
    q = table(spark, folder, "page_quality").withColumn("expected", quality_class(F.col("char_count")))
    return q.where("NOT (text_quality <=> expected)").groupBy("text_quality", "expected").agg(F.count("*").alias("n"))


def content_types(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").select(F.coalesce("content_type", ff.content_type_of(F.col("filename"))).alias("type"), "filename")
    return c.groupBy("type").agg(F.count("*").alias("n"), F.count_if(ff.is_pdf(F.col("type"), F.col("filename"))).alias("pdfs"))


def payload_ints(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "points").select("id", F.col("payload")["chunk_index"].alias("v")).distinct()
    return p.select("id", safe_int(F.col("v")).alias("chunk_index"))


def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    first, last = page_range(F.col("page_start"), F.col("page_end"))
    return table(spark, folder, "chunks").select("id", first.alias("page_first"), last.alias("page_last")).distinct()


def payload_build(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks")
    fixed = {k: F.col(k) for k in ("doc_id", "chunk_index", "page_start", "filename", "content_type")}
    made = catalog.payload(fixed, F.col("metadata"), F.col("embed_model"))
    return c.select("id", made.alias("m")).select("id", F.size("m").alias("entries"), F.col("m")["content_type"].alias("content_type"), F.col("m")["dept"].alias("dept"), F.col("m")["embed_model"].alias("embed_model")).distinct()


def score_labels(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "value")
    share = clamp_share(F.col("value"), DEFAULTS.visual_floor)
    return _rounded(e.select("event_id", share.alias("share"), bucket(share).alias("label"), text_trust((F.col("event_id") % 5).cast("string")).alias("trust")))


# --- pages and chunks -----------------------------------------------------------------------------------------


def blank_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "page_texts")
    return pages.non_blank(p).groupBy("kb_name").agg(F.count("*").alias("pages"), F.countDistinct("doc_id").alias("docs"))


def page_latest(spark: SparkSession, folder: str) -> DataFrame:
    p = pages.latest_pages(table(spark, folder, "page_texts"))
    return p.select("doc_id", "page_number", F.md5("text").alias("digest"))


def page_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_offsets(pages.latest_pages(table(spark, folder, "page_texts")))


def text_limit(spark: SparkSession, folder: str) -> DataFrame:
    from dataclasses import replace

    return pages.over_text_limit(table(spark, folder, "page_texts"), replace(DEFAULTS, max_text_chars=20_000))


def page_quality_lookup(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "page_embeddings").select("id", "doc_id", "page_number")
    return pages.with_quality(p, table(spark, folder, "page_quality"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text")
    c = chunking.chunk_documents(d)
    return c.select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("digest"))


def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    c = chunking.chunk_pages(pages.latest_pages(table(spark, folder, "page_texts")))
    return c.select("doc_id", "chunk_index", "char_start", "char_end", "page_start", "page_end", F.md5("text").alias("digest"))


# --- vectors --------------------------------------------------------------------------------------------------


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = topk.cosine_topk(virtual_chunks(spark, folder), _vector_of(spark, folder, TEXT_QUERY_ID), 10)
    return _rounded(topk.ranked(hits, "score", "id").select("id", "score", "rank"))


def cosine_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    chunks = topk.metadata_filter(virtual_chunks(spark, folder), {"label": "3"})
    hits = topk.cosine_topk(chunks, _vector_of(spark, folder, TEXT_QUERY_ID), 10)
    return _rounded(topk.ranked(hits, "score", "id").select("id", "score", "rank"))


def batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return _rounded(topk.batch_topk(q, e, 5))


def point_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The stored points nearest to the first usable one; unusable vectors take no part."""
    p = table(spark, folder, "points").select("id", "vector").dropDuplicates(["id"])
    first = p.where("size(vector) = 64 AND NOT exists(vector, x -> isnan(x)) AND exists(vector, x -> x <> 0)").orderBy("id").first()
    return _rounded(topk.cosine_topk(p, [float(x) for x in first["vector"]], 10).select("id", "score"))


def pool_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, pooling.pool_rows, "pooled_rows")


def pool_cols(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, pooling.pool_cols, "pooled_cols")


def _pooled(spark: SparkSession, folder: str, pool, stored: str) -> DataFrame:
    """Means of the stored grids (four by four, or three by three where there are fewer patches)."""
    p = table(spark, folder, "page_embeddings").where("original IS NOT NULL")
    means = p.select("id", F.posexplode(pool(F.col("original"), 4, 2)).alias("line", "mean"), F.col(stored).alias("stored"))
    return _rounded(means.select("id", "line", F.aggregate("mean", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("mean").alias("dim"), (F.size("stored")).alias("stored_lines")))


def vector_shapes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "page_embeddings")
    shape = p.select(vector_dim(F.col("original"), F.col("pooled_rows")).alias("dim"), F.size("original").alias("tokens"), same_length(F.col("original")).alias("regular"))
    return shape.groupBy("dim", "tokens", "regular").agg(F.count("*").alias("n"))


def maxsim_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(topk.max_sim_topk(virtual_pages(spark, folder), _page_query(spark, folder), 10).select("id", "score"))


def two_stage_search(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(topk.two_stage(virtual_pages(spark, folder), _page_query(spark, folder), 3).select("id", "doc_id", "page_number", "score"))


def page_search(spark: SparkSession, folder: str) -> DataFrame:
    """Two-stage search over the stored pages for the vectors of the first one."""
    p = table(spark, folder, "page_embeddings").where("original IS NOT NULL")
    query = p.orderBy("id").select("pooled_rows").first()[0]
    return _rounded(topk.two_stage(p, [[float(x) for x in r] for r in query], 5).select("id", "score"))


# --- fusion ---------------------------------------------------------------------------------------------------


def page_match(spark: SparkSession, folder: str) -> DataFrame:
    m = fusion.page_match(_text_hits(spark, folder, 20).drop("vector"), _page_hits(spark, folder, 10))
    return _rounded(m.select("doc_id", "chunk_index", "text_rank", "page_rank", "page_score"))


def orphan_pages(spark: SparkSession, folder: str) -> DataFrame:
    o = fusion.orphan_pages(_text_hits(spark, folder, 20), _page_hits(spark, folder, 10))
    return _rounded(o.select("doc_id", "page_number", "page_rank", "page_score"))


def doc_agreement(spark: SparkSession, folder: str) -> DataFrame:
    t = _text_hits(spark, folder, 20)
    return fusion.agreement(t, t, _page_hits(spark, folder, 10)).select("doc_id", "chunk_index", "agrees")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    hits = fusion.rrf(_text_hits(spark, folder, 20), _page_hits(spark, folder, 10), fusion.FusionConfig(top_k=15))
    return _rounded(hits.select("doc_id", "chunk_index", "page_start", "page_end", "text_score", "page_score", "score"))


def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    hits = fusion.weighted(_text_hits(spark, folder, 20), _page_hits(spark, folder, 10), fusion.FusionConfig(top_k=15, visual_floor=2.0))
    return _rounded(hits.select("doc_id", "chunk_index", "page_start", "page_end", "text_score", "page_score", "score"))


def _shown(hits: DataFrame) -> DataFrame:
    """Hits with the entries of their metadata as columns."""
    entries = {"label": F.col("metadata")["label"], "page_quality": F.col("metadata")["text_quality"]}
    return _rounded(hits.withColumns(entries).drop("metadata"))


def search_text_only(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(search.text_only(virtual_chunks(spark, folder), _vector_of(spark, folder, TEXT_QUERY_ID)))


def search_colpali_only(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(search.pages_only(virtual_pages(spark, folder), _page_query(spark, folder)))


def search_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        search.fused(virtual_chunks(spark, folder), virtual_pages(spark, folder), _vector_of(spark, folder, TEXT_QUERY_ID), _page_query(spark, folder))
    )


def response_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.response_confidence(search_fusion(spark, folder))


# --- catalog, modes, jobs -------------------------------------------------------------------------------------


def mode_matrix(spark: SparkSession, folder: str) -> DataFrame:
    from vellum.errors import InvalidRequest
    from vellum.plans.modes import MODES, resolve

    rows = []
    for mode in MODES:
        for visual in (True, False):
            try:
                got = resolve(mode.upper(), visual)
                rows.append((mode, visual, got.mode, len(got.warnings)))
            except InvalidRequest:
                rows.append((mode, visual, "error", 0))
    return spark.createDataFrame(rows, "requested string, visual boolean, resolved string, warnings int")


def mode_consistency(spark: SparkSession, folder: str) -> DataFrame:
    bases = table(spark, folder, "chunks").select(F.trim("kb_name").alias("kb")).where("kb IS NOT NULL").distinct()
    visual = table(spark, folder, "page_embeddings").select(F.trim("kb_name").alias("kb")).distinct().withColumn("has_pages", F.lit(True))
    wants = F.explode(F.array(F.lit(True), F.lit(False))).alias("wants_visual")
    j = bases.join(visual, "kb", "left").select("kb", F.coalesce("has_pages", F.lit(False)).alias("has_pages"), wants)
    return j.withColumn("verdict", jobs.mode_consistency(F.lit(True), F.col("has_pages"), F.col("wants_visual")))


def queue_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents would be queued: those of at least the threshold's pages, were they visual PDFs."""
    p = table(spark, folder, "page_texts").groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"))
    return p.select("doc_id", "pages", jobs.goes_to_queue(F.lit(True), F.lit(True), F.col("pages")).alias("queued"))


def job_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest_state(table(spark, folder, "ingest_jobs")).select("job_id", "status", "retry_count", "changes")


def job_recovery(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.recover(jobs.latest_state(table(spark, folder, "ingest_jobs"))).select("job_id", "status", "retry_count", "requeued")


def queue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.queue_counts(jobs.latest_state(table(spark, folder, "ingest_jobs")))


def upsert_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """Upserts a base's points twice; the rows are those of one upsert."""
    e = virtual_chunks(spark, folder).select("id", "doc_id", "chunk_index")
    again = e.where("id % 3 = 0").withColumn("chunk_index", F.col("chunk_index") + 100)
    return catalog.upsert(catalog.upsert(e, again), again)


def list_kbs(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").where("kb_name IS NOT NULL").groupBy(F.trim("kb_name").alias("name")).agg(F.countDistinct("id").alias("points"))
    p = table(spark, folder, "page_embeddings").groupBy(F.concat(F.trim("kb_name"), F.lit("_pages")).alias("name")).agg(F.countDistinct("id").alias("points"))
    both = c.withColumn("dim", F.lit(64)).unionByName(p.withColumn("dim", F.lit(None).cast("int"))).withColumn("vectors", F.col("points"))
    return catalog.list_bases(both)


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions read as HTML: markup outside the text goes."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")

    def run(batches):
        for b in batches:
            yield b.assign(chars=[len(html_text(t)) for t in b["text"]])[["doc_id", "chars"]]

    return d.mapInPandas(run, "doc_id bigint, chars bigint")


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").where("text IS NOT NULL").select("id", "text")
    e = embed_texts(c, HashEmbedder(32)).dropDuplicates(["id"])
    return _rounded(e.select("id", F.size("vector").alias("dim"), cosine(doubles(F.col("vector")), doubles(F.col("vector"))).alias("self")))


def ingest_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text files through the whole ingest, then a text search over them."""
    d = table(spark, folder, "documents").where(F.col("text").rlike(r"[^\s\p{Z}\p{C}]"))
    f = d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.format_string("doc-%d.txt", "doc_id").alias("filename"), F.lit("text/plain").alias("content_type"), F.encode("text", "UTF-8").alias("content"),
        "source", F.lit("INLINE").alias("source_type"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("metadata"),
    )
    embedder = HashEmbedder(64)
    query = [float(x) for x in embedder.embed(["the harbour and its lighthouse"])[0]]
    return _shown(search.text_only(ingest.chunk_rows(f, embedder), query, 10))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        point_ids, page_ids, source_names, inline_sizes, normalize_text, text_quality, quality_disagreement, content_types,
        payload_ints, page_ranges, payload_build, score_labels, blank_pages, page_latest, page_offsets, text_limit,
        page_quality_lookup, chunk_documents, chunk_pages, cosine_topk, cosine_topk_filtered, batch_topk, point_topk,
        pool_rows, pool_cols, vector_shapes, maxsim_topk, two_stage_search, page_search, page_match, orphan_pages, doc_agreement,
        rrf_fusion, weighted_fusion, search_text_only, search_colpali_only, search_fusion, response_confidence,
        mode_matrix, mode_consistency, queue_routing, job_latest_status, job_recovery, queue_counts, upsert_idempotent,
        list_kbs, html_pages, embed_text, ingest_search,
    )
}
