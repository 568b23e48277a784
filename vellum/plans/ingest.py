"""Ingest: files to chunk rows and page rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import ExtractionError
from vellum.functions.files import is_pdf, png_size
from vellum.functions.ids import chunk_point_id, page_point_id
from vellum.operators.catalog import payload
from vellum.operators.chunking import chunk_pages
from vellum.operators.pages import probe, with_quality
from vellum.sources.embedding import TextEmbedder, embed_texts
from vellum.sources.extract import extract_pages, page_count, pages_of
from vellum.sources.images import PageImageStore, PageRenderer


def chunk_rows(files: DataFrame, embedder: TextEmbedder, settings: Settings = DEFAULTS) -> DataFrame:
    """Points of files (doc_id, filename, content_type, content, source, source_type, metadata): extracted,
    chunked, embedded, keyed by document and chunk, with their payload. The document is the unit of work;
    nothing is collected."""
    about = files.select("doc_id", "filename", "content_type", "source", "source_type", "metadata")
    pages = extract_pages(files.withColumn("filename", F.concat_ws("\0", "doc_id", "filename")), settings).select(
        F.substring_index("filename", "\0", 1).alias("doc_id"), "page_number", "text"
    )
    chunks = embed_texts(chunk_pages(pages, settings=settings), embedder).join(about, "doc_id")
    fixed = {k: F.col(k) for k in ("text", "doc_id", "chunk_index", "page_start", "page_end", "filename", "source")}
    fixed |= {"source_type": F.lower("source_type"), "content_type": F.col("content_type"), "char_start": F.col("char_start"), "char_end": F.col("char_end")}
    return chunks.withColumn("payload", payload(fixed, F.col("metadata"), F.col("embed_model"))).select(
        chunk_point_id(F.col("doc_id"), F.col("chunk_index")).alias("id"),
        "vector", "doc_id", "chunk_index", "char_start", "char_end", "page_start", "page_end", "text", "filename",
        "source", F.lower("source_type").alias("source_type"), "content_type", "metadata", "embed_model", "payload",
    )


def page_rows(pages: DataFrame, quality: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Page points of embedded pages (doc_id, page_number, original, pooled_rows, pooled_cols, ...), with the
    class of their text layer; 0 where it is unknown."""
    rated = with_quality(pages, quality) if quality is not None else pages.withColumn("text_quality", F.lit(0))
    return rated.withColumn("id", page_point_id(F.col("doc_id"), F.col("page_number")))


def probed(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_number, char_count, text_quality of the text layers of files (doc_id, filename, content_type,
    content). A file that gives no text at all has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, name, kind, content in zip(batch["doc_id"], batch["filename"], batch["content_type"], batch["content"]):
                try:
                    rows += [(doc, n, t) for n, t in pages_of(name, kind, content, settings.max_text_chars)]
                except ExtractionError:
                    pass  # scanned pages: their class is 0
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text"])

    return probe(files.select("doc_id", "filename", "content_type", "content").mapInPandas(read, "doc_id string, page_number int, text string"), settings)


def rendered(files: DataFrame, renderer: PageRenderer, images: PageImageStore, kb: str, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_number, png, page_image_key, page_width, page_height, filename, source of the pages of files. Images
    are stored by the tasks that render them; a task that runs again writes the same keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, name, source, content in zip(batch["doc_id"], batch["filename"], batch["source"], batch["content"]):
                pages = renderer.render(bytes(content), settings.render_dpi)
                yield pd.DataFrame(
                    [(doc, n, png, images.store(kb, doc, n, png), name, source) for n, png in enumerate(pages, 1)],
                    columns=["doc_id", "page_number", "png", "page_image_key", "filename", "source"],
                )

    pages = files.select("doc_id", "filename", "source", "content").mapInPandas(run, "doc_id string, page_number int, png binary, page_image_key string, filename string, source string")
    width, height = png_size(F.col("png"))
    return pages.withColumns({"page_width": width, "page_height": height})


def with_page_count(files: DataFrame) -> DataFrame:
    """Adds pages: those of a PDF, 0 for other files."""

    @F.pandas_udf("int")
    def count(content: pd.Series) -> pd.Series:
        return content.map(lambda c: page_count(bytes(c)) if c is not None else 0).astype("int32")

    return files.withColumn("pages", F.when(is_pdf(F.col("content_type"), F.col("filename")), count("content")).otherwise(0))
