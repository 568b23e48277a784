"""The tools: ingest, search, list, status, inspect, drop."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import InvalidRequest, ModeConflict, ProviderUnavailable
from vellum.functions.files import is_pdf
from vellum.operators.catalog import PAGES_SUFFIX
from vellum.operators.confidence import response_confidence
from vellum.plans import ingest, modes, search
from vellum.operators.jobs import goes_to_queue
from vellum.session import staged
from vellum.sources.embedding import PageEmbedder, TextEmbedder, embed_page_query, embed_pages, embed_query
from vellum.sources.images import PageImageStore, PageRenderer
from vellum.sources.tables import Collections, VectorField
from vellum.streaming.queue import JobQueue

#: Document ids that are broadcast where files are picked by them.
SEND_DOCS = 100_000


@dataclass(frozen=True)
class SearchResponse:
    base: str
    mode: str
    hits: DataFrame
    warnings: tuple[str, ...] = ()
    otherwise: DataFrame | None = None  # the text search that stands in where the visual side fails

    def confidence(self) -> str | None:
        return response_confidence(self.hits).first()[0]

    def run(self) -> SearchResponse:
        """The response with its few hits computed. A failure of the visual side, which a plan shows only when it
        runs, gives the text search with a warning; a failure of the text side is an error."""
        spark = self.hits.sparkSession
        try:
            rows = self.hits.collect()
        except Exception as e:  # noqa: BLE001 - whatever the visual side raises
            if self.otherwise is None:
                raise
            why = (str(e).strip() or type(e).__name__).splitlines()[0]
            rows = self.otherwise.collect()
            return SearchResponse(self.base, "text_only_fallback", spark.createDataFrame(rows, self.otherwise.schema), (*self.warnings, f"visual search failed, text search only: {why}"))
        return SearchResponse(self.base, self.mode, spark.createDataFrame(rows, self.hits.schema), self.warnings)


@dataclass(frozen=True)
class IngestResult:
    base: str
    doc_ids: DataFrame
    warnings: tuple[str, ...] = ()
    queued: DataFrame | None = None  # job_id and doc_id of the files that went to the queue


@dataclass
class KnowledgeBases:
    """All knowledge bases under one shared folder."""

    spark: SparkSession
    root: str
    embedder: TextEmbedder
    settings: Settings = field(default_factory=lambda: DEFAULTS)
    page_embedder: PageEmbedder | None = None
    renderer: PageRenderer | None = None
    queue: JobQueue | None = None

    def __post_init__(self) -> None:
        self.collections = Collections(self.spark, self.root)
        self.images = PageImageStore(f"{self.root}/.images")

    def has_visual(self, name: str) -> bool:
        return self.collections.exists(name + PAGES_SUFFIX)

    def ingest(self, name: str, files: DataFrame, visual_pages: DataFrame | None = None, visual: bool | None = None, from_queue: bool = False) -> IngestResult:
        """Ingests files (filename, content_type, content, and optionally doc_id, source, source_type,
        metadata). A missing doc_id is a random one, so the same file ingested again makes new chunks; with
        the doc_id given, rows are replaced. visual None means: as the base is.

        Both sides are written before either is published to readers of the other: a failure of the page side
        surfaces before the text side is touched. Pages without vectors of their own are rendered, stored and embedded
        where there are a renderer and a page embedder; their text layer is probed. With a queue, PDFs of at least the
        threshold's pages go there instead."""
        if not name or not name.strip():
            raise InvalidRequest("a knowledge base needs a name")
        text_there, pages_there = self.collections.exists(name), self.has_visual(name)
        wants = pages_there if visual is None else visual
        if pages_there and not wants:
            raise ModeConflict(f"{name} has a visual index")
        if text_there and not pages_there and wants:
            raise ModeConflict(f"{name} is text-only")
        if not self.embedder.healthy():
            raise ProviderUnavailable(self.embedder.model)
        defaults = {"doc_id": F.lit(None).cast("string"), "source": F.col("filename"), "source_type": F.lit("inline"), "metadata": F.lit(None).cast("map<string,string>")}
        for column, value in defaults.items():
            if column not in files.columns:
                files = files.withColumn(column, value)
        # the random part comes from the driver, so that a retried task gives the same id again
        files = files.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit(uuid.uuid4().hex), F.lit("-"), F.sha1(F.concat_ws("\0", "filename", "content")))))
        warnings: tuple[str, ...] = ()
        queued = None
        if wants and self.queue is not None and not from_queue:
            counted = staged(ingest.with_page_count(files), "routed")
            long = goes_to_queue(F.lit(True), F.col("pages") > 0, F.col("pages"), self.settings)
            queued = self.queue.submit_files(counted.where(long), name)
            files = counted.where(~long).drop("pages")
        rows = ingest.chunk_rows(files, self.embedder, self.settings)
        dim = len(embed_query(self.embedder, "probe"))
        pdfs = files.where(is_pdf(F.col("content_type"), F.col("filename"))).select("doc_id")
        if wants and visual_pages is None and self.renderer and self.page_embedder:
            whole = files.join(F.broadcast(pdfs.distinct()), "doc_id", "left_semi") if pdfs.count() <= SEND_DOCS else files.join(pdfs.distinct(), "doc_id", "left_semi")
            images = staged(ingest.rendered(whole, self.renderer, self.images, name, self.settings), "images")
            visual_pages = embed_pages(images, self.page_embedder, settings=self.settings).drop("png")
        if wants and visual_pages is not None:
            probe = ingest.probed(files, self.settings)
            pages = ingest.page_rows(visual_pages.join(pdfs, "doc_id", "left_semi"), probe, self.settings)
            if pages.isEmpty():
                warnings = ("visual index requested, but the input is not a PDF; text only",)
            else:
                self.collections.ensure_multi(name + PAGES_SUFFIX, [VectorField.rerank_only("original", 0), VectorField.pooled("pooled_rows", 0), VectorField.pooled("pooled_cols", 0)])
                self.collections.upsert(name + PAGES_SUFFIX, pages)
        elif wants:
            warnings = ("visual index requested, but there are no page vectors; text only",)
        self.collections.ensure_single(name, dim)
        self.collections.upsert(name, rows)
        return IngestResult(name, files.select("doc_id"), warnings, queued)

    def ingest_status(self, job_id: str) -> dict | None:
        """The state of a queued ingest; None for an unknown job, or without a queue."""
        if not job_id or not job_id.strip():
            raise InvalidRequest("a status needs a job id")
        row = self.queue.status(job_id).first() if self.queue is not None else None
        return row and row.asDict()

    def work(self, request: dict) -> str:
        """Ingests one request of the queue; the worker of JobQueue.run."""
        files = self.queue.files_of(request)
        done = self.ingest(request["kb_name"], files, visual=True if request.get("visual") else None, from_queue=True)
        return done.doc_ids.first()[0]

    def search(
        self,
        name: str,
        query: str,
        top_k: int | None = None,
        wanted: Mapping[str, str] | None = None,
        mode: str | None = None,
        strategy: str | None = None,
        page_query: list[list[float]] | None = None,
        visual_healthy: bool = True,
    ) -> SearchResponse:
        """Hits for a query. If the visual side is down, fusion and colpali_only fall back to text search with
        a warning; a failure of the text side is an error. Health is probed before the plan is built, since a
        lazy plan would fail only at its action."""
        if not name or not name.strip() or not query or not query.strip():
            raise InvalidRequest("a search needs a knowledge base and a query")
        found = modes.resolve(mode, self.has_visual(name), self.settings)
        kind, warnings = found.mode, found.warnings
        if page_query is None and self.page_embedder is not None and kind in ("fusion", "colpali_only"):
            visual_healthy = visual_healthy and self.page_embedder.healthy()
            page_query = embed_page_query(self.page_embedder, query) if visual_healthy else None
        if kind in ("fusion", "colpali_only") and not (visual_healthy and page_query):
            kind, warnings = "text_only_fallback", (*warnings, "visual search is not available; text search only")
        chunks = self.collections.read(name)
        if chunks is None:
            raise InvalidRequest(f"{name} is empty")
        otherwise = search.text_only(chunks, embed_query(self.embedder, query), top_k, wanted, settings=self.settings)
        if kind == "colpali_only":
            hits = search.pages_only(self.collections.read(name + PAGES_SUFFIX), page_query, top_k, wanted, settings=self.settings)
        elif kind == "fusion":
            hits = search.fused(chunks, self.collections.read(name + PAGES_SUFFIX), embed_query(self.embedder, query), page_query, top_k, wanted, strategy, settings=self.settings)
        else:
            return SearchResponse(name, kind, otherwise, warnings)
        return SearchResponse(name, kind, hits, warnings, otherwise)

    def list(self) -> list[dict]:
        """One entry per base; names ending in _pages are hidden."""
        out = []
        for name in self.collections.names():
            if not name.endswith(PAGES_SUFFIX):
                info = self.collections.info(name)
                pages = self.collections.info(name + PAGES_SUFFIX)
                out.append({"name": name, "vectors": info["points"], "dim": info["dim"], "visual_index": pages is not None, "visual_pages": pages["points"] if pages else 0})
        return out

    def inspect(self, name: str, doc_id: str, page: int) -> dict | None:
        """A stored page image in base64 with its key; None where there is none."""
        if not doc_id or not doc_id.strip():
            raise InvalidRequest("inspect needs a document")
        key = self.images.key(name, doc_id, page)
        content = self.images.retrieve(key)
        return content and {"key": key, "png_base64": base64.b64encode(content).decode()}

    def drop_visual(self, name: str, confirm: bool = False) -> str:
        """Drops the visual index and its images, or says what would go. The text side stays."""
        if not self.has_visual(name):
            return f"{name} has no visual index"
        if not confirm:
            return f"would drop {self.collections.info(name + PAGES_SUFFIX)['points']} pages of {name}; confirm to do so"
        pages = self.collections.info(name + PAGES_SUFFIX)["points"]
        self.collections.drop(name + PAGES_SUFFIX)
        return f"dropped {pages} pages and {self.images.delete_base(name)} images of {name}"
