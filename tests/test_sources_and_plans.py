import base64
import dataclasses
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.errors import ExtractionError, InvalidRequest, ModeConflict, SchemaMismatch
from vellum.functions.files import png_size
from vellum.plans.backends import Backends
from vellum.plans.knowledge_base import KnowledgeBases
from vellum.sources import files, remote
from vellum.sources.embedding import HashEmbedder, HashPageEmbedder, embed_pages, health, page_family
from vellum.sources.files import from_requests, from_urls
from vellum.sources.extract import html_text, page_count, pages_of
from vellum.sources.images import PageImageStore, png
from vellum.sources.tables import Collections, VectorField
from vellum.streaming.queue import JobQueue, Request


def pdf(*pages: str) -> bytes:
    """A small PDF with a page per text."""
    body = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [%s] /Count %d >> endobj" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, text in enumerate(pages):
        content = zlib.compress(b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % text.replace("(", "\\(").replace(")", "\\)").encode("latin-1"))
        body.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
        body.append(b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj" % (11 + 2 * i, len(content), content))
    return b"%PDF-1.4\n" + b"\n".join(body)


def test_extraction():
    assert pages_of("a.pdf", None, pdf("One (1)", "Two"), 100) == [(1, "One (1)"), (2, "Two")]
    assert page_count(pdf("a", "b", "c")) == 3 and page_count(b"nothing") == 0
    with pytest.raises(ExtractionError):
        pages_of("a.pdf", None, pdf("x" * 60, "y" * 60), 100)
    with pytest.raises(ExtractionError):
        pages_of("a.pdf", None, pdf(" "), 100)
    assert pages_of("a.txt", "text/plain", b"x" * 200, 100) == [(1, "x" * 100)]
    assert html_text("<head><title>t</title></head><p>Hi&amp;<b>bye</b><script>no()</script></p><p>end</p>") == "Hi&bye\n\nend"


def test_paths_inline_and_types(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    row = files.from_paths(spark, str(tmp_path)).first()
    assert (row["filename"], row["content_type"], bytes(row["content"])) == ("a.txt", "text/plain", b"hello")
    with pytest.raises(InvalidRequest):
        files.from_paths(spark, "relative")
    with pytest.raises(Exception, match="larger than"):
        files.from_paths(spark, str(tmp_path), settings=Settings(max_file_bytes=2)).collect()
    df = spark.createDataFrame([(base64.b64encode(b"hi").decode(), "x.md")], "source_value string, filename string")
    assert bytes(files.from_inline(df).first()["content"]) == b"hi"
    with pytest.raises(Exception, match="filename"):
        files.from_inline(df.withColumn("filename", F.lit(" "))).collect()
    kinds = spark.createDataFrame([(" URL ",), ("Path",)], "t string")
    assert [r[0] for r in kinds.select(files.source_type(F.col("t"))).collect()] == ["url", "path"]
    with pytest.raises(Exception, match="unknown source type"):
        spark.createDataFrame([("ftp",)], "t string").select(files.source_type(F.col("t"))).collect()


class Service(BaseHTTPRequestHandler):
    polls = 0

    def reply(self, body: bytes, kind: str = "application/json") -> None:
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path.endswith("/process/status"):
            Service.polls += 1
            self.reply(b'{"status": "completed"}' if Service.polls > 1 else b'{"status": "pending"}')
        elif self.path.endswith("/knowledge/"):
            self.reply(b'{"items": [{"id": "k1", "name": "docs"}]}')
        elif self.path == "/gone":
            self.send_error(404)
        else:
            self.reply(b"<p>page</p>", "text/html; charset=utf-8")

    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        self.reply(b'{"id": "f1"}')

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_urls(spark, service):
    df = spark.createDataFrame([(f"{service}/a/b.html", None)], "source_value string, filename string")
    row = files.from_urls(df).first()
    assert (row["filename"], row["content_type"], bytes(row["content"])) == ("b.html", "text/html", b"<p>page</p>")
    for bad in (f"{service}/gone", "ftp://x/y"):
        with pytest.raises(Exception):
            files.from_urls(spark.createDataFrame([(bad, None)], "source_value string, filename string")).collect()


def test_remote_service(service):
    client = remote.RemoteBases(service, "t")
    assert client.find_or_create("docs")["id"] == "k1" and client.find_or_create("new")["id"] == "f1"
    assert client.ingest("docs", "a.txt", b"x", "text/plain") == {"base": "k1", "file_id": "f1", "status": "completed"}


def test_poll_backs_off():
    pauses, now = [], [0.0]
    state = remote.poll(lambda: "pending", 10, lambda s: (pauses.append(s), now.__setitem__(0, now[0] + s)), lambda: now[0])
    assert state == "timeout" and pauses[:5] == [0.2, 0.4, 0.8, 1.6, 2.0]


def test_images(spark, tmp_path):
    picture = png(np.zeros((4, 6, 3), np.uint8))
    df = spark.createDataFrame([(bytearray(picture),), (bytearray(b"short"),)], "p binary")
    assert [tuple(r) for r in df.select(*png_size(F.col("p"))).collect()] == [(6, 4), (None, None)]
    store = PageImageStore(str(tmp_path))
    assert store.store("docs", "d-1", 1, picture) == "docs/d-1/000001.png" and store.retrieve("docs/d-1/000001.png") == picture
    assert store.retrieve("../x") is None and store.retrieve("") is None
    for bad in ("", "a/b", "..", ".hidden"):
        with pytest.raises(InvalidRequest):
            store.key(bad, "d", 1)
    assert store.delete_document("docs", "d-1") == 1 and store.delete_base("docs") == 0
    for kind, channels in (("GRAY", 1), ("ARGB", 4), ("bgr", 3), ("BINARY", 1)):
        assert png(np.ones((2, 2, channels), np.uint8), kind)[:4] == b"\x89PNG"


def test_collections(spark, tmp_path):
    c = Collections(spark, str(tmp_path))
    c.ensure_single("docs", 3)
    c.ensure_single("docs", 3)
    with pytest.raises(SchemaMismatch):
        c.ensure_single("docs", 4)
    with pytest.raises(SchemaMismatch):
        c.ensure_multi("docs", [VectorField.pooled("pooled_rows", 3)])
    rows = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    c.upsert("docs", rows)
    c.upsert("docs", rows)
    assert c.info("docs")["points"] == 1 and c.names() == ["docs"] and c.info("none") is None
    assert c.drop("docs") and not c.drop("docs")


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBases(spark, str(tmp_path), HashEmbedder(32), Settings(chunk_size=80, chunk_overlap=10))
    docs = spark.createDataFrame(
        [("d1", "a.pdf", "application/pdf", bytearray(pdf("The harbour has a lighthouse.", "A second page about boats."))), ("d2", "b.txt", "text/plain", bytearray(b"Nothing but apples and pears."))],
        "doc_id string, filename string, content_type string, content binary",
    )
    assert kb.ingest("docs", docs).warnings == ()
    kb.ingest("docs", docs)
    assert kb.list() == [{"name": "docs", "vectors": 2, "dim": 32, "visual_index": False, "visual_pages": 0}]
    found = kb.search("docs", "lighthouse in the harbour", 1)
    assert found.mode == "text_only" and found.hits.first()["doc_id"] == "d1" and found.confidence() in ("low", "medium")
    assert kb.search("docs", "apples", mode="fusion").mode == "text_only_fallback"
    with pytest.raises(ModeConflict):
        kb.ingest("docs", docs, visual=True)
    with pytest.raises(InvalidRequest):
        kb.search("docs", " ")
    images = spark.createDataFrame([("d1", 1, bytearray(b"page one" * 30)), ("d1", 2, bytearray(b"page two" * 30)), ("d2", 1, bytearray(b"not a pdf" * 30))], "doc_id string, page_number int, png binary")
    pages = embed_pages(images, HashPageEmbedder())
    assert kb.ingest("scans", docs, pages, visual=True).warnings == ()
    query = [r.tolist() for r in HashPageEmbedder().embed_page(b"page two" * 30)]
    fused = kb.search("scans", "boats", 3, page_query=query)
    assert fused.mode == "fusion" and {r["doc_id"] for r in fused.hits.collect()} == {"d1", "d2"}
    only = kb.search("scans", "boats", 1, mode="colpali_only", page_query=query).hits.first()
    assert only["page_start"] == 2 and only["chunk_index"] == -1
    assert kb.search("scans", "boats", page_query=query, visual_healthy=False).mode == "text_only_fallback"
    kb.images.store("scans", "d1", 1, b"png")
    assert kb.inspect("scans", "d1", 1)["key"] == "scans/d1/000001.png" and kb.inspect("scans", "d1", 9) is None
    assert kb.drop_visual("scans").startswith("would drop 2 pages") and kb.drop_visual("scans", True) == "dropped 2 pages and 1 images of scans"
    assert kb.drop_visual("scans", True) == "scans has no visual index"
    only_text = kb.ingest("texts", docs.where("doc_id = 'd2'"), pages, visual=True)
    assert "not a PDF" in only_text.warnings[0] and not kb.has_visual("texts")


def test_queue(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "q"))
    first, second = queue.submit(Request("inline", "eA==", "docs", "a.txt")), queue.submit(Request("inline", "bad", "docs", "b.txt"))
    assert {r["status"] for r in queue.states().collect()} == {"QUEUED"}

    def work(request: dict) -> str:
        if request["source_value"] == "bad":
            raise RuntimeError()
        return "doc-1"

    queue.run(work, str(tmp_path / "cp")).awaitTermination(60)
    got = {r["job_id"]: (r["status"], r["doc_id"], r["error"]) for r in queue.states().collect()}
    assert got == {first: ("COMPLETED", "doc-1", None), second: ("FAILED", None, "RuntimeError")}
    queue._append([("stuck", "IN_PROGRESS", None, None, 0), ("spent", "IN_PROGRESS", None, None, 3)])
    assert queue.recover() == 2
    got = {r["job_id"]: (r["status"], r["retry_count"]) for r in queue.states().collect()}
    assert got["stuck"] == ("QUEUED", 1) and got["spent"] == ("FAILED", 3) and got[first][0] == "COMPLETED"
    (tmp_path / "q" / "requests" / "broken.json").write_text("{not json")
    assert queue.corrupt_requests().count() == 1


def test_every_request_of_a_file_is_taken(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "q"))
    rows = [json.dumps({"job_id": f"j{i:02}", "source_type": "inline", "source_value": "eA==", "filename": "a.txt", "kb_name": "docs", "submitted_at": "2024-01-01T00:00:00Z"}) for i in range(40)]
    (tmp_path / "q" / "requests" / "many.json").write_text("\n".join(rows))
    (tmp_path / "q" / "requests" / "broken.json").write_text("{not json")
    assert queue.set_corrupt_aside() == 1 and queue.corrupt_requests().count() == 0
    queue._append([("j00", "QUEUED", None, None, 0)])
    queue.run(lambda r: r["job_id"], str(tmp_path / "cp"), per_batch=2, workers=4).awaitTermination(120)
    got = {r["job_id"]: (r["status"], r["doc_id"]) for r in queue.states().collect()}
    assert got == {f"j{i:02}": ("COMPLETED", f"j{i:02}") for i in range(40)}
    assert queue.compact() == 40 and {r["job_id"]: (r["status"], r["doc_id"]) for r in queue.states().collect()} == got


def test_requests_of_all_types(spark, tmp_path):
    (tmp_path / "x.md").write_text("path text")
    rows = [(" Inline ", base64.b64encode(b"inline text").decode(), "a.txt"), ("PATH", str(tmp_path / "x.md"), None)]
    got = {r["filename"]: (bytes(r["content"]), r["content_type"], r["source_type"]) for r in from_requests(spark.createDataFrame(rows, "source_type string, source_value string, filename string")).collect()}
    assert got == {"a.txt": (b"inline text", "text/plain", "inline"), "x.md": (b"path text", "text/markdown", "path")}
    for bad in (("ftp", "x", "a"), ("path", "rel/x", "a"), ("inline", "eA==", " "), ("url", "file:///etc/hosts", "a")):
        with pytest.raises(Exception):
            from_requests(spark.createDataFrame([bad], "source_type string, source_value string, filename string")).collect()
    urls = spark.createDataFrame([("http://127.0.0.1:9/none", None), ("nonsense", "b")], "source_value string, filename string")
    lenient = from_urls(urls, strict=False, timeout=2).collect()
    assert len(lenient) == 2 and all(r["content"] is None and r["error"] for r in lenient)


def test_visual_ingest_renders_probes_and_routes(spark, tmp_path):
    class OneImageAPage:
        """Stands in for a renderer: the bytes of a PNG header and the page's number."""

        def render(self, content: bytes, dpi: int) -> list[bytes]:
            return [png(np.full((3, 5), n, np.uint8), "GRAY") + bytes([n]) * 64 for n in range(1, content.count(b"/Type /Page ") + content.count(b"/Type/Page ") + 1)]

    long_text = "The harbour has a lighthouse and the town has a mill. " * 12
    pages = pdf(long_text, "Short.")
    count = len(OneImageAPage().render(pages, 150))
    queue = JobQueue(spark, str(tmp_path / "q"))
    kb = KnowledgeBases(spark, str(tmp_path / "kb"), HashEmbedder(32), Settings(queue_page_threshold=3), HashPageEmbedder(), OneImageAPage(), queue)
    docs = spark.createDataFrame([("d1", "a.pdf", "application/pdf", bytearray(pages)), ("d2", "big.pdf", "application/pdf", bytearray(pdf("one page", "two page", "three page")))], "doc_id string, filename string, content_type string, content binary")
    done = kb.ingest("docs", docs, visual=True)
    assert [r["doc_id"] for r in done.doc_ids.collect()] == ["d1"] and [r["doc_id"] for r in done.queued.collect()] == ["d2"]
    assert count == 2
    stored = {r["page_number"]: (r["text_quality"], r["page_image_key"], r["page_width"]) for r in kb.collections.read("docs_pages").collect()}
    assert stored == {1: (2, "docs/d1/000001.png", 5), 2: (0, "docs/d1/000002.png", 5)}
    assert kb.inspect("docs", "d1", 2)["key"] == "docs/d1/000002.png"
    hit = kb.search("docs", "lighthouse", 1, mode="colpali_only").run().hits.first()
    assert hit["page_image_key"].startswith("docs/d1/") and hit["filename"] == "a.pdf" and hit["metadata"]["text_quality"] in ("0", "2")
    fused = kb.search("docs", "lighthouse mill", 3).run()
    assert fused.mode == "fusion" and "lighthouse" in fused.hits.first()["text"]
    queue.run(kb.work, str(tmp_path / "cp")).awaitTermination(180)
    job = done.queued.first()["job_id"]
    assert kb.ingest_status(job)["status"] == "COMPLETED" and kb.ingest_status(job)["doc_id"] == "d2" and kb.ingest_status("none") is None
    assert {r["doc_id"] for r in kb.collections.read("docs").select("doc_id").distinct().collect()} == {"d1", "d2"}
    broken = kb.search("docs", "lighthouse", 2)
    broken = dataclasses.replace(broken, hits=broken.hits.withColumn("score", F.raise_error(F.lit("no visual side")).cast("double")))
    assert broken.run().mode == "text_only_fallback" and "no visual side" in broken.run().warnings[-1] and broken.run().hits.count() == 2


def test_listing_goes_on_over_a_failing_backend():
    class Good:
        def list(self):
            return [{"name": "docs"}]

    class Bad:
        def list(self):
            raise RuntimeError("down")

    assert Backends({"store": Good(), "web": Bad()}, "store").list() == [{"backend": "store", "name": "docs"}, {"backend": "web", "error": "down"}]
    assert health(HashEmbedder(8), HashPageEmbedder()) == {"text": True, "pages": True}


def test_backends_and_models():
    b = Backends({"store": 1, "Web": 2}, "store")
    assert b.pick(None) == 1 and b.pick(" WEB ") == 2
    with pytest.raises(InvalidRequest):
        b.pick("other")
    assert page_family("vidore/ColQwen2") == "colqwen" and page_family("SmolVLM-x") == "colsmol"
