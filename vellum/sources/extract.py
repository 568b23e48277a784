"""Page texts from file contents. Extractors are plain functions bytes -> list of page texts, registered by
content type; the DataFrame operator runs them in Arrow batches, so other formats plug in without new plans."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from vellum.config import DEFAULTS, Settings
from vellum.errors import ExtractionError

PAGE_SCHEMA = "filename string, page_number int, text string"
Extractor = Callable[[bytes], list[str]]
_extractors: dict[str, Extractor] = {}


def register_extractor(content_type: str, extractor: Extractor) -> None:
    _extractors[content_type.lower()] = extractor


class _Visible(html.parser.HTMLParser):
    """Text outside scripts and styles; block elements begin new lines."""

    HIDDEN = {"script", "style", "head", "noscript", "template"}
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(source: str) -> str:
    parser = _Visible()
    parser.feed(source)
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def _plain(content: bytes) -> list[str]:
    return [content.decode("utf-8", errors="replace")]


def _html(content: bytes) -> list[str]:
    return [html_text(content.decode("utf-8", errors="replace"))]


def _docx(content: bytes) -> list[str]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return ["\n".join(paragraphs)]


def _epub(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
        return ["\n\n".join(html_text(z.read(n).decode("utf-8", errors="replace")) for n in names)]


_string = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|(?<![A-Za-z])(?:Tj|TJ|'|\"|T\*|Td|TD|ET)(?![A-Za-z])", re.S)
_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x.isdigit() else _escapes.get(x, b"" if x == b"\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _content_text(stream: bytes) -> str:
    out: list[str] = []
    for m in _string.finditer(stream):
        token = m.group()
        if token[:1] == b"(":
            out.append(_unescaped(token[1:-1]).decode("latin-1"))
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
        elif token in (b"T*", b"Td", b"TD", b"ET", b"'", b'"'):
            out.append("\n")
    return re.sub("\n{2,}", "\n", "".join(out)).strip("\n")


def _pdf(content: bytes) -> list[str]:
    """Text of simple PDFs (unencrypted, literal strings, no object streams); a full reader can be registered
    in its place."""
    objects = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}

    def stream_of(number: int) -> bytes:
        body = objects.get(number, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompress(m.group(1)) if b"FlateDecode" in body[: m.start()] else m.group(1)

    def pages_under(number: int, seen: set[int]) -> Iterator[int]:
        if number in seen:
            return
        seen.add(number)
        body = objects.get(number, b"")
        if re.search(rb"/Type\s*/Pages\b", body):
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            for k in re.finditer(rb"(\d+)\s+\d+\s+R", kids.group(1) if kids else b""):
                yield from pages_under(int(k.group(1)), seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield number

    root = next((m for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))), None)
    if not root:
        raise ExtractionError("not a readable PDF")
    out = []
    for page in pages_under(int(root.group(1)), set()):
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[page])
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m.group(1)) if m else []
        out.append("\n".join(_content_text(stream_of(int(r))) for r in refs))
    if not out:
        raise ExtractionError("PDF without pages")
    return out


for _kind in ("text/plain", "text/markdown", "text/csv", "application/json"):
    register_extractor(_kind, _plain)
register_extractor("text/html", _html)
register_extractor("application/pdf", _pdf)
register_extractor("application/vnd.openxmlformats-officedocument.wordprocessingml.document", _docx)
register_extractor("application/epub+zip", _epub)


def pages_of(filename: str | None, content_type: str | None, content: bytes, max_chars: int) -> list[tuple[int, str]]:
    """(page number, text) of one file. Unknown types are read as UTF-8 text. Text above max_chars is an error
    for files with pages and cut off for files without, as is a file without any text."""
    name, kind = (filename or "").lower(), (content_type or "").lower()
    pdf = "pdf" in kind or name.endswith(".pdf")
    texts = _extractors["application/pdf" if pdf else kind if kind in _extractors else "text/plain"](content)
    if pdf and sum(map(len, texts)) > max_chars:
        raise ExtractionError(f"{filename}: more than {max_chars} characters")
    if not pdf:
        texts = [t[:max_chars] for t in texts]
    if not any(t.strip() for t in texts):
        raise ExtractionError(f"{filename}: no text; scanned pages need a text layer first")
    return list(enumerate(texts, 1))


def page_count(content: bytes) -> int:
    """Pages of a PDF; 0 where it cannot be read."""
    try:
        return len(_pdf(content))
    except (ExtractionError, zlib.error):
        return 0


def extract_pages(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per page of files (filename, content_type, content)."""
    cap = settings.max_text_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, n, t) for f, k, c in zip(batch["filename"], batch["content_type"], batch["content"]) for n, t in pages_of(f, k, c, cap)]
            yield pd.DataFrame(rows, columns=["filename", "page_number", "text"])

    return files.select("filename", "content_type", "content").mapInPandas(run, PAGE_SCHEMA)
