"""Sliding-window chunks that end at natural breaks and carry the pages they cover.

The cut positions form a recurrence (each start depends on the previous end), so a document is cut in one
sequential pass. Whole-text rows are cut where they lie, without a shuffle. Page rows are brought together by
document and streamed in page order: a task holds one window of text, never a whole document.
Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import InvalidRequest
from vellum.functions.text import normalised

PAGE_SEPARATOR = "\n\n"
#: Breaks in the order in which they are tried; a cut falls behind the break.
BREAKS = ("\n\n", ". ", "\n", " ")

CHUNK_COLUMNS = "chunk_index int, char_start int, char_end int, text string, page_start int, page_end int"

_blank_runs = re.compile("\n{3,}")
_edge = "".join(map(chr, range(33)))


def normalise(text: str | None) -> str:
    return _blank_runs.sub("\n\n", text or "").strip(_edge)


def window_end(text: str, start: int, size: int) -> int:
    """Where the window that starts at start ends, if text goes on behind it."""
    limit = start + size
    middle = start + size // 2
    for mark in BREAKS:
        at = text.rfind(mark, middle, limit)
        if at >= 0:
            return at + len(mark)
    return limit


def next_start(start: int, end: int, overlap: int) -> int:
    return end - overlap if end - overlap > start else end


def cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    start = 0
    while True:
        end = len(text) if len(text) - start <= size else window_end(text, start, size)
        yield start, end
        if end >= len(text):
            return
        start = next_start(start, end, overlap)


class PageWindow:
    """The pages of one document, fed in order; gives chunks as soon as they are certain."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.text, self.base, self.start, self.index = "", 0, 0, 0
        self.spans: list[tuple[int, int, int]] = []  # page, start, end in the joined text

    def feed(self, page: int, text: str) -> Iterator[tuple]:
        if self.spans:
            self.text += PAGE_SEPARATOR
        at = self.base + len(self.text)
        self.text += text
        self.spans.append((page, at, at + len(text)))
        while self.base + len(self.text) - self.start > self.size:
            end = self.base + window_end(self.text, self.start - self.base, self.size)
            yield self._chunk(end)
            self.start = next_start(self.start, end, self.overlap)
            self._forget()

    def finish(self) -> Iterator[tuple]:
        total = self.base + len(self.text)
        # the window that reaches the end of the text is the last one
        if self.spans and self.start < total:
            yield self._chunk(total)

    def _chunk(self, end: int) -> tuple:
        inside = [p for p, s, e in self.spans if e > self.start and s < end]
        if inside:
            first, last = inside[0], inside[-1]
        else:  # only a separator: the nearest page before it, else the first
            before = [p for p, s, _ in self.spans if s <= self.start]
            first = last = before[-1] if before else self.spans[0][0]
        row = (self.index, self.start, end, self.text[self.start - self.base : end - self.base], first, last)
        self.index += 1
        return row

    def _forget(self) -> None:
        gone = [k for k, (_, s, _) in enumerate(self.spans) if s <= self.start]
        if gone:
            self.spans = self.spans[gone[-1] :]
        cut = self.start - self.base
        self.text, self.base = self.text[cut:], self.start


def chunk_pages_of(pages: Iterable[tuple[int, str | None]], size: int, overlap: int) -> list[tuple]:
    """Chunks of one document from (page number, text) in page order; blank pages are left out."""
    window, out = PageWindow(size, overlap), []
    for page, text in pages:
        if clean := normalise(text):
            out += window.feed(page, clean)
    return out + list(window.finish())


def chunk_text(text: str | None, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> list[tuple]:
    """Chunks of one text, all on page 1. A blank text is an error here; the DataFrame operators drop it."""
    Settings(chunk_size=size, chunk_overlap=overlap)
    if not normalise(text):
        raise InvalidRequest("no text to chunk")
    return chunk_pages_of([(1, text)], size, overlap)


def chunk_documents(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """One row per chunk of whole-text rows: the key and CHUNK_COLUMNS. Rows with a null key or a blank text
    give none; repeated rows give repeated chunks. No shuffle."""
    size, overlap = settings.chunk_size, settings.chunk_overlap
    kind = df.schema[key].dataType.simpleString()
    wanted = df.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t")).where("k IS NOT NULL AND t <> ''")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, s, e, t[s:e], 1, 1) for k, t in zip(batch["k"], batch["t"]) for i, (s, e) in enumerate(cuts(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, *_names()])

    return wanted.mapInPandas(cut, f"`{key}` {kind}, {CHUNK_COLUMNS}")


def _names() -> list[str]:
    return [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]


def chunk_pages(df: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """One row per chunk of page rows, joined by document in page order with an empty line between pages.
    Blank pages and rows with null keys are left out. One row per (document, page) is expected."""
    size, overlap = settings.chunk_size, settings.chunk_overlap
    kind = df.schema[doc].dataType.simpleString()
    pages = (
        df.select(F.col(doc).alias("d"), F.col(page).cast("int").alias("p"), normalised(F.col(text)).alias("t"))
        .where("d IS NOT NULL AND p IS NOT NULL AND t <> ''")
        .repartition("d")
        .sortWithinPartitions("d", "p", "t")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, None
        for batch in batches:
            rows: list[tuple] = []
            for d, p, t in zip(batch["d"], batch["p"], batch["t"]):
                if d != current:
                    if window is not None:
                        rows += [(current, *c) for c in window.finish()]
                    current, window = d, PageWindow(size, overlap)
                rows += [(d, *c) for c in window.feed(int(p), t)]
            yield pd.DataFrame(rows, columns=[doc, *_names()])
        if window is not None:
            yield pd.DataFrame([(current, *c) for c in window.finish()], columns=[doc, *_names()])

    return pages.mapInPandas(cut, f"`{doc}` {kind}, {CHUNK_COLUMNS}")


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open interval overlap."""
    return (other_end > start) & (other_start < end)
