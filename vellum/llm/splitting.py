"""Splitting oversized texts at natural boundaries.

Within a text, the lengths of its tokens (runs of non-blanks with the blanks behind them) are summed to offsets;
the boundaries behind paragraphs, sentences, lines and words are sorted arrays of such offsets. A piece ends at
the last boundary under the limit, found by binary search, of the best kind that has one in the piece's second
half; else at the last boundary of any kind; else it is cut hard at the limit. The next piece starts exactly the
overlap before that end.

Where a text lies in its document is found from the text itself, not from stored offsets: windows of WINDOW
characters are picked by their hash alone, in pages and in oversized texts alike, and joined by document and
hash; the start that most of a text's windows agree on is its place. The stored offset only breaks ties, and
stands where the document has no pages.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import normalised, page_range
from vellum.operators.pages import latest_pages, page_offsets
from vellum.session import staged

LIMIT, OVERLAP = 1500, 200
#: Length of a window in characters, and one in how many windows is picked.
WINDOW, EVERY = 16, 128
#: Pages and pieces meet in blocks of so many characters of a document.
BLOCK = 8192
#: The documents of oversized chunks are sent to all tasks up to so many; more are joined by shuffle.
SEND_DOCS = 500_000

_kinds = [re.compile(x) for x in (r"\n[ \t]*\n\s*", r"[.!?;…]+[\"'”’)\]]*\s+|[。！？；]+\s*", r"\n", r"\s+")]


def boundaries(text: str) -> list[list[int]]:
    """Offsets behind each kind of break, best kind first, each sorted."""
    marks = [[m.end() for m in kind.finditer(text)] for kind in _kinds[:3]]
    tokens = np.fromiter((m.end() - m.start() for m in re.finditer(r"\S*\s+|\S+$", text)), dtype=np.int64)
    words = np.cumsum(tokens)  # prefix sums of token lengths: where each token ends
    return [*marks, words[words < len(text)].tolist()]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text. A text within the limit is one piece; an empty text has none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be in [0, limit)")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    marks, out, start = boundaries(text), [], 0
    while n - start > limit:
        out.append((start, end := _cut(text, marks, start, limit, overlap)))
        start = end - overlap
    return [*out, (start, n)]


def _cut(text: str, marks: list[list[int]], start: int, limit: int, overlap: int) -> int:
    last = [kind[k - 1] if (k := bisect_right(kind, start + limit)) else 0 for kind in marks]
    floor = start + max(overlap, limit // 2)
    for at in last:
        if at > floor:
            return at
    if max(last) > start + overlap:
        return max(last)
    end = start + limit
    while end > start + overlap + 1 and unicodedata.combining(text[end]):  # a mark stays with its letter
        end -= 1
    return end


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per id of the chunks whose text is longer than the limit; a row written twice counts once (of
    differing texts the longest stays). Null texts are none, rows without an id are left out."""
    wanted = ["id", "doc_id", "chunk_index", "char_start", "char_end", "page_start", "page_end", "text"]
    big = chunks.select(*wanted).where((F.length("text") > limit) & F.col("id").isNotNull())
    order = F.struct(F.length("text"), "text", F.coalesce("char_start", F.lit(-1)))
    return big.groupBy("id").agg(F.max_by(F.struct(*wanted[1:]), order).alias("r")).select("id", "r.*")


def split(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, piece_index, piece_start, piece_end (within the text) and text of the pieces of rows (id, text).
    No shuffle; null and empty texts give no piece."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, k, s, e, t[s:e]) for i, t in zip(batch["id"], batch["text"]) for k, (s, e) in enumerate(pieces(t, limit, overlap))]
            yield pd.DataFrame(out, columns=["id", "piece_index", "piece_start", "piece_end", "text"])

    return rows.select("id", "text").where("text IS NOT NULL").mapInPandas(run, f"id {kind}, piece_index int, piece_start int, piece_end int, text string")


def anchors(text: str, window: int = WINDOW, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the picked windows of a text; which are picked depends on their content only."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(h % np.uint64(every) == 0)
    return at, h[at].astype(np.int64)


def _anchor_rows(df: DataFrame, keys: list[str], once: bool) -> DataFrame:
    """The keys, hash and position of the windows of df's text; once: the first of equal windows in a text."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at, hashes = [], [], []
            for i, text in enumerate(batch["text"]):
                a, h = anchors(text)
                if once and len(h):
                    h, first = np.unique(h, return_index=True)
                    a = a[first]
                rows.append(np.full(len(a), i))
                at.append(a)
                hashes.append(h)
            if rows:
                out = batch[keys].iloc[np.concatenate(rows)].reset_index(drop=True)
                yield out.assign(hash=np.concatenate(hashes), at=np.concatenate(at))

    return df.select(*keys, "text").mapInPandas(run, f"{kinds}, hash bigint, at bigint")


def stored_start() -> Column:
    """The best guess from stored offsets: either end if they fit the length, swapped or not, else what there is."""
    s, e, n = F.col("char_start"), F.col("char_end"), F.length("text")
    return (
        F.when(F.abs(e - s) == n, F.least(s, e))
        .when((s >= 0) & ((e.isNull()) | (s < e)), s)
        .when(e >= n, e - n)
        .when((s >= 0) & (e >= 0), F.least(s, e))
        .when(F.col("chunk_index") == 0, 0)
        .otherwise(s)
    )


def located(big: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds to big: from_char, its true start in the joined texts of pages (those of its documents), and found,
    whether the text itself says so. Without pages, or where no window of the text occurs in them, the stored offsets decide."""
    mine = latest_pages(pages).select("doc_id", "page_number", normalised(F.col("text")).alias("text")).where("text <> ''")
    where = page_offsets(mine).select("doc_id", "page_number", "page_from")
    seen = _anchor_rows(mine, ["doc_id", "page_number"], False).join(where, ["doc_id", "page_number"])
    spots = seen.select("doc_id", "hash", (F.col("page_from") + F.col("at")).alias("spot"))
    asked = _anchor_rows(big.where("doc_id IS NOT NULL"), ["doc_id", "id"], True)
    votes = asked.join(spots, ["doc_id", "hash"]).groupBy("id", (F.col("spot") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    guess = big.withColumn("stored", stored_start().cast("bigint"))
    order = F.struct("votes", -F.abs(F.coalesce(F.col("start") - F.col("stored"), F.lit(0))), -F.col("start"))
    best = votes.join(guess.select("id", "stored"), "id").groupBy("id").agg(F.max_by("start", order).alias("by_text"))
    return guess.join(best, "id", "left").withColumns({"from_char": F.coalesce("by_text", "stored"), "found": F.col("by_text").isNotNull()}).drop("by_text", "stored")


def split_oversized(chunks: DataFrame, pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, doc_id, piece_index, char_start, char_end, page_start, page_end, found, text: the pieces of all
    oversized chunks with offsets in the document's joined page texts and the pages they touch. A piece that
    touches none (only a separator) has the page before it. Documents without pages keep the corrected stored
    page range; offsets are null only where nothing is known of them."""
    big = staged(oversized(chunks, limit), "oversized")
    docs = big.where("doc_id IS NOT NULL").select("doc_id").distinct()
    pages = pages.join(F.broadcast(docs) if docs.count() <= SEND_DOCS else docs, "doc_id", "left_semi")
    big = located(big, pages)
    first, last = page_range(F.col("page_start"), F.col("page_end"))
    about = big.select("id", "doc_id", "from_char", "found", first.alias("stored_first"), last.alias("stored_last"))
    cut = split(big.select("id", "text"), limit, overlap).join(about, "id")
    cut = cut.withColumns({"char_start": F.col("from_char") + F.col("piece_start"), "char_end": F.col("from_char") + F.col("piece_end")})
    spans = page_offsets(latest_pages(pages))
    # a page also stands for the separator behind it, where no other page is
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("page_from") / BLOCK), F.floor((F.col("page_to") + 1) / BLOCK))))
    want = cut.where("found").select("id", "piece_index", "doc_id", "char_start", "char_end")
    want = want.withColumn("block", F.explode(F.sequence(F.floor(F.col("char_start") / BLOCK), F.floor(F.col("char_end") / BLOCK))))
    touch = (F.col("page_to") > F.col("char_start")) & (F.col("page_from") < F.col("char_end"))
    near = (F.col("page_to") + 2 > F.col("char_start")) & (F.col("page_from") < F.col("char_end"))
    tagged = (
        want.join(spans, ["doc_id", "block"])
        .where(near)
        .groupBy("id", "piece_index")
        .agg(
            F.coalesce(F.min(F.when(touch, F.col("page_number"))), F.min("page_number")).alias("page_start"),
            F.coalesce(F.max(F.when(touch, F.col("page_number"))), F.min("page_number")).alias("page_end"),
        )
    )
    return cut.join(tagged, ["id", "piece_index"], "left").select(
        "id", "doc_id", "piece_index", "char_start", "char_end",
        F.coalesce("page_start", "stored_first").alias("page_start"), F.coalesce("page_end", "stored_last").alias("page_end"), "found", "text",
    )


def found(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the chunks that the operator cuts into more than one piece."""
    cut = split(oversized(chunks, limit).select("id", "text"), limit, overlap)
    return cut.where("piece_index = 1").select("id")
