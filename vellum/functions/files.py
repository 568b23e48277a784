"""File names, content types and binary headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by extension.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "json": "application/json",
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
OCTET_STREAM = "application/octet-stream"


def extension(filename: Column) -> Column:
    """What follows the last dot, lower-cased; null where there is none or nothing follows it."""
    found = F.lower(F.regexp_extract(filename, r"\.([^.]*)\z", 1))
    return F.when(found != "", found)


def content_type_of(filename: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(extension(filename), F.lit(""))), F.lit(OCTET_STREAM))


def filename_from_uri(uri: Column) -> Column:
    """The last segment of the URI's path; "download" where the path is empty or ends in a slash."""
    path = F.regexp_replace(F.regexp_replace(uri, r"[?#].*\z", ""), r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    tail = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.when(uri.isNotNull(), F.when(tail == "", "download").otherwise(tail))


def without_charset(content_type: Column) -> Column:
    return F.trim(F.substring_index(content_type, ";", 1))


def is_pdf(content_type: Column, filename: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))


def png_size(png: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's header, which is all that is looked at; null below 24 bytes."""
    def big_endian(at: int) -> Column:
        return F.conv(F.hex(F.substring(png, at, 4)), 16, 10).cast("int")

    whole = F.length(png) >= 24
    return F.when(whole, big_endian(17)), F.when(whole, big_endian(21))


def image_key(kb: Column, doc_id: Column, page_number: Column) -> Column:
    return F.format_string("%s/%s/%06d.png", kb, doc_id, page_number)


def safe_segment(value: Column, dot_start: bool = True) -> Column:
    """Whether a string can be one segment of a key. dot_start: may it start with a dot."""
    fine = value.isNotNull() & (F.trim(value) != "") & ~value.rlike(r"[/\\]") & ~value.isin(".", "..")
    return fine if dot_start else fine & ~value.startswith(".")
