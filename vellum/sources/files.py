"""Fetched files as rows: filename, content_type, content.

Every reader enforces the size cap as rows are read; an oversized or unreadable file is an error of the query
that reads it, as nothing of it may be silently left out.
"""

from __future__ import annotations

import base64
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import FetchError, InvalidRequest
from vellum.functions.files import content_type_of, filename_from_uri, without_charset

FILE_SCHEMA = "filename string, content_type string, content binary"
SOURCE_TYPES = ("url", "path", "inline")


def source_type(value: Column) -> Column:
    """url, path or inline in lower case; an error for anything else, null included."""
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*SOURCE_TYPES), clean).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce(value, F.lit("null")))))


def guarded(content: Column, settings: Settings = DEFAULTS) -> Column:
    """The content, or an error if it is larger than allowed."""
    return F.when(F.length(content) <= settings.max_file_bytes, content).when(content.isNull(), None).otherwise(F.raise_error(F.lit(f"file larger than {settings.max_file_bytes} bytes")))


def from_paths(spark: SparkSession, path: str, override: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Files under an absolute path (globs allowed) through the binaryFile source."""
    if not path.strip().startswith("/") and "://" not in path:
        raise InvalidRequest(f"path must be absolute: {path!r}")
    raw = spark.read.format("binaryFile").load(path)
    name = F.lit(override) if override else filename_from_uri(F.col("path"))
    size = F.when(F.col("length") <= settings.max_file_bytes, F.col("content")).otherwise(F.raise_error(F.lit(f"file larger than {settings.max_file_bytes} bytes")))
    return raw.select(name.alias("filename"), size.alias("content")).select("filename", content_type_of(F.col("filename")).alias("content_type"), "content")


def from_inline(requests: DataFrame, value: str = "source_value", filename: str = "filename", settings: Settings = DEFAULTS) -> DataFrame:
    """Decodes base64 requests. A request without a filename or with broken base64 is an error."""
    name = F.when(F.trim(F.coalesce(filename, F.lit(""))) != "", F.col(filename)).otherwise(F.raise_error(F.lit("inline requests need a filename")))
    return requests.select(name.alias("filename"), guarded(F.to_binary(F.col(value), F.lit("base64")), settings).alias("content")).select(
        "filename", content_type_of(F.col("filename")).alias("content_type"), "content"
    )


def decoded_inline(value: Column) -> Column:
    """Text of a base64 request; null where it is no base64 or no UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))


def from_requests(requests: DataFrame, timeout: float = 30.0, settings: Settings = DEFAULTS) -> DataFrame:
    """The files of requests (source_type, source_value, filename) of any type, with source and source_type: each row
    is read by its own type's rule, in the tasks. An unknown type, a relative path and an unreadable file are errors."""
    cap = settings.max_file_bytes

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, value, name in zip(batch["t"], batch["v"], batch["n"]):
                given = None
                if kind == "inline":
                    body = base64.b64decode("".join(value.split()), validate=True)  # MIME breaks lines
                elif kind == "url":
                    given, body = _fetched(value, cap, timeout)
                else:
                    if not value.startswith("/"):
                        raise InvalidRequest(f"path must be absolute: {value!r}")
                    with open(value, "rb") as f:
                        body = f.read(cap + 1)
                if len(body) > cap:
                    raise FetchError(f"{name}: larger than {cap} bytes")
                rows.append((name, given, body, value if kind != "inline" else name, kind))
            yield pd.DataFrame(rows, columns=["filename", "content_type", "content", "source", "source_type"])

    kind = source_type(F.col("source_type"))
    named = F.when(F.trim(F.coalesce("filename", F.lit(""))) != "", F.col("filename"))
    named = F.coalesce(named, F.when(kind == "inline", F.raise_error(F.lit("inline requests need a filename"))).otherwise(filename_from_uri(F.col("source_value"))))
    got = requests.select(kind.alias("t"), F.col("source_value").alias("v"), named.alias("n")).mapInPandas(fetch, FILE_SCHEMA + ", source string, source_type string")
    given = without_charset(F.col("content_type"))
    return got.withColumn("content_type", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(content_type_of(F.col("filename"))))


def _fetched(url: object, cap: int, timeout: float) -> tuple[str | None, bytes]:
    """Content type and body of an http(s) URL."""
    if not isinstance(url, str) or not url.lower().startswith(("http://", "https://")):
        raise FetchError(f"not an http(s) URL: {url!r}")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            if not 200 <= reply.status < 300:
                raise FetchError(f"{url}: status {reply.status}")
            body = reply.read(cap + 1)
            given = reply.headers.get("Content-Type")
    except OSError as e:
        raise FetchError(f"{url}: {e}") from e
    if len(body) > cap:
        raise FetchError(f"{url}: larger than {cap} bytes")
    return given, body


def from_urls(requests: DataFrame, value: str = "source_value", filename: str = "filename", timeout: float = 30.0, settings: Settings = DEFAULTS, strict: bool = True) -> DataFrame:
    """Fetches http and https URLs in the tasks. Redirects are followed; another scheme, a status outside 200-299
    and a body above the cap are errors. strict False: a failing URL is a row with null content and its error, and
    the others go on."""
    cap = settings.max_file_bytes
    columns = ["filename", "content_type", "content"] + ([] if strict else ["error"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, name in zip(batch["u"], batch["n"]):
                try:
                    given, body = _fetched(url, cap, timeout)
                    rows.append((name, given, body, None))
                except FetchError as e:
                    if strict:
                        raise
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["filename", "content_type", "content", "error"])[columns]

    wanted = F.when(F.trim(F.coalesce(filename, F.lit(""))) != "", F.col(filename)).otherwise(filename_from_uri(F.col(value)))
    got = requests.select(F.col(value).alias("u"), wanted.alias("n")).mapInPandas(fetch, FILE_SCHEMA + ("" if strict else ", error string"))
    given = without_charset(F.col("content_type"))
    return got.withColumn("content_type", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(content_type_of(F.col("filename"))))
