"""Deterministic point ids: UUID version 5 in the RFC 4122 URL namespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the RFC 4122 namespace for URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """UUIDv5 of a string column; null for null. The digest is patched with the version nibble 5 and the
    RFC variant bits, wholly in built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_point_id(doc_id: Column, chunk_index: Column) -> Column:
    return F.when(
        doc_id.isNotNull() & chunk_index.isNotNull(),
        uuid5(F.concat(doc_id.cast("string"), F.lit(":"), chunk_index.cast("string"))),
    )


def page_point_id(doc_id: Column, page_number: Column) -> Column:
    return F.when(
        doc_id.isNotNull() & page_number.isNotNull(),
        uuid5(F.concat(doc_id.cast("string"), F.lit(":page:"), page_number.cast("string"))),
    )
