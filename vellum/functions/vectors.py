"""Vector arithmetic on array columns. Elements are widened to double before any product."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: Catalyst would repeat the expression wherever it is mentioned, which
    inside nested lambdas means once per element."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[literal(r) for r in rows])


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; null where either is null or all zero, or the lengths differ."""

    def ratio(a: Column) -> Column:
        length = norm(a) * norm(b)
        return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)

    return bound(a, ratio)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for every query vector the best dot product in the document, summed."""

    def total(document: Column) -> Column:
        best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
        return F.when(F.size(document) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x))

    return bound(document, total)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector can be compared: present, of length dim, without NaN or null, not all zero."""
    return (
        vector.isNotNull()
        & (F.size(vector) == dim)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
        & F.exists(vector, lambda x: x != 0)
    )


def same_length(rows: Column) -> Column:
    """Whether all inner arrays have one length; true for an empty array."""
    return F.forall(rows, lambda r: F.size(r) == F.size(F.try_element_at(rows, F.lit(1))))


def vector_dim(original: Column, pooled_rows: Column) -> Column:
    """Length of the first vector of the first array that holds one."""
    def first(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.size(F.try_element_at(x, F.lit(1))))

    return F.coalesce(first(original), first(pooled_rows))
