"""Mean pooling of patch grids along rows or columns, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.vectors import bound


def special_tokens(model: Column) -> Column:
    """Number of trailing special tokens by the model's name."""
    name = F.lower(model)
    return F.when(name.rlike("colqwen|colpali"), 6).when(name.rlike("smolvlm|colsmol"), 5).otherwise(6)


def _grid(tokens: Column, grid: Column, specials: Column) -> Column:
    """The grid side in use: a page with fewer tokens than the grid has cells has the largest square that fits
    beside the special tokens."""
    patches = F.size(tokens) - specials
    fitting = F.floor(F.sqrt(F.greatest(patches, F.lit(0)).cast("double"))).cast("int")
    return F.when(F.size(tokens) < grid * grid, fitting).otherwise(grid)


def _mean(vectors: Column) -> Column:
    """Element-wise mean of double arrays."""
    zero = F.transform(F.try_element_at(vectors, F.lit(1)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(vectors))


def _pooled(tokens: Column, grid: int | Column, specials: int | Column, along_rows: bool) -> Column:
    grid = F.lit(grid) if isinstance(grid, int) else grid
    specials = F.lit(specials) if isinstance(specials, int) else specials

    def pool(wide: Column) -> Column:
        def lines(side: Column) -> Column:
            def line(k: Column) -> Column:
                def member(j: Column) -> Column:
                    at = k * side + j if along_rows else j * side + k
                    return F.try_element_at(wide, (at + 1).cast("int"))

                return bound(F.transform(F.sequence(F.lit(0), side - 1), member), _mean)

            means = F.transform(F.sequence(F.lit(0), side - 1), line)
            kept = F.slice(wide, side * side + 1, F.greatest(specials, F.lit(0)))
            return F.when((F.size(wide) < specials) | (side <= 0), wide).otherwise(F.concat(means, kept))

        return bound(_grid(wide, grid, specials), lines)

    return F.when(tokens.isNotNull(), bound(tokens.cast("array<array<double>>"), pool))


def pool_rows(tokens: Column, grid: int | Column, specials: int | Column) -> Column:
    """One mean per grid row, then the special tokens unchanged. Tokens are patches in row order, then
    specials; what is left behind grid and specials is dropped. A page with no full grid comes back whole."""
    return _pooled(tokens, grid, specials, True)


def pool_cols(tokens: Column, grid: int | Column, specials: int | Column) -> Column:
    """One mean per grid column, then the special tokens unchanged."""
    return _pooled(tokens, grid, specials, False)
