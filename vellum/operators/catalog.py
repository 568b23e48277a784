"""Knowledge-base listing and keyed upserts on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES_SUFFIX = "_pages"


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of new put in place of those of the same key. Repeated keys in new: one row
    stays. Rows of new without a key are left out, as they could never be replaced."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def list_bases(collections: DataFrame) -> DataFrame:
    """From (name, vectors, points, dim) of all collections: one row per knowledge base. A collection whose
    name ends in _pages is the visual side of its base, never a base of its own."""
    visual = collections.where(F.col("name").endswith(PAGES_SUFFIX)).select(F.col("name").alias("_visual"), F.col("points").alias("_points"))
    bases = collections.where(~F.col("name").endswith(PAGES_SUFFIX))
    joined = bases.join(visual, F.concat("name", F.lit(PAGES_SUFFIX)) == F.col("_visual"), "left")
    return joined.select("name", "vectors", "dim", F.col("_visual").isNotNull().alias("visual_index"), F.coalesce("_points", F.lit(0)).cast("bigint").alias("visual_pages"))


def payload(fixed: dict[str, Column], user: Column, model: Column) -> Column:
    """A payload map: the fixed keys, then user entries under keys that are free (a fixed key with a null
    value is free), then the embedding model, which nothing overrides."""
    made = F.map_filter(F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    extra = F.coalesce(user, F.create_map().cast("map<string,string>"))
    free = F.map_filter(extra, lambda k, v: ~F.map_contains_key(made, k) & (k != "embed_model") & v.isNotNull())
    return F.map_concat(made, free, F.create_map(F.lit("embed_model"), model))
