"""Vector search: filters before scoring, exact top-k, two-stage search, batches of queries."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.functions.vectors import cosine, doubles, literal, literal_matrix, max_sim, usable


def metadata_filter(df: DataFrame, wanted: Mapping[str, str] | None, metadata: str = "metadata") -> DataFrame:
    """Rows for which every key equals its value. A key is a column where one has that name (so that the
    filter reaches the scan), else an entry of the metadata map. None and {} keep all rows; a null value
    matches none."""
    if not wanted:
        return df
    tests = [(F.col(f"`{k}`") if k in df.columns else F.col(metadata)[k]) == F.lit(v) for k, v in wanted.items()]
    return df.where(functools.reduce(operator.and_, tests))


def best(df: DataFrame, k: int, score: str, tie: str) -> DataFrame:
    """The k best rows by score, then by tie. Plans as TakeOrderedAndProject: k rows of each task."""
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(tie)).limit(k)


def ranked(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Adds positions from 1 to a short list of hits."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))


def cosine_topk(points: DataFrame, query: Sequence[float], k: int | None = None, vector: str = "vector", tie: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """The k points nearest to the query by cosine, with column score. Unusable vectors take no part.
    k None or below 1 means the default."""
    k = k if k and k > 0 else settings.text_top_k
    scored = points.where(usable(F.col(vector), len(query))).withColumn("score", cosine(doubles(F.col(vector)), literal(query)))
    return best(scored, k, "score", tie)


def max_sim_topk(pages: DataFrame, query: Sequence[Sequence[float]], k: int, field: str = "original", tie: str = "id") -> DataFrame:
    scored = pages.withColumn("score", max_sim(literal_matrix(query), F.col(field).cast("array<array<double>>")))
    return best(scored, k, "score", tie)


def two_stage(pages: DataFrame, query: Sequence[Sequence[float]], k: int | None = None, tie: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """Prefetch by each pooled field, then late interaction with the full vectors over the union.

    The prefetches read only their own field. The candidate ids are few by construction (two limits), so the
    full vectors are fetched with a broadcast semi-join."""
    k = k if k and k > 0 else settings.page_top_k
    reach = k * settings.prefetch_factor
    ids = [max_sim_topk(pages.select(tie, f), query, reach, f, tie).select(tie) for f in ("pooled_rows", "pooled_cols")]
    candidates = ids[0].union(ids[1]).distinct()
    return max_sim_topk(pages.join(F.broadcast(candidates), tie, "left_semi"), query, k, "original", tie)


def _nearest(qids: np.ndarray, q: np.ndarray, pids: np.ndarray, p: np.ndarray, k: int) -> pd.DataFrame:
    """The k best points per query (score, then id), from unit vectors."""
    scores = q @ p.T
    out_q, out_p, out_s = [], [], []
    for i in range(len(qids)):
        row = scores[i]
        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
        at = at[np.lexsort((pids[at], -np.round(row[at], 9)))]
        at = at[pids[at] != qids[i]][:k]
        out_q += [qids[i]] * len(at)
        out_p += list(pids[at])
        out_s += list(row[at])
    return pd.DataFrame({"q": out_q, "p": out_p, "score": np.array(out_s, dtype=float)})


def _unit(column: pd.Series) -> np.ndarray:
    m = np.vstack(column.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1)[:, None]


def batch_topk(
    queries: DataFrame, points: DataFrame, k: int, query_id: str = "query_id", point_id: str = "id", vector: str = "vector", dim: int = 64, settings: Settings = DEFAULTS, query_block: int = 4096, point_block: int = 65_536
) -> DataFrame:
    """query_id, point_id, score: for every query the k nearest points by cosine, the point of the query's own
    id left out; ties go to the smaller id.

    Queries up to settings.broadcast_bytes (checked by a count) are sent to every task, which returns k rows
    per query: the points aren't shuffled. More queries go in blocks of query_block against blocks of
    point_block points; each pair of blocks is one bounded task, and only k rows per query leave it."""
    q = queries.where(usable(F.col(vector), dim)).select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    p = points.where(usable(F.col(vector), dim)).select(F.col(point_id).alias("p"), F.col(vector).alias("v"))
    schema = f"q {q.schema['q'].dataType.simpleString()}, p {p.schema['p'].dataType.simpleString()}, score double"
    count = q.count()
    keep = k + 1  # the point of the query's own id may be among them
    if count * dim * 8 <= settings.broadcast_bytes:
        own = q.toPandas()
        sent = queries.sparkSession.sparkContext.broadcast((own["q"].to_numpy(), _unit(own["v"]) if count else np.zeros((0, dim))))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qm = sent.value
            best_so_far = pd.DataFrame({"q": [], "p": [], "score": []})
            for batch in batches:
                if len(batch) and len(qids):
                    found = _nearest(qids, qm, batch["p"].to_numpy(), _unit(batch["v"]), keep)
                    both = pd.concat([best_so_far, found]) if len(best_so_far) else found
                    best_so_far = both.sort_values(["q", "score", "p"], ascending=[True, False, True]).groupby("q").head(k)
            if len(best_so_far):
                yield best_so_far

        partial = p.mapInPandas(search, schema)
    else:
        query_blocks = -(-count // query_block)
        point_blocks = max(1, -(-p.count() // point_block))
        left = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(point_blocks - 1))))
        # points are dealt out at random among the blocks of their id, so that no block grows with a hot key
        right = p.withColumn("pb", F.pmod(F.xxhash64("p", F.col("v")), F.lit(point_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"q": [], "p": [], "score": []})
            return _nearest(a["q"].to_numpy(), _unit(a["v"]), b["p"].to_numpy(), _unit(b["v"]), keep)

        partial = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(pair, schema)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), F.asc("p"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), F.col("p").alias(f"near_{point_id}"), "score", "rank")
    )
