"""The most similar vectors of every vector: the k nearest, or those of them down to a least cosine.

Unit vectors are projected by PROJECTED Gaussian (2-stable) directions: a coordinate of the difference of two
vectors at distance d is normal with deviation d, and the squared length of the projected difference is d squared
times a chi-square variable. A kd-tree over the projections cuts the collection into leaves of about BLOCK vectors;
its upper levels are fitted on a bounded sample in the driver, deeper ones leaf by leaf in the tasks, so that its
depth follows the number of rows. Every vector is indexed.

A vector searches the leaves in the order of the probability that a neighbour within its radius lies in them, and
stops when those left hold less than 1 - COVERED of it. In a leaf, projected neighbours are verified with the full
vectors by increments, nearest first: after the first increment the chi-square test with the k-th distance known by
then says which of the others can still be among the k nearest; these are verified and no more.

The radius is that of the least cosine (neighbours) or each vector's own (nearest): the distance of its k-th best in
its own block, beyond which none of its k nearest can lie. As a pair is found from either end, it is missed only if
both searches stop too early.

A block's vectors come first in its partition and are held, the vectors that search it stream past them; a crowded
leaf is several blocks. Equal vectors form classes and are searched once, repeated rows are merged before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.vectors import max_sim, usable
from vellum.session import staged

PROJECTED = 16
#: Rows, about, of the sample that the upper levels of the tree are fitted on, and the fewest of it in a leaf.
SAMPLE, LEAST_SAMPLED = 20_000, 16
BLOCK = 8192
COVERED = 0.95
#: The same where lists are wanted whole: a list is missing a neighbour that the other end doesn't need.
LIST_COVERED = 0.99
#: Branches of the tree that hold less of the probability than this are not followed.
FAINT = 2e-4
#: Quantile of the chi-square distribution with PROJECTED degrees of freedom at 0.9995.
CHI_SQUARE = 41.3
#: Projected neighbours, in multiples of k, that are verified before the first stopping test.
FIRST = 4
SEND_IDS = 500_000


@dataclass(frozen=True)
class Tree:
    """A kd-tree: the children of an inner node are nodes, or ~leaf; root is 0, or -1 where there is one leaf only."""

    directions: np.ndarray
    axis: np.ndarray
    at: np.ndarray
    child: np.ndarray  # nodes x 2
    blocks: np.ndarray  # number of blocks of each leaf
    first: np.ndarray  # number of its first block

    @property
    def leaves(self) -> int:
        return len(self.blocks)

    @property
    def root(self) -> int:
        return 0 if len(self.axis) else -1


def _grown(points: np.ndarray, depth: int) -> tuple[list[int], list[float], list[int], list[float]]:
    """Axis and cut of the inner nodes of a complete tree of so many levels, level by level, and the shares of its
    leaves in the points. The axis is that of the largest variance, the cut its median."""
    axis, at, members = [], [], [np.arange(len(points))]
    for node in range((1 << depth) - 1):
        own = members[node]
        axis.append(int(np.argmax(points[own].var(axis=0))) if len(own) else node % PROJECTED)
        along = points[own, axis[-1]]
        at.append(float(np.median(along)) if len(own) else 0.0)
        members += [own[along < at[-1]], own[along >= at[-1]]]
    shares = [len(m) / max(1, len(points)) for m in members[(1 << depth) - 1 :]]
    return axis, at, list(range(1 << depth)), shares


def _tree(directions: np.ndarray, upper: tuple, lower: dict[int, tuple[list[int], list[float], list[float]]], rows: int, block: int) -> Tree:
    """A tree from its upper levels and, by leaf of these, the lower ones (axes, cuts, shares of the leaves)."""
    axis, at, child, shares = list(upper[0]), list(upper[1]), [], []
    inner = len(axis)
    hang: list[tuple[int, int, int]] = []  # node, side, leaf of the upper tree
    for node in range(inner):
        for side, below in enumerate((2 * node + 1, 2 * node + 2)):
            if below < inner:
                child.append((node, side, below))
            else:
                hang.append((node, side, below - inner))
    if not inner:
        hang = [(-1, 0, 0)]
    links = np.zeros((inner + sum(len(x[0]) for x in lower.values()), 2), np.int64)
    for node, side, below in child:
        links[node, side] = below
    for node, side, leaf in hang:
        axes, cuts, parts = lower.get(leaf, ((), (), (1.0,)))
        offset, n = len(axis), len(axes)
        axis += axes
        at += cuts
        entry = offset if n else ~len(shares)
        if node >= 0:
            links[node, side] = entry
        for k in range(n):
            for s, below in enumerate((2 * k + 1, 2 * k + 2)):
                links[offset + k, s] = offset + below if below < n else ~(len(shares) + below - n)
        shares += [upper[3][leaf] * x for x in parts]
    blocks = np.maximum(1, np.ceil(np.array(shares) * rows / (2 * block))).astype(np.int64)
    return Tree(directions, np.array(axis, np.int64), np.array(at, float), links, blocks, np.concatenate([[0], np.cumsum(blocks)[:-1]]))


def directions_of(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, PROJECTED))


def depths(rows: int, sampled: int, block: int = BLOCK) -> tuple[int, int]:
    """Levels of the tree that the sample in the driver gives, and levels below them."""
    wanted = max(0, math.ceil(math.log2(max(1.0, rows / block)))) if sampled else 0
    upper = min(wanted, max(0, int(math.log2(max(1, sampled / LEAST_SAMPLED)))))
    return upper, wanted - upper


def fit(sample: np.ndarray, dim: int, rows: int, block: int = BLOCK) -> Tree:
    """A tree with leaves of about one block for so many rows, as deep as a sample of unit vectors allows."""
    directions = directions_of(dim)
    return _tree(directions, _grown(sample @ directions, depths(rows, len(sample), block)[0]), {}, rows, block)


def deepened(tree: Tree, reps: DataFrame, dim: int, rows: int, block: int) -> Tree:
    """The tree with the levels that its sample didn't allow, fitted in the tasks on LEAST_SAMPLED rows for each leaf
    to come. What comes back are two numbers a leaf."""
    levels = depths(rows, 1 << 62, block)[0] - int(math.log2(tree.leaves))
    if levels <= 0:
        return tree
    sent = reps.sparkSession.sparkContext.broadcast(tree)
    every = max(1, rows // (tree.leaves * LEAST_SAMPLED << levels))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = unit(_matrix(batch.column(0), dim)) @ sent.value.directions
                flat = pa.array(points.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * PROJECTED), flat)
                yield pa.RecordBatch.from_arrays([pa.array(_leaf(sent.value, points).astype(np.int32)), lists], ["leaf", "point"])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        axis, at, _, shares = _grown(np.vstack(rows["point"].to_numpy()), levels)
        return pd.DataFrame({"leaf": rows["leaf"].iloc[:1], "axis": [axis], "at": [at], "shares": [shares]})

    drawn = reps.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0).select("vector")
    placed = drawn.mapInArrow(place, "leaf int, point array<double>")
    got = placed.groupBy("leaf").applyInPandas(grow, "leaf int, axis array<int>, at array<double>, shares array<double>").collect()
    upper = (tree.axis.tolist(), tree.at.tolist(), None, [1 / tree.leaves] * tree.leaves)
    return _tree(tree.directions, upper, {r["leaf"]: (list(r["axis"]), list(r["at"]), list(r["shares"])) for r in got}, rows, block)


def _leaf(tree: Tree, points: np.ndarray) -> np.ndarray:
    node = np.full(len(points), tree.root, np.int64)
    while len(at := np.flatnonzero(node >= 0)):
        here = node[at]
        node[at] = tree.child[here, (points[at, tree.axis[here]] >= tree.at[here]).astype(np.int64)]
    return ~node


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 2e-4 (a logistic form; it only orders and weighs leaves)."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.070566 * z**3, -50, 50)))


def search_order(tree: Tree, points: np.ndarray, radius: float | np.ndarray, covered: float = COVERED) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves that each projected point searches, likeliest first. A radius for all, or one each."""
    radius = np.broadcast_to(np.asarray(radius, float).reshape(-1), len(points)) if np.ndim(radius) else np.full(len(points), float(radius))
    step = max(64, (1 << 21) // max(1, min(tree.leaves, 4096)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s in range(0, len(points), step):
        x, r = points[s : s + step], radius[s : s + step]
        row, node, mass = np.arange(len(x)), np.full(len(x), tree.root, np.int64), np.ones(len(x))
        rows, leaves, masses = [], [], []
        while len(row):
            done = node < 0
            rows.append(row[done])
            leaves.append(~node[done])
            masses.append(mass[done])
            row, node, mass = row[~done], node[~done], mass[~done]
            left = _below((tree.at[node] - x[row, tree.axis[node]]) / r[row])
            row, node, mass = np.concatenate([row, row]), tree.child[node].T.reshape(-1), np.concatenate([mass * left, mass * (1 - left)])
            kept = mass >= FAINT
            row, node, mass = row[kept], node[kept], mass[kept]
        row, leaf, mass = np.concatenate(rows), np.concatenate(leaves), np.concatenate(masses)
        order = np.lexsort((leaf, -mass, row))
        row, leaf, mass = row[order], leaf[order], mass[order]
        total = np.cumsum(mass) - mass
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        before = total - np.repeat(total[begins], np.diff(np.append(begins, len(row))))
        go = before < covered
        found.append((row[go] + s, leaf[go]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, initial=0, keepdims=True)  # huge lengths would overflow
    return wide / np.linalg.norm(wide, axis=1)[:, None]


class Held:
    """The vectors of a block with their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        self.ids, self.vectors, self.directions = ids[order], vectors[order], directions
        projected = (self.vectors @ directions).astype(np.float32)
        self.right = np.concatenate([projected, np.ones((len(ids), 1), np.float32), np.sum(projected * projected, 1)[:, None]], axis=1).T.copy()

    def search(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of the block, cosine) of up to k nearest of each vector of q down to its least cosine; a
        vector is no neighbour of its own id."""
        n = len(self.ids)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(64, (1 << 21) // max(1, n))
        for s in range(0, len(q) if n else 0, step):
            v, bound = q[s : s + step], least[s : s + step].copy()
            projected = (v @ self.directions).astype(np.float32)
            left = np.concatenate([-2 * projected, np.sum(projected * projected, 1)[:, None], np.ones((len(v), 1), np.float32)], axis=1)
            away = left @ self.right
            reach = lambda: ((2 - 2 * bound) * CHI_SQUARE * 1.0001 + 1e-6).astype(np.float32)[:, None]  # noqa: B023, E731
            open_ = away <= reach()
            own = np.searchsorted(self.ids, ids[s : s + step])
            own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == ids[s : s + step]), own, -1)
            several = np.flatnonzero(own >= 0)
            open_[several, own[several]] = False
            crowded = np.flatnonzero(open_.sum(axis=1) > FIRST * k)
            if len(crowded) and n > FIRST * k:
                # first increment: the nearest by projection; their k-th cosine is the bound of the stopping test
                near = np.argpartition(np.where(open_[crowded], away[crowded], np.inf), FIRST * k - 1, axis=1)[:, : FIRST * k]
                c = np.einsum("ij,ikj->ik", v[crowded], self.vectors[near])
                kth = np.partition(c, FIRST * k - k, axis=1)[:, FIRST * k - k]
                bound[crowded] = np.maximum(bound[crowded], kth - 1e-9)
                open_ &= away <= reach()
            i, j = np.nonzero(open_)
            c = np.einsum("ij,ij->i", v[i], self.vectors[j]) if 16 * len(i) < open_.size else (v @ self.vectors.T)[i, j]
            ok = c >= bound[i]
            i, j, c = i[ok], j[ok], c[ok]
            order = np.lexsort((j, -np.round(c, 12), i))
            i, j, c = i[order], j[order], c[order]
            begins = np.flatnonzero(np.diff(i, prepend=-1))
            best = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i)))) < k
            found.append((i[best] + s, j[best], c[best]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _class_keys() -> list[Column]:
    return [F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2")]


def _sendable(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SEND_IDS else df


def _prepared(points: DataFrame, dim: int, name: str, block: int):
    """Members of the classes of equal vectors that have several (rep, id), the vectors to search (id, vector), one
    row of each class, and the broadcast tree."""
    spark = points.sparkSession
    mine = points.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    # classes of equal vectors with more than one row: repeated rows or several ids
    keyed = mine.select("id", *_class_keys())
    several = staged(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"), f"{name}-classes")
    many = several.count()
    shared = several.where("rep <> last").select("h1", "h2", "rep")
    members = staged(keyed.join(_sendable(shared, many), ["h1", "h2"]).select("rep", "id").distinct(), f"{name}-members")
    hashed = mine.select("id", "vector", *_class_keys())
    single = hashed.join(_sendable(several.select("h1", "h2"), many), ["h1", "h2"], "left_anti").select("id", "vector")
    merged = hashed.join(_sendable(several.select("h1", "h2"), many), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vector").alias("vector"))
    reps = single.unionByName(staged(merged.select("id", "vector"), f"{name}-merged"))
    rows = reps.count()
    every = max(1, rows // SAMPLE)
    sampled = reps.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").toArrow()
    sample = unit(_matrix(sampled["vector"], dim)) if sampled.num_rows else np.zeros((0, dim))
    return members, reps, spark.sparkContext.broadcast(deepened(fit(sample, dim, rows, block), reps, dim, rows, block))


def _own_block(tree: Tree, ids: pa.Array, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and block within it of projected points."""
    own = _leaf(tree, projected)
    hashes = np.array([zlib.crc32(x.encode()) for x in ids.to_pylist()], dtype=np.int64)
    return own, hashes % tree.blocks[own]


def _routed(tree: Tree, batch: pa.RecordBatch, dim: int, radius: float | np.ndarray, covered: float = COVERED) -> list[pa.Array]:
    """block, asks and the columns of batch (id, vector, ...) for every block that a vector lies in or searches."""
    projected = unit(_matrix(batch.column(1), dim)) @ tree.directions
    own, part = _own_block(tree, batch.column(0), projected)
    row, leaf = search_order(tree, projected, radius, covered)
    # a search of a leaf goes to each of its blocks; in the own leaf, to all but the own one
    counts = tree.blocks[leaf]
    row, leaf = np.repeat(row, counts), np.repeat(leaf, counts)
    sub = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    go = (leaf != own[row]) | (sub != part[row])
    row, to = row[go], (tree.first[leaf] + sub)[go]
    target = np.concatenate([tree.first[own] + part, to]).astype(np.int32)
    asks = np.concatenate([np.zeros(len(own), bool), np.ones(len(row), bool)])
    index = pa.array(np.concatenate([np.arange(len(own)), row]))
    return [pa.array(target), pa.array(asks), *(c.take(index) for c in batch.columns)]


def _by_block(rows: DataFrame, dim: int, sent, answer, schema: str) -> DataFrame:
    """answer(held, ids, vectors, least, asks) over rows (block, asks, id, vector, least), a table for every stretch:
    first the block's own vectors among themselves, then those that search it, as they stream past. A task holds one
    block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        at, held = None, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and own:
                whole = pa.Table.from_batches(own)
                ids, vectors = np.array(whole["id"].to_pylist(), dtype=object), unit(_matrix(whole["vector"], dim))
                held = Held(ids, vectors, sent.value.directions)
                yield answer(held, ids, vectors, whole["least"].to_numpy(), whole)

        for batch in batches:
            block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block, prepend=block[:1] - 1) != 0) | (np.diff(asks.astype(np.int8), prepend=0) != 0))
            for s, e in zip(edges, [*edges[1:], len(block)]) if len(block) else ():
                if block[s] != at:
                    yield from close()
                    own, at, held = [], block[s], None
                part = batch.slice(s, e - s)
                if not asks[s]:
                    own.append(part)
                    continue
                yield from close()
                if held is not None:  # nobody lies in an empty block
                    table = pa.Table.from_batches([part])
                    ids = np.array(table["id"].to_pylist(), dtype=object)
                    yield answer(held, ids, unit(_matrix(table["vector"], dim)), table["least"].to_numpy(), table)
        yield from close()

    return rows.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, schema)


def _links(routed: DataFrame, dim: int, sent, k: int) -> DataFrame:
    """rep, other, c of routed vectors and the nearest in the blocks they search, for either end."""

    def answer(held: Held, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, _: pa.Table) -> pa.RecordBatch:
        i, j, c = held.search(ids, vectors, least, k)
        a, b, c = pa.array(ids[i], pa.string()), pa.array(held.ids[j], pa.string()), pa.array(np.round(c, 12), pa.float64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in ([a, b], [b, a], [c, c])], ["rep", "other", "c"])

    found = _by_block(routed, dim, sent, answer, "rep string, other string, c double")
    return found.where("rep <> other").groupBy("rep", "other").agg(F.max("c").alias("c"))


def neighbours(points: DataFrame, dim: int, k: int = 5, cosine: float = 0.92, name: str = "neighbours", block: int = BLOCK) -> DataFrame:
    """id, near_id, cosine, rank: for each usable vector of points (id, vector) its up to k most similar others
    with at least that cosine; ties go to the smaller id.

    Null, all-zero, NaN-holding vectors and those of another length take no part, nor do rows without an id. A row
    written twice counts once; an id with several vectors is compared by each. An empty table gives no row."""
    members, reps, sent = _prepared(points, dim, name, block)
    radius = math.sqrt(2 - 2 * cosine)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = _routed(sent.value, batch, dim, radius)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), cosine))], ["block", "asks", "id", "vector", "least"])

    routed = reps.mapInArrow(route, "block int, asks boolean, id string, vector array<float>, least double")
    return _lists(_links(routed, dim, sent, k), members, k)


def nearest(points: DataFrame, dim: int, k: int = 5, name: str = "nearest", block: int = BLOCK) -> DataFrame:
    """id, near_id, cosine, rank: for each usable vector of points (id, vector) its k most similar others, however far
    they are (fewer only where there are no more); ties go to the smaller id. What counts as usable is as in
    neighbours."""
    members, reps, sent = _prepared(points, dim, name, block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            if n := batch.num_rows:
                own, part = _own_block(tree, batch.column(0), unit(_matrix(batch.column(1), dim)) @ tree.directions)
                block = pa.array((tree.first[own] + part).astype(np.int32))
                yield pa.RecordBatch.from_arrays([block, pa.array(np.zeros(n, bool)), *batch.columns, pa.array(np.full(n, -1.0))], ["block", "asks", "id", "vector", "least"])

    def bound(held: Held, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        i, _, c = held.search(ids, vectors, least, k)
        full = np.bincount(i, minlength=len(ids)) >= k
        worst = np.full(len(ids), 1.0)
        np.minimum.at(worst, i, c)
        return pa.RecordBatch.from_arrays([*(rows[x].combine_chunks() for x in ("id", "vector")), pa.array(np.where(full, np.clip(worst - 1e-9, -1, 1), -1.0))], ["id", "vector", "least"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                radius = np.sqrt(np.maximum(1e-12, 2 - 2 * batch.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays(_routed(sent.value, batch, dim, radius, LIST_COVERED), ["block", "asks", "id", "vector", "least"])

    whole = "block int, asks boolean, id string, vector array<float>, least double"
    bounded = _by_block(reps.mapInArrow(place, whole), dim, sent, bound, "id string, vector array<float>, least double")
    return _lists(_links(bounded.mapInArrow(route, whole), dim, sent, k), members, k)


def _lists(links: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of ids from links between classes (rep, other, c) and the members of the classes that have
    several. Of each class the first k + 1 ids are enough for anyone's list; a window with a limit keeps no more
    of a large class in any task."""
    order = Window.partitionBy("rep").orderBy("id")
    firsts = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    best = Window.partitionBy("rep").orderBy(F.desc("c"), "other")
    top = links.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    of_other = firsts.select(F.col("rep").alias("other"), "ids")
    near = top.join(of_other, "other", "left").select("rep", "c", F.explode(F.coalesce("ids", F.array("other"))).alias("y"))
    own = firsts.select("rep", F.lit(1.0).alias("c"), F.explode("ids").alias("y"))
    listed = near.union(own).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "y"))).alias("list"))
    of_class = members.select("rep", F.col("id").alias("member"))
    each = listed.join(of_class, "rep", "left").withColumn("id", F.coalesce("member", "rep"))
    chosen = F.slice(F.filter("list", lambda x: x["y"] != F.col("id")), 1, k)
    out = each.select("id", F.posexplode(chosen).alias("place", "x"))
    return out.select("id", F.col("x.y").alias("near_id"), (-F.col("x.c")).alias("cosine"), (F.col("place") + 1).alias("rank"))


def pairs_of(lists: DataFrame) -> DataFrame:
    """id_a < id_b of which at least one is in the other's list."""
    return lists.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def page_vectors(pages: DataFrame, rows: int) -> DataFrame:
    """id and the pooled rows of pages with so many of them, written out as one vector."""
    return pages.where(F.size("pooled_rows") == rows).select("id", F.flatten("pooled_rows").alias("vector"))


def page_neighbours(pages: DataFrame, k: int = 5, cosine: float | None = 0.92) -> DataFrame:
    """Neighbours among pages with equally many pooled rows, without a least cosine the k nearest; pages without
    vectors take no part. The kinds of grids are few, each is searched by itself."""
    kinds = pages.where("size(pooled_rows) > 0").select(F.size("pooled_rows").alias("n"), F.size(F.flatten("pooled_rows")).alias("dim")).distinct().orderBy("n", "dim").collect()
    out = pages.sparkSession.createDataFrame([], "id string, near_id string, cosine double, rank int")
    for r in kinds:
        if (r["dim"] or 0) > 0:
            rows, name = page_vectors(pages, r["n"]), f"pages-{r['n']}"
            out = out.unionByName(nearest(rows, r["dim"], k, name) if cosine is None else neighbours(rows, r["dim"], k, cosine, name))
    return out


def found(points: DataFrame, pages: DataFrame, dim: int = 64) -> DataFrame:
    """kind, id_a, id_b of similar points and of similar pages."""
    a = pairs_of(neighbours(points, dim, name="points")).select(F.lit("point").alias("kind"), "id_a", "id_b")
    return a.unionByName(pairs_of(page_neighbours(pages)).select(F.lit("page").alias("kind"), "id_a", "id_b"))


def pages_in_exact_order(pages: DataFrame) -> DataFrame:
    """id, near_id, cosine, score, rank: the k nearest of every page by pooled rows, in the order of late interaction
    between the full vectors of both (the mean over the page's tokens of the best product)."""
    lists = staged(page_neighbours(pages, cosine=None), "page-lists")
    full = pages.where("size(original) > 0").dropDuplicates(["id"]).select("id", F.col("original").cast("array<array<double>>").alias("original"))
    mine, other = full.withColumnRenamed("original", "qv"), full.select(F.col("id").alias("near_id"), F.col("original").alias("dv"))
    score = max_sim(F.col("qv"), F.col("dv")) / F.size("qv")
    scored = lists.join(mine, "id").join(other, "near_id").select("id", "near_id", "cosine", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "near_id")))
