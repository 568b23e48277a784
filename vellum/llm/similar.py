"""Groups of records that are alike but for small edits.

Each record has a fingerprint of min-hash places over its shingles; two records of Jaccard similarity J agree in
any place with probability J. The fingerprint is split into blocks: 20 of two places for texts, 40 of three for
short names, which have more in common by chance. By the pigeonhole principle, fingerprints that differ in fewer
places than there are blocks (at most 19 of 40, for names 39 of 120) share a block for certain. There is no such
guarantee for pairs that differ in more, as half of the pairs at the threshold do: a pair at the threshold of one half misses all blocks with a
probability of 0.3 % (names: 0.5 %), closer pairs far more rarely (at 0.6 below 0.02 %). Records that share a block
are paired, all with all. A block that more than CROWD records share (common phrases) is dealt into tiles of about
TILE records, and every two tiles of it meet in one task, where fingerprints are compared before a pair is written.
Pairs whose fingerprints lie too far apart (Hamming distance over the places, in the end over twice as many) drop
out, and the rest are checked exactly on their shingle sets.

Records with the same shingle set are one class and take part once, so that a mass of copies meets nothing but
itself once. Pairs are written out for the members of classes. Where these would be too many (EXPAND), copies of one
and the same text are linked to the smallest id among them, and only those smallest ids to one another and to the
other class: different texts lose none of their links.

Groups also take in texts that have too few word shingles (short ones, other scripts), by runs of characters.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shingles import blocks, char_shingles, fingerprints, letter_shingles, split_keys, word_shingles
from vellum.session import staged

#: Number of blocks and places in each.
TEXT_BLOCKS, NAME_BLOCKS = (20, 2), (40, 3)
#: Places that the comparison of fingerprints within tiles looks at, 7 bits of each.
PLACES = 40
#: Least agreeing places: at similarity one half, 20 are expected with a deviation of 3.2.
LEAST_AGREEING = 9
#: The final comparison looks at twice as many places, 4 bits of each. At similarity one half, 42.5 are expected to agree
#: with a deviation of 4.5: fewer than the least have a probability of 0.0003 %. Texts with a phrase in common
#: (similarity 0.1 to 0.2) rarely agree in so many, and it is these that grow faster than the table.
WIDE_PLACES, LEAST_WIDE = 80, 23
MIN_SHINGLES = 40
#: A block of more records than this is paired tile by tile, of about so many records each; none is cut short. A record
#: of a block is written once for each of its tiles: they are as large as a task can compare in a few seconds.
CROWD, TILE = 12, 16_384
#: So many pairs of members of two classes are written out at most.
EXPAND = 4096
#: Lists of ids or blocks are sent to all tasks up to so many entries; longer ones are joined by shuffle.
SEND_IDS = 500_000

#: The lower seven bits and the upper one of eight bytes.
_low, _high = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)

Shingler = Callable[[list], np.ndarray]


@dataclass(frozen=True)
class Side:
    """Records of one kind: rows (id, text), how to shingle them, and how many shingles they need."""

    kind: str
    rows: DataFrame
    shingler: Shingler
    least: int = MIN_SHINGLES
    blocks: tuple[int, int] = TEXT_BLOCKS


def _map(rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return rows.mapInArrow(run, schema)


def fingerprinted(side: Side) -> DataFrame:
    """kind, id, t (hash of the text), d1, d2 (digest of kind and shingle set), blocks, short (7 bits of each of PLACES places) and wide (4
    bits of each of WIDE_PLACES places, 16 in a number) of a side's rows (id, text) with enough shingles."""
    salt = int.from_bytes(hashlib.blake2b(side.kind.encode(), digest_size=4).digest(), "little")
    shingler, least, (count, width) = side.shingler, side.least, side.blocks

    def lists(values: np.ndarray) -> pa.Array:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, sizes, digest, places = fingerprints(shingler(batch.column(1).to_pylist()), max(WIDE_PLACES, count * width))
        keep = sizes >= least
        at, digest, places = at[keep], digest[keep] ^ salt, places[keep]
        short = (places[:, :PLACES] & np.uint64(127)).astype(np.int8)
        nibbles = (places[:, :WIDE_PLACES] & np.uint64(15)).reshape(len(places), WIDE_PLACES // 16, 16)
        wide = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
        columns = [*(batch.column(k).take(pa.array(at)) for k in (0, 2)), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1))]
        return pa.RecordBatch.from_arrays([*columns, lists(blocks(places[:, : count * width], width, salt)), lists(short), lists(wide)], ["id", "t", "d1", "d2", "blocks", "short", "wide"])

    usable = side.rows.select("id", "text", F.xxhash64("text").alias("t")).where("id IS NOT NULL AND text IS NOT NULL")
    return _map(usable, "id string, t bigint, d1 bigint, d2 bigint, blocks array<bigint>, short array<tinyint>, wide array<bigint>", make).withColumn("kind", F.lit(side.kind))


def shingle_sets(rows: DataFrame, shingler: Shingler, kind: str) -> DataFrame:
    """kind, id and its distinct shingles as sorted hashes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, begins, hashes = split_keys(shingler(batch.column(1).to_pylist()))
        offsets = np.append(begins, len(hashes)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.astype(np.int64)))], ["id", "shingles"])

    return _map(rows, "id string, shingles array<bigint>", make).withColumn("kind", F.lit(kind))


def _pair_small_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, d) sorted by block. Out: pairs (a, b) of the members of blocks of at most CROWD rows, and each
    larger block as (rows of this batch, null, block). Holds CROWD rows between batches."""
    rest, large = np.zeros((0, 2), np.int64), None  # the last block so far, and which block is known to be large

    def work(rows: np.ndarray, large: int | None) -> tuple[pa.RecordBatch, int | None]:
        block, d = rows[:, 0], rows[:, 1]
        begins = np.flatnonzero(np.diff(block, prepend=block[0] ^ 1))
        sizes = np.diff(np.append(begins, len(rows)))
        crowd = sizes > CROWD
        if large is not None:
            crowd |= block[begins] == large
        crowded = np.repeat(crowd, sizes)
        firsts, seconds = [], []
        for lag in range(1, min(CROWD, len(rows))):
            i = np.flatnonzero((block[lag:] == block[:-lag]) & ~crowded[lag:])
            if not len(i):
                break
            firsts.append(i)
            seconds.append(i + lag)
        empty = np.zeros(0, np.int64)
        x, y = (d[np.concatenate(z)] if z else empty for z in (firsts, seconds))
        big = block[begins[crowd]]
        none, pair = pa.nulls(len(big), pa.int64()), pa.nulls(len(x), pa.int64())
        out = [pa.concat_arrays([pa.array(np.minimum(x, y)), pa.array(sizes[crowd])]), pa.concat_arrays([pa.array(np.maximum(x, y)), none]), pa.concat_arrays([pair, pa.array(big)])]
        return pa.RecordBatch.from_arrays(out, ["a", "b", "block"]), (int(block[-1]) if crowd[-1] else None)

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1)
        rows = np.concatenate([rest, rows]) if len(rest) else rows
        if not len(rows):
            continue
        # the last block may go on in the next batch: it is held back unless it is known to be large
        tail = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True))
        if len(rows) - tail > CROWD or rows[-1, 0] == large:
            tail = len(rows)
        if tail:
            out, large = work(rows[:tail], large)
            yield out
        rest = rows[tail:]
    if len(rest):
        yield work(rest, large)[0]


def _close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of x and y (fingerprints as 64-bit words of eight places) that agree in enough places."""
    differ = np.zeros((len(x), len(y)), dtype=np.uint8)
    for k in range(x.shape[1]):
        lanes = x[:, k, None] ^ y[None, :, k]
        lanes += _low  # a place has 7 bits: the eighth is set where any of them differs
        lanes &= _high
        differ += np.bitwise_count(lanes)
    return np.nonzero(differ <= PLACES - LEAST_AGREEING)


def _pair_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, tile, d, short) sorted by block, i and j, with tile i or j. Out: pairs (a, b) of close members
    of tile i and of tile j. Holds two tiles."""

    def work(key: tuple, tile: np.ndarray, d: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(np.unique(d)) < len(d):  # rows written twice
            _, once = np.unique(np.column_stack([d.view(np.uint64), places]), axis=0, return_index=True)
            tile, d, places = tile[once], d[once], places[once]
        cross = key[1] != key[2]
        first = tile == key[1]
        (xd, x), (yd, y) = (d[first], places[first]), (d[~first], places[~first]) if cross else (d, places)
        step = max(1, (1 << 16) // max(1, len(y)))  # so many comparisons fit a core's cache
        for s in range(0, len(x), step):
            p, q = _close(x[s : s + step], y if cross else y[s:])
            a, b = xd[s + p], yd[q if cross else s + q]
            keep = (a != b) & (cross | (p < q))
            a, b = a[keep], b[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rest: list[tuple] = []  # the parts of the last pair of tiles so far
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        tile, d = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        places = np.ascontiguousarray(batch.column(5).flatten().to_numpy().reshape(len(d), PLACES)).view(np.uint64)
        begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        for s, e in zip(begins, np.append(begins[1:], len(keys))):
            key = tuple(keys[s])
            if rest and key != last:
                yield from work(last, *(np.concatenate(c) for c in zip(*rest)))
                rest = []
            last = key
            rest.append((tile[s:e], d[s:e], places[s:e]))
    if rest:
        yield from work(last, *(np.concatenate(c) for c in zip(*rest)))


def sendable(df: DataFrame) -> DataFrame:
    """A broadcast of a short list whose length is checked; longer lists are joined by shuffle."""
    return F.broadcast(df) if df.count() <= SEND_IDS else df


def _agreeing(x: Column, y: Column) -> Column:
    """Whether fingerprints of PLACES places agree in enough of them."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, p: s + p) >= LEAST_AGREEING


def _agreeing_widely(x: Column, y: Column) -> Column:
    """Whether fingerprints of WIDE_PLACES places, 16 in a number, agree in enough of them."""

    def differing(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))  # the lowest of four bits is set where any of them differs
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, p: s + p) <= WIDE_PLACES - LEAST_WIDE


def candidates(classes: DataFrame, name: str = "alike", final: str = "short", agreeing: Callable[[Column, Column], Column] = _agreeing) -> DataFrame:
    """Pairs of records of one kind (kind, a, b) that share blocks and are close enough, from one record of each
    class (kind, id, d1, blocks, short and the column final, which agreeing compares). Records go by d1 here; should
    two classes have the same d1, both are looked at."""
    keyed = classes.select(F.explode("blocks").alias("block"), F.col("d1").alias("d"))
    met = keyed.repartition("block").sortWithinPartitions("block")
    met = staged(met.mapInArrow(_pair_small_blocks, "a bigint, b bigint, block bigint"), f"{name}-blocks")
    tiles = F.ceil(F.sum("a") / F.lit(TILE)).cast("int")
    crowded = sendable(met.where("block IS NOT NULL").groupBy("block").agg(tiles.alias("tiles")))
    at = classes.select(F.explode("blocks").alias("block"), F.col("d1").alias("d"), "short").join(crowded, "block")
    at = at.withColumn("tile", F.pmod(F.xxhash64("d"), "tiles").cast("int"))
    at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    at = at.select("block", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "d", "short")
    again = at.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_pair_tiles, "a bigint, b bigint")
    # one exchange by a serves the distinct and the first join; ids follow only for the pairs that are left
    pairs = met.where("block IS NULL AND a <> b").select("a", "b").union(again).repartition("a").distinct()
    prints = [classes.select(F.col("d1").alias(x), F.col(final).alias(f"p{x}")) for x in "ab"]
    near = pairs.join(prints[0], "a").join(prints[1], "b").where(agreeing(F.col("pa"), F.col("pb"))).select("a", "b")
    ids = [classes.select(F.col("d1").alias(x), F.col("kind").alias(f"k{x}"), F.col("id").alias(f"i{x}")) for x in "ab"]
    return near.join(ids[0], "a").join(ids[1], "b").where("ka = kb").select(F.col("ka").alias("kind"), F.col("ia").alias("a"), F.col("ib").alias("b"))


def alike(sides: list[Side], name: str = "alike") -> DataFrame:
    """kind, id_a < id_b of the records of each side of which at least half of all shingles are in both texts.

    Kinds never meet: a record's kind is part of its digest and its blocks, so all sides go through one plan.
    A repeated row, or one id with several texts, counts once per pair. Null ids, null texts and texts of fewer
    than least shingles take no part; an empty table gives no pair."""
    marked = staged(_all([fingerprinted(s) for s in sides]), f"{name}-fingerprints")
    # most classes have one member: only the others are gathered
    sized = marked.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
    members = staged(marked.select("kind", "d1", "d2", "id", "t").join(sendable(staged(sized, f"{name}-classes")), ["d1", "d2"]).distinct(), f"{name}-members")
    others = sendable(members.where("id <> rep").select("kind", "id"))
    classes = marked.join(others, ["kind", "id"], "left_anti")
    near = staged(candidates(classes, name, "wide", _agreeing_widely), f"{name}-candidates")
    wanted = sendable(near.select("kind", F.col("a").alias("id")).union(near.select("kind", "b")).distinct())
    texts = [(s, s.rows.select(F.lit(s.kind).alias("kind"), "id", "text").where("text IS NOT NULL").join(wanted, ["kind", "id"], "left_semi")) for s in sides]
    sets = _all([shingle_sets(t.drop("kind"), s.shingler, s.kind) for s, t in texts]).dropDuplicates(["kind", "id"])
    sa = sets.select("kind", F.col("id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select("kind", F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    close = near.join(sa, ["kind", "a"]).join(sb, ["kind", "b"]).where(3 * both >= F.size("sa") + F.size("sb")).select("kind", "a", "b")
    return expanded(close, members.select("kind", "rep", "id", "t"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """kind, id_a, id_b from links between classes (kind, a, b; a class is named by its smallest id) and the
    members (kind, rep, id, t: the hash of the text) of the classes that have several.

    All pairs of members are written out up to EXPAND of them for a link. For a link of more, the smallest id of each
    text stands for its copies, which are linked to it alone."""
    sizes = members.groupBy("kind", F.col("rep").alias("r")).agg(F.countDistinct("id").alias("n"))
    na, nb = sizes.select("kind", F.col("r").alias("a"), F.col("n").alias("na")), sizes.select("kind", F.col("r").alias("b"), F.col("n").alias("nb"))
    own = sizes.select("kind", F.col("r").alias("a"), F.col("r").alias("b"))
    linked = links.union(own).join(na, ["kind", "a"], "left").join(nb, ["kind", "b"], "left")
    linked = linked.withColumn("big", F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1)) > EXPAND).drop("na", "nb")
    heads = members.groupBy("kind", "rep", "t").agg(F.min("id").alias("head"))
    parties = members.select("kind", "rep", "id", F.lit(False).alias("big")).union(heads.select("kind", "rep", "head", F.lit(True))).distinct()
    ma = parties.select("kind", F.col("rep").alias("a"), F.col("id").alias("x"), "big")
    mb = parties.select("kind", F.col("rep").alias("b"), F.col("id").alias("y"), "big")
    pairs = linked.join(ma, ["kind", "a", "big"], "left").join(mb, ["kind", "b", "big"], "left").select("kind", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    crowds = sizes.where(F.col("n") * F.col("n") > EXPAND).select("kind", F.col("r").alias("rep"))
    copies = members.join(crowds, ["kind", "rep"], "left_semi").join(heads, ["kind", "rep", "t"]).select("kind", F.col("id").alias("x"), F.col("head").alias("y"))
    pairs = pairs.union(copies).where("x <> y")
    return pairs.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


# --- the tables of this project -------------------------------------------------------------------------------

_others = re.compile("[^a-z0-9]+")
_behind = re.compile(r"[?#].*\Z", re.S)


def plain_name(filename: str | None, source_value: str | None) -> str:
    """A file name for comparison: the given one, or the last segment of the source, in plain characters."""
    if not filename:
        filename = unquote(_behind.sub("", source_value or "").rsplit("/", 1)[-1])
    return _others.sub(" ", filename.lower()).strip()


def request_names(jobs: DataFrame) -> DataFrame:
    """id (the job) and text (its plain file name), once per job and name."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [plain_name(f, v) for f, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["id", "text"])

    given = F.when(F.coalesce(F.col("request.filename"), F.lit("")) == "", F.col("request.source_value"))
    rows = jobs.select(F.col("job_id").alias("id"), F.col("request.filename").alias("f"), given.alias("v")).where("id IS NOT NULL")
    return _map(rows, "id string, text string", make).distinct()


def request_contents(jobs: DataFrame) -> DataFrame:
    """id (the job) and text (the decoded content) of inline requests; broken base64 or UTF-8 is no content."""
    inline = F.lower(F.trim("request.source_type")) == "inline"
    text = F.try_validate_utf8(F.try_to_binary(F.col("request.source_value"), F.lit("base64")).cast("string"))
    return jobs.where(inline).select(F.col("job_id").alias("id"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def found(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """kind, id_a, id_b: alike chunks by their texts, alike requests by file names or inline contents."""
    sides = [
        Side("chunk", chunks.select("id", "text"), word_shingles),
        Side("name", request_names(jobs), char_shingles, 1, NAME_BLOCKS),
        Side("content", request_contents(jobs), word_shingles),
    ]
    kind = F.when(F.col("kind") == "chunk", "chunk").otherwise("request")
    return alike(sides).select(kind.alias("kind"), "id_a", "id_b").distinct()


def components(links: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """id and group_id (the smallest id of its group) of everything that links (id_a, id_b) hold together. An error if
    that takes more rounds than given.

    Alternates large-star and small-star steps, each one aggregation and one join on shuffled keys, until the
    links no longer change; the number of rounds grows with the logarithm of the longest path."""
    edges = staged(links.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v").distinct(), name)
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go to the least id around u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"groups not complete after {rounds} rounds")
    groups = edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    return groups.union(groups.select("group_id", "group_id")).distinct()


def _short(texts: list[str | None]) -> np.ndarray:
    """Runs of characters of the texts that have too few word shingles to take part by these."""
    owner, begins, _ = split_keys(keys := word_shingles(texts))
    sizes = np.diff(np.append(begins, len(keys)))
    enough = set(owner[sizes >= MIN_SHINGLES].tolist())
    return letter_shingles([None if i in enough else t for i, t in enumerate(texts)])


def groups(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """kind, id, group_id of all chunks and requests that are alike to another one: by found, and those of which the
    texts have too few word shingles for it if at least half of all their runs of five characters are in both."""
    sides = [Side("chunk", chunks.select("id", "text"), _short, 1, NAME_BLOCKS), Side("request", request_contents(jobs), _short, 1, NAME_BLOCKS)]
    links = staged(found(chunks, jobs).unionByName(alike(sides, "short")), "links")
    marked = links.select(F.concat_ws(":", "kind", "id_a").alias("id_a"), F.concat_ws(":", "kind", "id_b").alias("id_b"))
    parts = components(marked)
    return parts.select(F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("id"), F.expr("substring(group_id, instr(group_id, ':') + 1)").alias("group_id"))
