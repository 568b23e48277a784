"""Filling containers of fixed capacity: best-fit decreasing.

Sizes are taken in tokens of a public tokenizer. A text above the capacity is cut into full containers and a
rest; only those texts are cut. Rests and all other texts are packed by best-fit decreasing: the tightest open
container that still has room is found with a segment tree over remaining capacities in logarithmic time.

Packing one list is sequential, so the (key, size) pairs are dealt out at random into shards of about
SHARD_ITEMS, each packed by itself; a shard holds pairs of numbers only, whatever the texts are. Only the last
containers of a shard are left with room, below one container in a hundred. The shards are made by round robin,
so a repeated key or a hot source changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import TOKENIZERS, token_counts

CAPACITY = 2048
SHARD_ITEMS = 16_384


class OpenBins:
    """Open containers by remaining capacity: a segment tree that counts the containers of each capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.at.setdefault(room, []).append(container)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = self.size + room
        while k:
            self.count[k] += by
            k >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, container) of the least room that is at least need; None if none has."""
        k, count = self.size + need, self.count
        if not count[k]:
            # climb until a right sibling holds a container, then descend to its leftmost one
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k *= 2
                if not count[k]:
                    k += 1
        room = k - self.size
        container = self.at[room].pop()
        self._change(room, -1)
        return room, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; sizes are at most capacity. Ties keep the order of the list."""
    bins, out, made = OpenBins(capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = bins.take_tightest(sizes[i])
        room, container = found if found else (capacity, made)
        made += not found
        out[i] = container
        bins.add(room - sizes[i], container)
    return out


def pack_sizes(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shards: int = 1) -> DataFrame:
    """container_id, key, piece_index, token_start, n_tokens of items (key, size).

    Every row gets at least one piece, also those of size 0 (null counts as 0) and with a null key; repeated
    rows are packed as often as they occur. token_start counts from 0 within the text."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    columns = ["container_id", key, "piece_index", "token_start", "n_tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled).combine_chunks()
        table = table.take(pc.sort_indices(table, [("n", "descending"), ("k", "ascending")]))
        sizes = table["n"].to_numpy().tolist()
        placed = best_fit_decreasing([n % capacity if n > capacity else n for n in sizes], capacity)
        made = max(placed) + 1
        row, container, piece, tokens = [], [], [], []
        for i, (n, own) in enumerate(zip(sizes, placed)):
            full = n // capacity if n > capacity else 0
            rest = n - full * capacity
            count = full + (rest > 0 or not full)
            row += [i] * count
            piece += range(count)
            tokens += [capacity] * full + [rest] * (count - full)
            container += [*range(made, made + full), *[own] * (count - full)]
            made += full
        starts = np.array(piece, dtype=np.int32) * capacity
        key_column = table["k"].take(pa.array(row)).combine_chunks()
        numbers = [pa.array(np.array(x, dtype=np.int32)) for x in (piece, starts, tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(container, dtype=np.int64) + shard), key_column, *numbers], columns)

    pairs = items.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"))
    return pairs.repartition(shards).mapInArrow(pack, f"container_id bigint, `{key}` {kind}, piece_index int, token_start int, n_tokens int")


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """Packs whole texts by their token counts; see pack_sizes. The number of shards follows the row count,
    which parquet tables answer without reading texts."""
    shards = max(1, -(-df.select(key).count() // shard_items))
    return pack_sizes(token_counts(df, key, text, vocabulary, folder), key, "n_tokens", capacity, shards)
