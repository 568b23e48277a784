"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged with a segment tree over the ranks of its
adjacent pairs. The root holds the leftmost pair of the lowest rank; a merge changes three leaves, each in
logarithmic time; it ends when no pair can be merged. The work of a text is linear in its length but for that
logarithm, so very long pieces are no danger.

The corpus is read once and never shuffled. Each Python worker keeps the ids of pieces it has seen, up to
CACHED_PIECES of at most CACHED_BYTES each; that bounds memory only, the ids are the same without it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern that splits texts for the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_PIECES = 1 << 18
CACHED_BYTES = 256


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (len(ranks) + 1) * size
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # the position breaks ties to the left
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # start of the part before the one that starts here

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] != none:
        i = tree[1] % size
        j = end[i]
        stop = end[j]
        end[i] = stop
        if j < size:
            put(j, none)
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            put(h, none if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self._ranks, self._split = ranks, regex.compile(pattern).findall
        self._seen: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> array:
        """Ids of a text; none for null and empty texts. Special tokens in a text are ordinary text."""
        out = array("i")
        if not text:
            return out
        seen, extend = self._seen, out.extend
        for piece in self._split(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                ids = merge(raw, self._ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(seen) >= CACHED_PIECES:
                        seen.clear()
                    seen[piece] = ids
            extend(ids)
        return out


_encoders: dict[int, Encoder] = {}


def worker_encoder(sent: Broadcast) -> Encoder:
    """The encoder of this Python worker, made once for each vocabulary sent."""
    key = hash(sent.value)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(sent.value))
    return _encoders[key]


def send_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """Sends a rank file (about a megabyte; vocabularies don't grow with the corpus) to the workers."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def map_texts(df: DataFrame, key: str, text: str, sent: Broadcast, make: Callable[[Encoder, list], pa.Array], name: str, kind: str) -> DataFrame:
    """key and a column made of the batch's texts with the worker's encoder."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(sent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), make(encoder, batch.column(1).to_pylist())], [key, name])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, `{name}` {kind}")


def _ids(encoder: Encoder, texts: list) -> pa.Array:
    values, offsets = array("i"), np.zeros(len(texts) + 1, dtype=np.int32)
    for i, text in enumerate(texts):
        values.extend(encoder.encode(text))
        offsets[i + 1] = len(values)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else np.zeros(0, np.int32)))


def _counts(encoder: Encoder, texts: list) -> pa.Array:
    return pa.array([len(encoder.encode(t)) for t in texts], pa.int32())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids (a list of integers, never null) of every row. Null and empty texts give an empty list;
    repeated rows, null keys and ties are kept as they are; other columns don't matter. No shuffle."""
    return map_texts(df, key, text, send_vocabulary(df.sparkSession, vocabulary, folder), _ids, "ids", "array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and text of token ids; null or empty lists give an empty text. The reverse of encode_corpus."""
    sent = send_vocabulary(df.sparkSession, vocabulary, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, bytes] = {}
        for batch in batches:
            pieces = pieces or {i: p for p, i in parse_ranks(sent.value).items()}
            texts = [b"".join(pieces[i] for i in row or ()).decode("utf-8") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and n_tokens of every row; 0 for null and empty texts."""
    return map_texts(df, key, text, send_vocabulary(df.sparkSession, vocabulary, folder), _counts, "n_tokens", "int")
