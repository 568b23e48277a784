"""Embedding providers and the operators that run them in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings
from vellum.errors import InvalidRequest, ProviderUnavailable
from vellum.operators.pooling import pool_cols, pool_rows


class TextEmbedder(Protocol):
    model: str

    def healthy(self) -> bool: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic offline embedder: signed feature hashing of words and word pairs to unit vectors."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.model = dim, f"hash-{dim}"

    def healthy(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
                out[i, int.from_bytes(digest[:4], "little") % self.dim] += 1.0 if digest[4] & 1 else -1.0
            length = np.linalg.norm(out[i])
            out[i] = out[i] / length if length else np.eye(1, self.dim, dtype=np.float32)[0]
        return out

    def embed_tokens(self, text: str) -> np.ndarray:
        """A vector per word, for late interaction."""
        words = re.findall(r"\w+", text.lower())
        return self.embed(words) if words else np.zeros((0, self.dim), dtype=np.float32)


class PageEmbedder(Protocol):
    """Embeds page images as patch grids with special tokens behind."""

    model: str
    grid: int
    specials: int

    def healthy(self) -> bool: ...

    def embed_page(self, image: bytes) -> np.ndarray: ...

    def embed_page_text(self, text: str) -> np.ndarray: ...


class HashPageEmbedder:
    """A deterministic offline page embedder: a vector per slice of the image's bytes."""

    def __init__(self, grid: int = 4, specials: int = 2, dim: int = 16) -> None:
        self.grid, self.specials, self.dim, self.model = grid, specials, dim, f"page-hash-{grid}x{grid}-{dim}"

    def healthy(self) -> bool:
        return True

    def embed_page(self, image: bytes) -> np.ndarray:
        n = self.grid * self.grid + self.specials
        out = np.empty((n, self.dim), dtype=np.float32)
        for i in range(n):
            part = image[len(image) * i // n : len(image) * (i + 1) // n]
            digest = hashlib.blake2b(part + bytes([i % 256]), digest_size=64).digest()
            out[i] = np.frombuffer(digest, np.uint8)[: self.dim].astype(np.float32) - 127.5
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def embed_page_text(self, text: str) -> np.ndarray:
        """A vector per word of a query."""
        words = re.findall(r"\w+", text.lower()) or [text]
        raw = np.stack([np.frombuffer(hashlib.blake2b(w.encode(), digest_size=64).digest(), np.uint8)[: self.dim].astype(np.float32) - 127.5 for w in words])
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)


#: Text vector lengths of the known model sizes, and words in page-model names by family.
TEXT_DIMS = {"small": 384, "base": 768, "large": 1024}
PAGE_FAMILIES = {"colqwen": "colqwen", "colpali": "colpali", "smolvlm": "colsmol", "colsmol": "colsmol"}


def page_family(model: str) -> str:
    """Which family of page models a name belongs to."""
    for word, family in PAGE_FAMILIES.items():
        if word in model.lower():
            return family
    raise InvalidRequest(f"unknown page model {model!r}; known: {', '.join(sorted(PAGE_FAMILIES))}")


def checked(embedder: TextEmbedder, texts: list[str]) -> np.ndarray:
    """One vector per text, or an error."""
    if not texts:
        return np.zeros((0, 0), dtype=np.float32)
    got = embedder.embed(texts)
    if any(v is None for v in got):
        raise ProviderUnavailable("a text has no vector")
    if len(got) != len(texts):
        raise ProviderUnavailable(f"{len(texts)} texts gave {len(got)} vectors")
    return got


def embed_column(embedder: TextEmbedder, text: Column, settings: Settings = DEFAULTS) -> Column:
    """Embeds a text column in batches; null texts have null vectors."""
    size = settings.text_batch

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[np.ndarray | None] = [None] * len(batch)
            at = [i for i, t in enumerate(batch) if isinstance(t, str)]
            for k in range(0, len(at), size):
                part = at[k : k + size]
                for i, v in zip(part, checked(embedder, [batch.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run(text)


def embed_query(embedder: TextEmbedder, text: str) -> list[float]:
    if not text or not text.strip():
        raise InvalidRequest("blank query")
    return [float(x) for x in checked(embedder, [text])[0]]


def embed_page_query(embedder: PageEmbedder, text: str) -> list[list[float]]:
    """The vectors of a query for late interaction with pages."""
    if not text or not text.strip():
        raise InvalidRequest("blank query")
    got = [[float(x) for x in row] for row in embedder.embed_page_text(text)]
    if not got:
        raise ProviderUnavailable(f"{embedder.model} gave no vectors for a query")
    return got


def health(text: TextEmbedder, pages: PageEmbedder | None = None) -> dict[str, bool]:
    """Which providers answer; an error of a probe counts as no."""

    def ask(provider) -> bool:
        try:
            return bool(provider.healthy())
        except Exception:  # noqa: BLE001 - a probe that fails is an answer
            return False

    return {"text": ask(text)} | ({"pages": ask(pages)} if pages is not None else {})


def embed_texts(df: DataFrame, embedder: TextEmbedder, text: str = "text", name: str = "vector") -> DataFrame:
    return df.withColumn(name, embed_column(embedder, F.col(text))).withColumn("embed_model", F.lit(embedder.model))


def embed_pages(df: DataFrame, embedder: PageEmbedder, image: str = "png", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds original, pooled_rows and pooled_cols to page images. The model runs in Arrow batches of
    settings.page_batch pages; pooling is left to array expressions. A null or empty image is an error."""
    size = settings.page_batch

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for k in range(0, len(batch), size):
                for content in batch.iloc[k : k + size]:
                    if content is None or not len(content):
                        raise InvalidRequest("empty page image")
                    out.append([row.tolist() for row in embedder.embed_page(bytes(content))])
            yield pd.Series(out, dtype=object)

    tokens = df.withColumn("original", run(F.col(image)))
    return tokens.withColumns(
        {
            "pooled_rows": pool_rows(F.col("original"), embedder.grid, embedder.specials).cast("array<array<float>>"),
            "pooled_cols": pool_cols(F.col("original"), embedder.grid, embedder.specials).cast("array<array<float>>"),
            "embed_model": F.lit(embedder.model),
        }
    )
