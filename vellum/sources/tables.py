"""Stored collections: versioned parquet folders under one root, with a small description beside them.

A write goes to a new version folder; replacing the pointer file publishes it in one step, so readers see the
old rows or the new ones, and a lost writer leaves the old version in place.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vellum.errors import InvalidRequest, SchemaMismatch
from vellum.operators.catalog import upsert
from vellum.sources.images import PageImageStore


@dataclass(frozen=True)
class VectorField:
    """Index options of a multi-vector field, kept with the collection."""

    name: str
    dim: int
    indexed: bool = True
    binary_quantised: bool = False

    @staticmethod
    def pooled(name: str, dim: int) -> VectorField:
        return VectorField(name, dim)

    @staticmethod
    def rerank_only(name: str, dim: int) -> VectorField:
        return VectorField(name, dim, indexed=False, binary_quantised=True)


class Collections:
    """The collections under a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)

    def _folder(self, name: str) -> Path:
        return self.root / PageImageStore._segment(name, "collection", False)

    def _meta(self, name: str) -> dict | None:
        path = self._folder(name) / "collection.json"
        return json.loads(path.read_text()) if path.is_file() else None

    def _publish(self, name: str, meta: dict) -> None:
        folder = self._folder(name)
        folder.mkdir(parents=True, exist_ok=True)
        temporary = folder / f".{uuid.uuid4().hex}"
        temporary.write_text(json.dumps(meta))
        os.replace(temporary, folder / "collection.json")

    def names(self) -> list[str]:
        return sorted(p.parent.name for p in self.root.glob("*/collection.json"))

    def exists(self, name: str) -> bool:
        return self._meta(name) is not None

    def info(self, name: str) -> dict | None:
        """Description and counts; None for an unknown collection."""
        if (meta := self._meta(name)) is None:
            return None
        rows = self.read(name)
        return {"name": name, "dim": meta.get("dim"), "points": rows.count() if rows is not None else 0, "fields": meta.get("fields", [])}

    def ensure_single(self, name: str, dim: int) -> None:
        if (meta := self._meta(name)) is None:
            self._publish(name, {"dim": dim, "fields": [], "version": None})
        elif meta.get("dim") != dim:
            raise SchemaMismatch(f"{name} holds vectors of length {meta.get('dim')}, not {dim}")

    def ensure_multi(self, name: str, fields: list[VectorField]) -> None:
        if not fields:
            raise InvalidRequest("a multi-vector collection needs at least one field")
        if (meta := self._meta(name)) is None:
            self._publish(name, {"dim": None, "fields": [asdict(f) for f in fields], "version": None})
        elif meta.get("dim") is not None:
            raise SchemaMismatch(f"{name} is a single-vector collection")

    def read(self, name: str) -> DataFrame | None:
        meta = self._meta(name)
        if meta is None:
            raise InvalidRequest(f"no collection {name}")
        return self.spark.read.parquet(str(self._folder(name) / meta["version"])) if meta["version"] else None

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Replaces rows of the same key and adds the others. An empty frame changes nothing."""
        if rows.isEmpty():
            return
        meta = self._meta(name)
        if meta is None:
            raise InvalidRequest(f"no collection {name}")
        old = self.read(name)
        merged = upsert(old, rows, key) if old is not None else rows.where(rows[key].isNotNull()).dropDuplicates([key])
        version = f"v-{uuid.uuid4().hex}"
        merged.write.parquet(str(self._folder(name) / version))
        self._publish(name, meta | {"version": version})
        if meta["version"]:
            shutil.rmtree(self._folder(name) / meta["version"], ignore_errors=True)

    def drop(self, name: str) -> bool:
        """Whether there was such a collection."""
        there = self.exists(name)
        shutil.rmtree(self._folder(name), ignore_errors=True)
        return there
