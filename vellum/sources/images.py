"""Page images: PNG encoding and the store of rendered pages."""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
import zlib
from pathlib import Path
from typing import Protocol

import numpy as np

from vellum.errors import InvalidRequest

#: PNG colour types and channels of the image kinds.
KINDS = {"RGB": (2, 3), "BGR": (2, 3), "ARGB": (6, 4), "GRAY": (0, 1), "BINARY": (0, 1)}


class PageRenderer(Protocol):
    """Renders the pages of a file; a plug-in, as no renderer is part of Spark."""

    def render(self, content: bytes, dpi: int) -> list[bytes]: ...


def png(pixels: np.ndarray, kind: str = "RGB") -> bytes:
    """Encodes rows x columns x channels of uint8."""
    if kind.strip().upper() not in KINDS:
        raise InvalidRequest(f"unknown image kind {kind!r}")
    kind = kind.strip().upper()
    colour, channels = KINDS[kind]
    image = np.asarray(pixels, dtype=np.uint8).reshape(pixels.shape[0], pixels.shape[1], channels)
    if kind == "BGR":
        image = image[:, :, ::-1]
    elif kind == "ARGB":
        image = image[:, :, [1, 2, 3, 0]]
    elif kind == "BINARY":
        image = np.where(image > 0, 255, 0).astype(np.uint8)
    rows = np.concatenate([np.zeros((image.shape[0], 1), np.uint8), image.reshape(image.shape[0], -1)], axis=1)

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


class PageImageStore:
    """Page images in a folder, as kb/doc/000001.png. Writes are atomic; keys cannot leave the folder."""

    def __init__(self, root: str) -> None:
        self.root = Path(root).resolve()

    @staticmethod
    def _segment(value: str, what: str, dot_start: bool) -> str:
        bad = not value or not value.strip() or value in (".", "..") or "/" in value or "\\" in value
        if bad or (not dot_start and value.startswith(".")):
            raise InvalidRequest(f"invalid {what}: {value!r}")
        return value

    def key(self, kb: str, doc: str, page: int) -> str:
        return f"{self._segment(kb, 'knowledge base', False)}/{self._segment(doc, 'document', True)}/{page:06d}.png"

    def store(self, kb: str, doc: str, page: int, content: bytes) -> str:
        if not content:
            raise InvalidRequest("empty page image")
        key = self.key(kb, doc, page)
        target = self.root / key
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=target.parent)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(content)
            os.replace(temporary, target)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise
        return key

    def retrieve(self, key: str | None) -> bytes | None:
        if not key or not key.strip():
            return None
        path = (self.root / key).resolve()
        if not path.is_relative_to(self.root) or not path.is_file():
            return None
        return path.read_bytes()

    def _drop(self, folder: Path) -> int:
        files = [p for p in folder.rglob("*") if p.is_file()] if folder.is_dir() else []
        if folder.is_dir():
            shutil.rmtree(folder)
        return len(files)

    def delete_base(self, kb: str) -> int:
        return self._drop(self.root / self._segment(kb, "knowledge base", False))

    def delete_document(self, kb: str, doc: str) -> int:
        return self._drop(self.root / self._segment(kb, "knowledge base", False) / self._segment(doc, "document", True))
