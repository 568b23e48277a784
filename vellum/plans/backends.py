"""Dispatch of requests to backends by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Generic, TypeVar

from vellum.errors import InvalidRequest

B = TypeVar("B")


@dataclass(frozen=True)
class Backends(Generic[B]):
    """Backends by name in any case; a blank name means the default."""

    known: Mapping[str, B]
    default: str

    def list(self) -> list[dict]:
        """The knowledge bases of all backends, each with its backend's name; a backend that fails is an entry with its
        error, and the others are still listed."""
        out = []
        for key in sorted(self.known):
            try:
                out += [{"backend": key, **entry} for entry in self.known[key].list()]
            except Exception as e:  # noqa: BLE001 - one backend's failure is that backend's entry
                out.append({"backend": key, "error": str(e) or type(e).__name__})
        return out

    def pick(self, name: str | None) -> B:
        wanted = (name or "").strip().lower() or self.default.lower()
        for key, backend in self.known.items():
            if key.lower() == wanted:
                return backend
        raise InvalidRequest(f"unknown backend {name!r}; known: {', '.join(sorted(self.known))}")
