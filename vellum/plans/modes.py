"""Retrieval modes."""

from __future__ import annotations

from dataclasses import dataclass

from vellum.config import DEFAULTS, Settings
from vellum.errors import InvalidRequest

#: The retrieval modes by name.
MODES = ("auto", "text_only", "colpali_only", "fusion")


@dataclass(frozen=True)
class Resolved:
    mode: str
    warnings: tuple[str, ...] = ()


def resolve(mode: str | None, visual: bool, settings: Settings = DEFAULTS) -> Resolved:
    """What runs for a requested mode and a base with or without a visual index. Blank means the default."""
    wanted = (mode or "").strip().lower() or settings.default_mode
    if wanted not in MODES:
        raise InvalidRequest(f"unknown retrieval mode {mode!r}; known: {', '.join(MODES)}")
    if wanted == "auto":
        return Resolved("fusion" if visual else "text_only")
    if wanted == "fusion" and not visual:
        return Resolved("text_only_fallback", ("no visual index; text search only",))
    if wanted == "colpali_only" and not visual:
        raise InvalidRequest("colpali_only needs a visual index")
    return Resolved(wanted)
