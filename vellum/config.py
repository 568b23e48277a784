"""Every default of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass

from vellum.errors import InvalidRequest


@dataclass(frozen=True)
class Settings:
    # ingest
    max_file_bytes: int = 104_857_600
    max_text_chars: int = 10_000_000
    chunk_size: int = 1500
    chunk_overlap: int = 200
    text_batch: int = 64
    page_batch: int = 8
    render_dpi: int = 150
    # text layer
    quality_low: int = 50
    quality_full: int = 500
    # queue
    queue_page_threshold: int = 20
    max_retries: int = 3
    # search
    text_top_k: int = 5
    page_top_k: int = 10
    text_overfetch: int = 4
    page_overfetch: int = 2
    prefetch_factor: int = 10
    default_mode: str = "auto"
    # fusion
    default_fusion: str = "rrf"
    rrf_k: int = 60
    text_weight: float = 0.5
    visual_weight: float = 0.5
    text_floor: float = 1.0
    visual_floor: float = 50.0
    # confidence
    confidence_text_weight: float = 0.4
    confidence_visual_weight: float = 0.4
    confidence_agreement_weight: float = 0.2
    high_above: float = 0.7
    medium_above: float = 0.4
    # the search side of a batch of queries is broadcast up to this many bytes
    broadcast_bytes: int = 8 << 20

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise InvalidRequest("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise InvalidRequest("chunk_overlap must be in [0, chunk_size)")
        if self.quality_low < 0 or self.quality_low > self.quality_full:
            raise InvalidRequest("quality thresholds must satisfy 0 <= low <= full")


DEFAULTS = Settings()
