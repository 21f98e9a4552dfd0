"""Thresholds of the engine; every operator takes them as arguments, none is read from outside."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``reference_year`` decides the century of two-digit years and never comes from a clock."""

    reference_year: int = 2026
    max_upload_bytes: int = 15 * 1024 * 1024
    max_pixels: int = 45_000_000
    session_ttl_seconds: int = 3600
    min_line_chars: int = 28
    line_chars: int = 44
    min_width: int = 800
    min_height: int = 600
    blur_warning: float = 80.0
    glare_warning: float = 0.08
    visual_confidence_floor: float = 0.80


DEFAULTS = Settings()
