"""Thresholds of the engine, in one place; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    min_reviews: int = 30
    min_tag_rows: int = 3
    strength_percent: int = 60
    weakness_percent: int = 20
    trend_points: int = 3
    action_percent: int = 15
    action_high: int = 30
    action_medium: int = 20
    dominant_share: float = 0.8
    decay_rate: float = 0.01
    decay_floor: float = 0.01
    similarity: float = 0.5
    keywords_per_tag: int = 3
    page_limit: int = 1000
    new_reviews: int = 5
    change_percent: float = 15.0
    drift_points: float = 8.0
    session_zone: str = "UTC"
    local_zone: str = "Asia/Seoul"


DEFAULT = EngineConfig()
