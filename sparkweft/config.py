"""Engine settings; every operator takes them as plain parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    max_basket: int = 250
    noisy_factor: float = 0.25
    weight_floor: float = 0.05
    top_k: int = 50
    min_weight: float = 1.0
    max_depth: int = 2
    max_results: int = 100
    rrf_k: int = 60
    hub_floor: int = 80
    hub_strength: float = 1.0
    tiebreak: float = 0.1
    time_constant_days: float = 180.0
    prune_below: float = 0.05
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    restart: float = 0.15
    mmr_lambda: float = 0.7
    mmr_protect: int = 5
    dwell_positive: float = 30.0
    broadcast_rows: int = 100_000


CONFIG = EngineConfig()
