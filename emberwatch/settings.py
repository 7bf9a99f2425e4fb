"""Tunable defaults, in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Decision defaults (fixed values).
    top_k: int = 3
    match_threshold: float = 0.78
    action_threshold: float = 0.85
    suggest_actions: bool = True
    notify_on_new: bool = True
    # Clustering defaults (fixed values).
    window_s: int = 300
    min_cluster_size: int = 2
    cluster_threshold: float = 0.88
    # Length of the vectors made by the built-in text embedding.
    dim: int = 256
    # Physical limits: nothing larger than these is broadcast.
    broadcast_vectors: int = 16_384
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20
    # Rows per side of one task of the blocked top-K join. Q queries and V vectors are copied
    # 2*Q*V/knn_block_rows times in all, so blocks are as large as a task's memory allows.
    knn_block_rows: int = 32_768
    # Rows per block when similar texts are looked for.
    block_rows: int = 4_096
    # A key with more than 1/hot_fraction of all rows is split when it is joined.
    hot_fraction: int = 500


DEFAULTS = Settings()

KNOWLEDGE = "knowledge"
