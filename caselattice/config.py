"""Thresholds and weights of the rules, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    spike_hours: int = 24
    spike_calls: int = 5
    burst_seconds: int = 7200
    burst_calls: int = 5
    frequency_least: int = 3
    frequency_factor: float = 2.5
    large_amount: float = 150_000.0
    fan_in_senders: int = 3
    chain_hours: int = 48
    chain_hops: int = 5
    incident_days: int = 3
    incident_events: int = 2
    motif_ratio: float = 1.5
    off_hours: tuple[int, ...] = (23, 0, 1, 2, 3, 4)
    colocation_hours: int = 24
    session_minutes: int = 30
    overlap_iou: float = 0.3
    weight_degree: float = 0.15
    weight_betweenness: float = 0.20
    weight_pagerank: float = 0.15
    weight_flags: float = 0.50
    flags_for_full: int = 3
    risk_degree: float = 0.20
    risk_temporal: float = 0.20
    risk_colocation: float = 0.15
    risk_calls: float = 0.20
    risk_transfers: float = 0.25


RULES = Rules()
