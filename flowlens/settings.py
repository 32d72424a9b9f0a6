"""Detection thresholds, response policy and flow parameters.

Plain frozen dataclasses passed as arguments; operators turn them into
literals so Catalyst can fold them. ``updated`` mirrors the reference's
settings update: unknown keys and non-numeric threshold values are ignored.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: default decision thresholds
    xgb_suspicious: float = 0.60
    xgb_attack: float = 0.85
    autoencoder: float = 0.05
    transformer: float = 0.50

    def updated(self, **values) -> "Thresholds":
        clean = {}
        for f in dataclasses.fields(self):
            if f.name in values:
                try:
                    clean[f.name] = float(values[f.name])
                except (TypeError, ValueError):
                    continue
        return dataclasses.replace(self, **clean)


@dataclass(frozen=True)
class Policy:
    # fixed values: default response policy (dry_run on: nothing is enforced)
    auto_block: bool = False
    dry_run: bool = True
    block_threshold: int = 5
    block_duration_seconds: int = 300
    event_limit: int = 1000
    alert_min_severity: str = "suspicious"   # observe | suspicious | attack

    def updated(self, **values) -> "Policy":
        clean = {f.name: values[f.name] for f in dataclasses.fields(self) if f.name in values}
        return dataclasses.replace(self, **clean)


@dataclass(frozen=True)
class FlowConfig:
    # fixed values: flow timeouts (s), sequence and interim parameters
    idle_s: float = 15.0
    active_s: float = 120.0
    sequence_len: int = 16
    pad_early: bool = True
    min_context: int = 3
    stride: int = 4
    min_packets: int = 1
    interim_min_packets: int = 2
    interim_step: int = 6

    @property
    def idle_us(self) -> int:
        return int(round(self.idle_s * 1_000_000))

    @property
    def active_us(self) -> int:
        return int(round(self.active_s * 1_000_000))


DEFAULT_THRESHOLDS = Thresholds()
DEFAULT_POLICY = Policy()
DEFAULT_FLOW = FlowConfig()
