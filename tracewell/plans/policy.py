"""Tunables of every query, as one immutable value with a canonical text and a digest that answers can carry."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, fields

SECOND, MILLI = 1_000_000_000, 1_000_000
REFERENCE_DOMAIN = "reference"


@dataclass(frozen=True)
class Policy:
    fresh_ns: int = 2 * SECOND
    aging_ns: int = 10 * SECOND
    stale_ns: int = 60 * SECOND
    max_clock_uncertainty_ns: int = MILLI
    allow_holdover: bool = True
    residual_tolerance_ns: int = 1_000
    allow_partial: bool = False
    watch_ns: int = MILLI
    elevated_ns: int = 10 * MILLI
    min_samples: int = 8
    history_buckets: int = 512
    replay_window: int = 4096
    sessions_per_source: int = 64
    hops_per_path: int = 64
    batch_records: int = 4096
    reasons: int = 24
    reference_domain: str = REFERENCE_DOMAIN

    def __post_init__(self):
        if not 0 <= self.fresh_ns <= self.aging_ns <= self.stale_ns:
            raise ValueError("freshness horizons must not fall: fresh <= aging <= stale")
        if self.watch_ns <= 0 or self.elevated_ns < self.watch_ns:
            raise ValueError("anomaly thresholds need 0 < watch <= elevated")
        bad = [f.name for f in fields(self) if f.type == "int" and getattr(self, f.name) < 0]
        if bad:
            raise ValueError(f"negative: {', '.join(bad)}")

    def text(self) -> str:
        return "".join(f"{k}={v}\n" for k, v in sorted(asdict(self).items()))

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


DEFAULT = Policy()
#: Probes as exact fractions.
PROBES = ((50, 100), (90, 100), (99, 100), (999, 1000))


def default_bounds() -> list[int]:
    """Histogram bounds: the 1-2-5 series from a microsecond to ten seconds."""
    return [m * 10**e for e in range(3, 10) for m in (1, 2, 5)] + [10**10]


def probe(numerator: int, denominator: int) -> tuple[int, int]:
    if denominator <= 0 or not 0 < numerator <= denominator:
        raise ValueError(f"no such quantile: {numerator}/{denominator}")
    return numerator, denominator


def check_bounds(bounds: list[int], most: int = 512) -> list[int]:
    if not bounds or len(bounds) > most or bounds[0] < 0 or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("histogram bounds must rise strictly from 0 or more")
    return bounds


def bounds_digest(bounds: list[int]) -> str:
    """SHA-256 of a histogram's canonical text."""
    return hashlib.sha256(f"histogram.bounds={','.join(map(str, check_bounds(bounds)))}\n".encode()).hexdigest()
