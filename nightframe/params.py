"""Thresholds and options of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that results depend on.
Z = 1.96
IQR_FACTOR = 1.5
USAGE_HOURS, USAGE_HOURS_STRICT = 4.0, 6.0
LONG_EVENT_SEC, VERY_LONG_EVENT_SEC = 30.0, 60.0
AHI_BANDS = (5.0, 15.0, 30.0)
TREND_ROWS = 30
EPAP_SPLIT, EPAP_RANGE = 7.0, (4.0, 25.0)
EVENT_WINDOW_SEC = 5.0
SEASON = 7
APNEA_TYPES = ("ClearAirway", "Obstructive", "Mixed")
FLOW_TYPE = "FLG"
EXACT_RANK_TEST_N = 28
HEAVY_TIES = 0.2
BH_Q = 0.05
MIN_PAIRS = 10
MIN_NIGHTS = 7
LAGS = 7
PERMUTATIONS = 2000


@dataclass(frozen=True)
class ClusterParams:
    """Options of event clustering; times in seconds."""

    algorithm: str = "bridged"
    gap: float = 120.0
    bridge_threshold: float = 0.1
    bridge_gap: float = 60.0
    edge_enter: float = 0.5
    edge_exit: float = 0.35
    edge_min: float = 10.0
    k: int = 3
    rounds: int = 25
    min_density: float = 0.0
    min_events: int = 3
    min_total: float = 60.0
    max_span: float = 230.0
    seed: int = 17


    @classmethod
    def from_options(cls, options: dict) -> ClusterParams:
        """Parameters by name; ``min_density`` also goes by ``min_density_per_min``, and the former counts if it is a number."""
        known = {k: v for k, v in options.items() if k in cls.__dataclass_fields__}
        if not isinstance(known.get("min_density"), (int, float)):
            known["min_density"] = options.get("min_density_per_min") or cls.min_density
        return cls(**known)


@dataclass(frozen=True)
class FalseNegativeParams:
    """Flow-limited stretches without an event nearby."""

    threshold: float = 0.1
    peak: float = 0.95
    min_span: float = 60.0
    max_span: float = 600.0
    gap: float = 60.0


#: Presets by name.
FALSE_NEGATIVES = {
    "strict": FalseNegativeParams(0.9, 0.98, 120.0),
    "balanced": FalseNegativeParams(0.1, 0.95, 60.0),
    "lenient": FalseNegativeParams(0.5, 0.85, 45.0),
}
