"""Job parameters. The defaults are fixed values: they define the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PeakParams:
    """Adaptive peak detector.

    ``win_length`` rows (not hours) make up the first baseline, a point is a peak when it
    exceeds ``mean + diff * std``, and ``influence`` says how far a peak moves the baseline.
    """

    win_length: int = 72
    diff: float = 10.0
    influence: float = 0.0

    def __post_init__(self) -> None:
        if self.win_length < 2:
            raise ValueError("win_length must be at least 2")
        if self.influence < 0:
            raise ValueError("influence must not be negative")


@dataclass(frozen=True)
class TemplateParams:
    """Similarity score against labelled reference series."""

    series_length: int = 150
    reference_length: int = 150
    decay: float = 0.1
    alpha: float = 0.1
    smooth: int = 1
    baseline_offset: int = 40

    def __post_init__(self) -> None:
        if self.series_length < 1:
            raise ValueError("series_length must be positive")
        if self.reference_length < self.series_length:
            raise ValueError("reference_length must be at least series_length")


@dataclass(frozen=True)
class EventParams:
    """Day buckets around an event.

    An event date starts at local midnight in ``zone``. ``closed="both"`` counts a point on a
    bucket boundary in both neighbouring buckets; ``closed="left"`` counts it once.
    """

    views_threshold: float = 300.0
    zone: str = "America/Chicago"
    closed: str = "both"

    def __post_init__(self) -> None:
        if self.closed not in ("both", "left"):
            raise ValueError("closed must be 'both' or 'left'")
