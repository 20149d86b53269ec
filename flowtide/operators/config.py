"""Thresholds of the snapshot detector."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """A candidate needs all three: robust z, absolute change, and change relative to the expected count."""

    z: float = 4.5
    absolute: float = 10.0
    relative: float = 0.35
