"""What networks over face crops take and give (for :mod:`arterion.operators.inference`); traces; edges of filters; skin colours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from arterion.functions import dsp

# Landmarks of the regions, and skin in the YCrCb space.
LANDMARKS = {
    "forehead": (10, 67, 109, 108, 151, 337, 338, 297), "left_cheek": (116, 117, 118, 123, 147, 187, 205, 207), "right_cheek": (345, 346, 347, 352, 376, 411, 425, 427),
}
SKIN = {"y": (20, 240), "cr": (133, 173), "cb": (77, 127)}
LEAST_SKIN = 0.10
TINY = 1e-7


@dataclass(frozen=True)
class ModelSpec:
    """What a network over face crops takes and gives."""

    name: str
    inputs: tuple[str, ...]
    layout: str
    derivative: bool
    size: int
    frames: int
    depth: int | None
    fps: float = 30.0
    tier: str = "benchmark_only"

    @property
    def seconds(self) -> float:
        return self.frames / self.fps


SPECS = {
    s.name: s
    for s in (
        ModelSpec("tscan", ("difference", "standard"), "stack", True, 72, 180, 10, tier="realtime_candidate"),
        ModelSpec("efficientphys", ("standard",), "stack", True, 72, 180, 10, tier="realtime_candidate"),
        ModelSpec("deepphys", ("difference", "standard"), "stack", True, 72, 180, None),
        ModelSpec("physnet", ("difference",), "volume", False, 72, 128, None),
    )
}


def preprocess_rgb(rgb: np.ndarray, detrend: bool = True, normalise: bool = True, weight: float = 100.0) -> np.ndarray:
    """Traces (n, 3), each channel detrended and scaled as asked; under three samples as they are."""
    x = np.array(rgb, float)
    if len(x) < 3:
        return x
    columns = dsp.smoothness_detrend(x.T, weight) if detrend else x.T
    if normalise:
        spread = columns.std(1, keepdims=True)
        columns = (columns - columns.mean(1, keepdims=True)) / np.where(spread < TINY, 1.0, spread)
    return columns.T


def edge_errors(original: np.ndarray, filtered: np.ndarray, edge: int) -> tuple[float, float, float]:
    """Mean absolute error of the first and last ``edge`` samples, and between them; NaN of windows too short."""
    if len(original) <= 2 * edge:
        return (np.nan,) * 3
    off = np.abs(np.asarray(filtered, float) - original)
    return float(off[:edge].mean()), float(off[len(off) - edge :].mean()), float(off[edge : len(off) - edge].mean())


def skin(rgb: np.ndarray) -> np.ndarray:
    """The pixels (n, 3) of skin colour; all of them where those are under a tenth."""
    x = np.asarray(rgb, float)
    if not len(x):
        return x
    y = np.rint(x @ (0.299, 0.587, 0.114))
    cr, cb = np.rint((x[:, 0] - y) * 0.713 + 128), np.rint((x[:, 2] - y) * 0.564 + 128)
    held = np.ones(len(x), bool)
    for v, (low, high) in ((y, SKIN["y"]), (cr, SKIN["cr"]), (cb, SKIN["cb"])):
        held &= (v >= low) & (v <= high)
    return x[held] if held.mean() >= LEAST_SKIN else x
