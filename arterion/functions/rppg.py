"""Projections of RGB traces to a pulse wave: GREEN, CHROM and POS, each (n, 3) to (n,)."""

from __future__ import annotations

import numpy as np

from arterion.functions import dsp

LOW_HZ, HIGH_HZ, WINDOW_S = 0.75, 2.5, 1.6


def window_length(fs: float) -> int:
    return max(9, int(np.ceil(WINDOW_S * fs)))


def green(rgb: np.ndarray, fs: float) -> np.ndarray:
    return dsp.butter_band_pass(dsp.z_score(np.asarray(rgb, float)[:, 1]), LOW_HZ, HIGH_HZ, fs, 2)


def _normal(blocks: np.ndarray) -> np.ndarray:
    """Each channel of each block over its mean."""
    mean = blocks.mean(1, keepdims=True)
    return blocks / np.where(mean == 0, 1e-7, mean)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 1e-7, a / np.where(b > 1e-7, b, 1.0), 0.0)


def _overlap(parts: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Weighted mean of overlapping blocks at their places."""
    at = (starts[:, None] + np.arange(parts.shape[1])).ravel()
    total, weight = np.bincount(at, parts.ravel(), n), np.bincount(at, np.broadcast_to(weights, parts.shape).ravel(), n)
    return np.divide(total, weight, out=np.zeros(n), where=weight > 0)


def pos_overlap(rgb: np.ndarray, fs: float) -> np.ndarray:
    """POS before its filters."""
    rgb, size = np.asarray(rgb, float), window_length(fs)
    if len(rgb) < size:
        return np.zeros(len(rgb))
    blocks = _normal(np.lib.stride_tricks.sliding_window_view(rgb, size, axis=0).swapaxes(1, 2))
    r, g, b = blocks[..., 0], blocks[..., 1], blocks[..., 2]
    s0, s1 = g - b, g + b - 2.0 * r
    h = s0 + _ratio(s0.std(1), s1.std(1))[:, None] * s1
    return _overlap(h - h.mean(1, keepdims=True), np.ones(size), np.arange(len(blocks)), len(rgb))


def chrom_overlap(rgb: np.ndarray, fs: float) -> np.ndarray:
    """CHROM before its filters."""
    rgb, size = np.asarray(rgb, float), window_length(fs)
    size += size % 2
    n = len(rgb)
    if n < size:
        return np.zeros(n)
    starts = np.unique(np.append(np.arange(0, n - size + 1, max(1, size // 2)), n - size))
    blocks = _normal(rgb[starts[:, None] + np.arange(size)])
    r, g, b = blocks[..., 0], blocks[..., 1], blocks[..., 2]
    x, y = 3.0 * r - 2.0 * g, 1.5 * r + g - 1.5 * b
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    taper = np.maximum(np.hanning(size), 0.05)
    return _overlap((x - _ratio(x.std(1), y.std(1))[:, None] * y) * taper, taper, starts, n)


def pos(rgb: np.ndarray, fs: float) -> np.ndarray:
    return dsp.butter_band_pass(dsp.smoothness_detrend(pos_overlap(rgb, fs)), LOW_HZ, HIGH_HZ, fs, 1)


def chrom(rgb: np.ndarray, fs: float) -> np.ndarray:
    return dsp.butter_band_pass(dsp.smoothness_detrend(chrom_overlap(rgb, fs)), LOW_HZ, HIGH_HZ, fs, 1)


METHODS = {"GREEN": green, "CHROM": chrom, "POS": pos}


def method(name: str):
    """The method of a name in any case; others raise."""
    try:
        return METHODS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown method {name!r}") from None
