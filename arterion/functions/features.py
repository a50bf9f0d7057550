"""The 23 waveform features of a window, and what a window must be like to have them."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from arterion.functions import dsp

Extractor = Callable[[np.ndarray, float, "list[dict]"], "dict[str, float | None]"]

# Fixed order of the feature vector.
NAMES = (
    "mean_rise_time_ms", "mean_decay_time_ms", "std_rise_time_ms", "mean_systolic_ratio", "mean_pw25_ms", "mean_pw50_ms", "mean_pw75_ms", "mean_area_ratio", "aix_proxy", "apg_aging_index",
    "mean_pulse_amplitude", "pulse_amp_cv", "notch_relative_amp",
    "fundamental_freq_hz", "harmonic_ratio_h2", "harmonic_ratio_h3", "spectral_entropy", "in_band_power_ratio",
    "baseline_drift_slope", "bvp_skewness", "bvp_kurtosis", "ibi_std_ms", "ibi_mean_ms",
)
EPS = 1e-9


def divide(a: float | None, b: float | None) -> float | None:
    """Null where the denominator is next to nothing."""
    return None if a is None or b is None or abs(b) < EPS else float(a / b)


def segment(x: np.ndarray, fs: float) -> list[dict]:
    """Beats from foot to foot: place of foot, peak and end, and the samples scaled to [0, 1]."""
    x = np.asarray(x, float).ravel()
    if not np.isfinite(x).any():
        return []
    x = np.where(np.isfinite(x), x, 0.0)
    if len(x) < 10 or np.ptp(x) < EPS:
        return []
    smooth = dsp.gaussian_smooth(x, max(0.5, len(x) / 500.0))
    peaks = dsp.find_peaks(smooth, max(1, int(fs * 0.4)), 0.15 * np.ptp(smooth))
    if len(peaks) < 2:
        return []
    edges = [0, *peaks.tolist()]
    feet = [a + int(smooth[a : b + 1].argmin()) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for foot, peak, end in zip(feet, peaks.tolist(), [*feet[1:], len(x) - 1], strict=True):
        if foot < peak < end and 60.0 / 150.0 <= (end - foot) / fs <= 60.0 / 45.0:
            part = x[foot : end + 1]
            span = float(np.ptp(part))
            scaled = (part - part.min()) / span if span > EPS else np.zeros_like(part)
            out.append({"foot": foot, "peak": peak, "end": end, "samples": scaled, "height": float(x[peak] - x[foot])})
    return out


def _gradient(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Central differences of rows of ``n`` samples, one-sided at their ends."""
    out, rows, last = np.zeros_like(y), np.arange(len(y)), n - 1
    out[:, 1:-1] = (y[:, 2:] - y[:, :-2]) / 2.0
    out[:, 0] = y[:, 1] - y[:, 0]
    out[rows, last] = y[rows, last] - y[rows, last - 1]
    return out


def beat_shapes(beats: list[dict], fs: float) -> dict[str, np.ndarray]:
    """Measures of all beats of a window at once, one value a beat, NaN where a beat doesn't have it.

    Beats are rows of one array, as long as the longest; only the search for notch and second peak goes beat by beat.
    """
    m, n = len(beats), np.array([len(b["samples"]) for b in beats])
    y = np.zeros((m, max(3, int(n.max()))))
    for k, b in enumerate(beats):
        y[k, : n[k]] = b["samples"]
    rows, place = np.arange(m), np.arange(y.shape[1])
    real = place < n[:, None]
    top = np.array([b["peak"] - b["foot"] for b in beats])
    peak = y[rows, top]
    rise, decay = top / fs * 1000.0, np.array([b["end"] - b["peak"] for b in beats]) / fs * 1000.0
    out = {"rise": rise, "decay": decay, "systolic": rise / np.maximum(rise + decay, EPS)}
    for name, level in (("pw25", 0.25), ("pw50", 0.5), ("pw75", 0.75)):
        above = real & (y >= level * np.where(real, y, -np.inf).max(1, keepdims=True))
        width = y.shape[1] - 1 - above[:, ::-1].argmax(1) - above.argmax(1)
        out[name] = np.where(n >= 3, width / fs * 1000.0, np.nan)
    total = np.cumsum(y, 1)
    before = total[rows, top] - (y[:, 0] + peak) / 2.0
    after = total[rows, n - 1] - total[rows, top] + (peak - y[rows, n - 1]) / 2.0
    part = lambda a, b, ok: np.divide(a, b, out=np.full(m, np.nan), where=ok & (np.abs(b) >= EPS))
    out["area"] = part(before, after, (top > 0) & (top < n - 1))
    # Turning points of the second derivative: the first five make the index of aging.
    bend = _gradient(_gradient(y, n), n)
    step = np.diff(bend, axis=1)
    turn = (step[:, :-1] * step[:, 1:] < 0) & (place[2:] < n[:, None])
    waves = bend[rows[:, None], np.argsort(~turn, axis=1, kind="stable")[:, :5] + 1] if turn.shape[1] >= 5 else np.zeros((m, 5))
    out["aging"] = part(waves[:, 1] - waves[:, 2:].sum(1), waves[:, 0].copy(), (turn.sum(1) >= 5) & (n >= 10))
    second, notch = np.full(m, np.nan), np.full(m, np.nan)
    for k, b in enumerate(beats):
        rest = b["samples"][top[k] :]
        if top[k] < n[k] - 3 and len(rest) >= 3:
            for found, wave in ((second, rest), (notch, -rest)):
                at = dsp.find_peaks(wave, prominence=0.02)
                if len(at):
                    found[k] = rest[at[0]]
    out["aix"], out["notch"] = part(second - peak, peak, ~np.isnan(second)), part(notch, peak, ~np.isnan(notch))
    return out


def _mean(x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    return float(x.mean()) if len(x) else None


def of_beats(x: np.ndarray, fs: float, beats: list[dict]) -> dict[str, float | None]:
    """The features that rest on beats: intervals and shapes of two at least, heights of one."""
    if not beats:
        return {}
    shape, heights = beat_shapes(beats, fs), np.array([b["height"] for b in beats])
    out = {"mean_pulse_amplitude": float(heights.mean()), "pulse_amp_cv": divide(float(heights.std()), float(heights.mean())) if len(heights) >= 2 else None, "notch_relative_amp": _mean(shape["notch"])}
    if len(beats) >= 2:
        names = {"rise": "mean_rise_time_ms", "decay": "mean_decay_time_ms", "systolic": "mean_systolic_ratio", "pw25": "mean_pw25_ms", "pw50": "mean_pw50_ms", "pw75": "mean_pw75_ms", "area": "mean_area_ratio", "aix": "aix_proxy", "aging": "apg_aging_index"}
        gaps = np.array([(b["end"] - b["foot"]) / fs * 1000.0 for b in beats])
        out |= {name: _mean(shape[k]) for k, name in names.items()} | {"std_rise_time_ms": float(shape["rise"].std()), "ibi_std_ms": float(gaps.std()), "ibi_mean_ms": float(gaps.mean())}
    return out


def spectral(x: np.ndarray, fs: float, beats: list[dict] | None = None) -> dict[str, float | None]:
    if len(x) < 16:
        return {}
    f, p = dsp.periodogram(x, fs, max(512, dsp.power_of_two(len(x))))
    band = (f >= 0.75) & (f <= 2.5)
    if not band.any():
        return {}
    f0 = float(f[band][p[band].argmax()])
    near = lambda hz: float(p[(f >= hz - 0.1) & (f <= hz + 0.1)].sum())
    power, entropy = float(p[band].sum()), None
    if power >= EPS:
        q = p[band][p[band] > 0] / power
        entropy = float(np.clip(-(q * np.log(q)).sum() / np.log(band.sum()), 0.0, 1.0)) if band.sum() > 1 else 0.0
    ratio = divide(power, float(p.sum()))
    return {"fundamental_freq_hz": f0, "harmonic_ratio_h2": divide(near(2 * f0), near(f0)), "harmonic_ratio_h3": divide(near(3 * f0), near(f0)), "spectral_entropy": entropy, "in_band_power_ratio": None if ratio is None else min(1.0, max(0.0, ratio))}


def trend(x: np.ndarray, fs: float, beats: list[dict] | None = None) -> dict[str, float | None]:
    if len(x) < 2:
        return {}
    d = x - x.mean()
    if d.std() < EPS:
        return {"baseline_drift_slope": 0.0, "bvp_skewness": 0.0, "bvp_kurtosis": 0.0}
    t = (np.arange(len(x)) - (len(x) - 1) / 2.0) / fs
    m2, m3, m4 = (float((d**k).mean()) for k in (2, 3, 4))
    big = m2 > EPS
    return {"baseline_drift_slope": divide(float(t @ d), float(t @ t)), "bvp_skewness": m3 / m2**1.5 if big else None, "bvp_kurtosis": m4 / m2**2 - 3.0 if big else None}


#: What fills the feature vector: each takes samples, rate and beats, and gives some of the features, later ones first.
EXTRACTORS: tuple[Extractor, ...] = (of_beats, spectral, trend)


def extract(x: np.ndarray, fs: float, extractors: tuple[Extractor, ...] = EXTRACTORS) -> dict[str, float | int | None]:
    """valid_beat_count, window_duration_s, fs and the 23 features; null for what can't be computed.

    An extractor that fails on a window leaves its features null; what it gives besides the 23 is left out.
    """
    x = np.asarray(x, float).ravel()
    beats = segment(x, fs)
    out: dict[str, float | int | None] = {"valid_beat_count": len(beats), "window_duration_s": len(x) / fs, "fs": fs} | dict.fromkeys(NAMES)
    for one in extractors:
        try:
            found = one(x, fs, beats)
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
            continue
        out |= {k: v for k, v in found.items() if k in NAMES}
    return out


def vector(found: dict[str, float | int | None]) -> np.ndarray:
    """The 23 features in their order, NaN for null."""
    return np.array([np.nan if found.get(n) is None else found[n] for n in NAMES], float)


def as_json(found: dict[str, float | int | None]) -> str:
    """All of it in a fixed order, with null for what isn't finite."""
    order = ("valid_beat_count", "window_duration_s", "fs", *NAMES)
    return json.dumps({n: None if found.get(n) is None or not np.isfinite(found[n]) else found[n] for n in order})


def guard(x: np.ndarray, fs: float, sqi: float | None = None, blocking: bool = False, artifact: float | None = None) -> list[str]:
    """Reasons against extracting features, in their order."""
    x = np.asarray(x, float).ravel()
    finite = np.isfinite(x)
    flat = not finite.any() or np.ptp(x[finite]) < EPS
    checks = (
        ("LOW_FS", not np.isfinite(fs) or fs < 15.0), ("SIGNAL_TOO_SHORT", not (np.isfinite(fs) and fs > 0) or len(x) / fs < 4.0), ("NON_FINITE_SAMPLES", len(x) > 0 and not finite.all()),
        ("SIGNAL_DEGENERATE", flat), ("LOW_SQI", sqi is not None and sqi < 0.4), ("BLOCKING_WARNING", blocking), ("HIGH_ARTIFACT", artifact is not None and artifact > 0.25),
    )
    return [name for name, bad in checks if bad]


def extract_checked(x: np.ndarray, fs: float, **conditions) -> tuple[dict | None, list[str]]:
    """(features or None, reasons): features only of windows that pass the guard and have three beats."""
    reasons = guard(x, fs, **conditions)
    if reasons:
        return None, reasons
    found = extract(x, fs)
    return (found, []) if found["valid_beat_count"] >= 3 else (None, ["TOO_FEW_BEATS"])
