"""Signal-quality scores of a pulse wave or of traces."""

from __future__ import annotations

import numpy as np

from arterion.functions import dsp, rppg

LOW_HZ, HIGH_HZ = 0.75, 2.5


def half_even(x: float, places: int) -> float:
    return float(round(x, places))


def bvp_snr(x: np.ndarray, fs: float = 30.0, tolerance: float = 0.1) -> float:
    """dB of the bins around the strongest frequency of the band and its double, against the rest of the band."""
    x = np.asarray(x, float).ravel()
    if len(x) < 16 or not x.any():
        return -10.0
    f, p = dsp.periodogram(x, fs, max(512, dsp.power_of_two(len(x))))
    band = (f >= LOW_HZ) & (f <= HIGH_HZ)
    if not band.any():
        return -10.0
    top = f[band][p[band].argmax()]
    own = ((f >= top - tolerance) & (f <= top + tolerance)) | ((f >= 2 * top - tolerance) & (f <= 2 * top + tolerance))
    signal, noise = p[own].sum(), p[band & ~own].sum()
    if noise <= 1e-12:
        return 15.0 if signal > 0 else -10.0
    return float(10.0 * np.log10(signal / noise))


def sqi(x: np.ndarray, fs: float = 30.0) -> float:
    return half_even(float(np.clip((bvp_snr(x, fs) + 5.0) / 15.0, 0.0, 1.0)), 2)


def autocorrelation(x: np.ndarray) -> np.ndarray | None:
    """Normalised autocorrelation by lag from 0, or None of a flat signal."""
    x = np.asarray(x, float).ravel()
    x = x - x.mean()
    power = float(x @ x)
    if power < 1e-12:
        return None
    n = dsp.power_of_two(2 * len(x))
    return np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[: len(x)] / power


def _lags(n: int, fs: float, low_bpm: float, high_bpm: float) -> tuple[int, int]:
    return int(np.floor(fs * 60.0 / high_bpm)), min(int(np.ceil(fs * 60.0 / low_bpm)), n - 1)


def periodicity(x: np.ndarray, fs: float = 30.0, low_bpm: float = 45.0, high_bpm: float = 150.0) -> tuple[float, float]:
    """(score in [0, 1] to 2 places, highest autocorrelation among pulse lags to 4)."""
    x = np.asarray(x, float).ravel()
    first, last = _lags(len(x), fs, low_bpm, high_bpm)
    if len(x) < 16 or not x.any() or first > last or first >= len(x):
        return 0.0, 0.0
    rho = autocorrelation(x)
    if rho is None:
        return 0.0, 0.0
    top = float(rho[first : last + 1].max())
    return half_even(min(1.0, max(0.0, top)), 2), half_even(top, 4)


def periodicity_variants(x: np.ndarray, fs: float = 30.0) -> dict[str, float | None]:
    """Highest value, highest local peak and first local peak of the autocorrelation among pulse lags, and the best lag."""
    rho = autocorrelation(x)
    first, last = _lags(len(np.ravel(x)), fs, 45.0, 150.0)
    if rho is None or first > last:
        return {"max_raw": None, "max_peak": None, "first_peak": None, "best_lag": None}
    part = rho[first : last + 1]
    peaks = dsp.local_maxima(part)
    return {
        "max_raw": float(part.max()), "max_peak": float(part[peaks].max()) if len(peaks) else None,
        "first_peak": float(part[peaks[0]]) if len(peaks) else None, "best_lag": float(first + part.argmax()),
    }


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson; 0 if either is constant."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    a, b = a - a.mean(), b - b.mean()
    power = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / power if power > 1e-12 else 0.0


def cross_roi(rois: dict[str, np.ndarray], fs: float) -> dict[str, float]:
    """Mean and least Pearson of the POS waves of each two regions."""
    waves = [rppg.pos(np.asarray(v, float), fs) for _, v in sorted(rois.items())]
    r = [correlation(waves[i], waves[j]) for i in range(len(waves)) for j in range(i)]
    return {"r_mean": float(np.mean(r)), "r_min": float(np.min(r))} if r else {"r_mean": 0.0, "r_min": 0.0}


def motion(centres: np.ndarray, fs: float) -> float:
    """Share of the variance of box centres (n, 2) that lies in the pulse band."""
    centres = np.asarray(centres, float)
    if len(centres) < 9:
        return 0.0
    total = float(centres.var(0).sum())
    band = dsp.butter_band_pass(centres.T, LOW_HZ, HIGH_HZ, fs, 2)
    return float(np.clip(band.var(1).sum() / total, 0.0, 1.0)) if total > 1e-12 else 0.0


def stacked(x: np.ndarray, fs: float, wanted: tuple[str, ...], tolerance: float = 0.1) -> dict[str, np.ndarray]:
    """fft_bpm, snr_db, sqi, periodicity and acf_peak of windows (rows of ``x``) of one length, as far as wanted: what
    the functions of single windows give, by one transform of all."""
    n, size = x.shape
    flat = ~x.any(axis=1)
    out: dict[str, np.ndarray] = {}
    if {"fft_bpm", "snr_db", "sqi"} & set(wanted):
        snr, bpm = np.full(n, -10.0), np.zeros(n)
        f = np.fft.rfftfreq(nfft := max(512, dsp.power_of_two(size)), 1.0 / fs)
        band = (f >= LOW_HZ) & (f <= HIGH_HZ)
        if size >= 16 and band.any():
            p = np.abs(np.fft.rfft(x, nfft, axis=1)) ** 2 / (fs * size)
            p[:, 1 : p.shape[1] - (nfft % 2 == 0)] *= 2
            top = f[band][p[:, band].argmax(axis=1)]
            bpm = top * 60.0
            own = np.zeros(p.shape, bool)
            for at in (top, 2 * top):
                own |= (f >= at[:, None] - tolerance) & (f <= at[:, None] + tolerance)
            signal, rest = (p * own).sum(axis=1), (p * (band & ~own)).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                snr = np.where(rest <= 1e-12, np.where(signal > 0, 15.0, -10.0), 10.0 * np.log10(signal / rest))
            snr = np.where(flat, -10.0, snr)
        out |= {"fft_bpm": bpm, "snr_db": snr, "sqi": np.array([half_even(float(v), 2) for v in np.clip((snr + 5.0) / 15.0, 0.0, 1.0)])}
    if {"periodicity", "acf_peak"} & set(wanted):
        first, last = _lags(size, fs, 45.0, 150.0)
        top = np.zeros(n)
        if size >= 16 and first <= last and first < size:
            y = x - x.mean(axis=1, keepdims=True)
            power = (y * y).sum(axis=1)
            width = dsp.power_of_two(2 * size)
            rho = np.fft.irfft(np.abs(np.fft.rfft(y, width, axis=1)) ** 2, width, axis=1)[:, first : last + 1]
            known = (power >= 1e-12) & ~flat
            top = np.where(known, rho.max(axis=1) / np.where(known, power, 1.0), 0.0)
        out |= {"periodicity": np.array([half_even(min(1.0, max(0.0, float(v))), 2) for v in top]), "acf_peak": np.array([half_even(float(v), 4) for v in top])}
    return {k: v for k, v in out.items() if k in wanted}


def noise(kind: str, n: int, seed: int) -> np.ndarray:
    """White, pink or random-walk noise."""
    rng = np.random.default_rng(seed)
    white = rng.normal(size=n)
    if kind == "white":
        return white
    if kind == "walk":
        return np.cumsum(white)
    if kind == "pink":
        spectrum = np.fft.rfft(white)
        return np.fft.irfft(spectrum / np.sqrt(np.maximum(1.0, np.arange(len(spectrum)))), n)
    raise ValueError(f"unknown noise {kind!r}")
