"""Spectral features of evenly sampled windows, for arrays (they run on Arrow batches of windows)."""

from __future__ import annotations

import numpy as np


def _spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft(x)) if len(x) else np.zeros(0)


def spectral_centroid(x: np.ndarray, fs: float = 1.0) -> float:
    """Mean frequency weighted by magnitude, 0 where there is none."""
    f, a = _spectrum(np.asarray(x, float), fs)
    return float((f * a).sum() / a.sum()) if a.sum() > 0 else 0.0


def fundamental_frequency(x: np.ndarray, fs: float = 1.0) -> float:
    """The frequency, other than zero, of the largest magnitude."""
    x = np.asarray(x, float)
    f, a = _spectrum(x - x.mean() if len(x) else x, fs)
    return float(f[1:][np.argmax(a[1:])]) if len(a) > 1 and a[1:].max() > 0 else 0.0


def spectral_entropy(x: np.ndarray, fs: float = 1.0) -> float:
    """Entropy of the power's shares, by that of equal shares."""
    x = np.asarray(x, float)
    p = _spectrum(x - x.mean() if len(x) else x, fs)[1] ** 2
    if p.sum() == 0 or len(p) < 2:
        return 0.0
    p = p / p.sum()
    return float(-(p[p > 0] * np.log2(p[p > 0])).sum() / np.log2(len(p)))


def band_power(x: np.ndarray, low: float, high: float, fs: float = 1.0) -> float:
    """Share of the power between two frequencies, both inclusive."""
    x = np.asarray(x, float)
    f, a = _spectrum(x - x.mean() if len(x) else x, fs)
    p = a**2
    return float(p[(f >= low) & (f <= high)].sum() / p.sum()) if p.sum() > 0 else 0.0


def welch_density(x: np.ndarray, coefficients=(0, 1, 2), fs: float = 1.0, segment: int = 256) -> list[float]:
    """Power densities of half-overlapping Hann segments without their means, averaged; NaN past the last frequency."""
    x = np.asarray(x, float)
    n = min(segment, len(x))
    if not n:
        return [float("nan")] * len(coefficients)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    parts = np.stack([x[k : k + n] for k in range(0, len(x) - n + 1, step)])
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
    density = power.mean(axis=0) / (fs * (taper**2).sum() or 1.0)
    density[1 : None if n % 2 else -1] *= 2
    return [float(density[k]) if k < len(density) else float("nan") for k in coefficients]
