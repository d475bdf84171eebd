"""Filter design and random numbers, in numpy."""

from __future__ import annotations

import math

import numpy as np

BUTTERWORTH = math.sqrt(0.5)
BUTTERWORTH_DB = 20 * math.log10(BUTTERWORTH)


def biquad(kind: str, freq: float, q: float, gain_db: float, rate: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a cookbook filter; q is linear, the frequency stays below Nyquist."""
    w = 2 * math.pi * min(max(freq, 1e-4), rate / 2 * 0.999) / rate
    cw, alpha = math.cos(w), math.sin(w) / (2 * max(1e-4, q))
    a = 10 ** (gain_db / 40)
    root = 2 * math.sqrt(a) * alpha
    up, down = a + 1, a - 1
    b, d = {
        "lowpass": (((1 - cw) / 2, 1 - cw, (1 - cw) / 2), (1 + alpha, -2 * cw, 1 - alpha)),
        "highpass": (((1 + cw) / 2, -1 - cw, (1 + cw) / 2), (1 + alpha, -2 * cw, 1 - alpha)),
        "bandpass": ((alpha, 0.0, -alpha), (1 + alpha, -2 * cw, 1 - alpha)),
        "notch": ((1.0, -2 * cw, 1.0), (1 + alpha, -2 * cw, 1 - alpha)),
        "allpass": ((1 - alpha, -2 * cw, 1 + alpha), (1 + alpha, -2 * cw, 1 - alpha)),
        "peaking": ((1 + alpha * a, -2 * cw, 1 - alpha * a), (1 + alpha / a, -2 * cw, 1 - alpha / a)),
        "lowshelf": ((a * (up - down * cw + root), 2 * a * (down - up * cw), a * (up - down * cw - root)), (up + down * cw + root, -2 * (down + up * cw), up + down * cw - root)),
        "highshelf": ((a * (up + down * cw + root), -2 * a * (down + up * cw), a * (up + down * cw - root)), (up - down * cw + root, 2 * (down - up * cw), up - down * cw - root)),
    }[kind]
    return tuple(x / d[0] for x in (*b, d[1], d[2]))


def node_biquad(kind: str, freq: float, q: float, gain_db: float, rate: float):
    """As ``biquad``, with the q of low- and high-pass in decibels."""
    return biquad(kind, freq, 10 ** (q / 20) if kind in ("lowpass", "highpass") else q, gain_db, rate)


def k_weighting(rate: float) -> list[tuple]:
    """The two stages of BS.1770 K-weighting at any rate."""
    # Analogue prototypes of the published 48 kHz tables.
    f, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, vh = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)]


def response(cascade: list[tuple], freq, rate: float) -> np.ndarray:
    """Complex response of a cascade."""
    z = np.exp(-2j * np.pi * np.asarray(freq, float) / rate)
    out = np.ones_like(z)
    for b0, b1, b2, a1, a2 in cascade:
        out = out * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return out


def lr4(kind: str, freq: float, rate: float) -> list[tuple]:
    """Fourth-order Linkwitz-Riley: two Butterworth stages."""
    return [biquad(kind, freq, BUTTERWORTH, 0, rate)] * 2


def crossover(low: float, high: float, rate: float) -> dict[str, list[tuple]]:
    """Three phase-aligned bands and the dry path that matches their sum."""
    ap = lambda f: [biquad("allpass", f, BUTTERWORTH, 0, rate)]
    return {"low": lr4("lowpass", low, rate) + ap(high), "mid": lr4("highpass", low, rate) + lr4("lowpass", high, rate), "high": lr4("highpass", low, rate) + lr4("highpass", high, rate), "dry": ap(low) + ap(high)}


def polyphase(factor: int, taps: int, beta: float = 8.6) -> np.ndarray:
    """factor x taps windowed-sinc bank; each phase sums to one."""
    n = factor * taps
    t = (np.arange(n) - (n - 1) / 2) / factor
    x = np.sinc(t) * np.kaiser(n, beta)
    bank = x.reshape(taps, factor).T
    return bank / bank.sum(1, keepdims=True)


def uniform(seed: int, start: int, n: int) -> np.ndarray:
    """Numbers start..start+n of a 32-bit additive-state generator, by random access."""
    with np.errstate(over="ignore"):
        a = np.uint32(seed & 0xFFFFFFFF) + (np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)).astype(np.uint32)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
        return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0


def gaussian(seed: int, n: int) -> np.ndarray:
    u = uniform(seed, 0, 2 * n).reshape(n, 2)
    return np.sqrt(-2 * np.log(np.maximum(u[:, 0], 2.0**-33))) * np.cos(2 * np.pi * u[:, 1])


def derived_seed(seed: int, tag: str) -> int:
    """FNV-1a of a tag over the seed."""
    h = 0x811C9DC5 ^ (seed & 0xFFFFFFFF)
    for c in tag:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return h


def saturation_curve(amount: float, points: int = 2048, headroom: float = 2.0) -> np.ndarray:
    """Asymmetric tanh shaper without DC, of unit slope at zero; the identity for no amount."""
    u = np.linspace(-1, 1, points) * headroom
    if amount <= 0:
        return u.astype(np.float32)
    drive, blend = 1 + amount * 0.8, 1 - (1 - amount) ** 2
    bent = np.where(np.abs(u) > 1, u, u + amount * 0.04 * (u * u - u**4))
    y = (1 - blend) * u + blend * np.tanh(drive * bent)
    return ((y - y.mean()) / (1 - blend + blend * drive)).astype(np.float32)
