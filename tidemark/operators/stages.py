"""Chain stages on a clip's samples: multiband dynamics, stereo placement, depth, character."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions import design as d
from tidemark.operators.kernels import _stage, filtered, follow

#: Attack and release (ms) of band compressors; crossover frequencies in Hz.
SPEEDS = {"fast": (6, 120), "med": (15, 300), "slow": (30, 450)}
LOW_HZ, HIGH_HZ = 140.0, 3200.0
#: Tap times in seconds of classic and clean depth by size, and the clean taps' levels.
CLASSIC = {"small": (0.011, 0.019), "med": (0.017, 0.029), "large": (0.027, 0.047)}
CLEAN = {"small": (0.0097, 0.0129, 0.0173, 0.0221), "med": (0.0137, 0.0181, 0.0247, 0.0319), "large": (0.0193, 0.0263, 0.0367, 0.0481)}
CLEAN_LEVELS = (0.06, 0.055, 0.045, 0.04)


def delayed(x: np.ndarray, seconds: float, rate: int) -> np.ndarray:
    n = int(seconds * rate + 0.5)
    return np.concatenate([np.zeros(n, x.dtype), x])[: len(x)] if n else x


def knee_sharpness(threshold: float, ratio: float, knee: float) -> float:
    """The k of the exponential knee whose slope at the knee's end is the ratio's, found by halving as browsers do."""
    low, end = 10 ** (threshold / 20), 10 ** ((threshold + knee) / 20)
    bent = lambda x, k: x if x < low else low + (1 - math.exp(-k * (x - low))) / k
    lo, hi, k = 0.1, 10_000.0, 5.0
    for _ in range(15):
        a, b = (20 * math.log10(bent(x, k)) for x in (end, end * 1.001))
        if (b - a) / (20 * math.log10(1.001)) < 1 / ratio:
            hi = k
        else:
            lo = k
        k = math.sqrt(lo * hi)
    return k


def curve_db(level_db: np.ndarray, threshold: float, ratio: float, knee: float) -> np.ndarray:
    """Gain in dB of a compressor whose knee is exponential in amplitude, and a straight line in dB above it."""
    if ratio <= 1:
        return np.zeros_like(level_db)
    k, low = knee_sharpness(threshold, ratio, knee), 10 ** (threshold / 20)
    bent = lambda x: low + (1 - np.exp(-k * (x - low))) / k
    at_end = 20 * math.log10(bent(10 ** ((threshold + knee) / 20)))
    x = 10 ** (np.minimum(level_db, threshold + knee) / 20)
    inside = 20 * np.log10(np.maximum(bent(x), 1e-12))
    out = np.where(level_db < threshold + knee, inside, at_end + (level_db - threshold - knee) / ratio)
    return np.where(level_db <= threshold, 0.0, out - level_db)


def saturate(x: np.ndarray, rate: int, amount: float) -> np.ndarray:
    """Shaper between a 5 Hz high-pass and a 22 kHz low-pass, run at four times the rate so that it doesn't fold."""
    if amount <= 0:
        return x
    curve = d.saturation_curve(amount)
    grid = np.linspace(-2, 2, len(curve))
    bank = d.polyphase(4, 48)
    taps = bank.shape[1]
    kernel = bank.T.ravel() / 4  # the same filter takes the images off before every fourth sample is kept
    out = []
    for c in x:
        c = filtered(c, [d.biquad("highpass", 5, d.BUTTERWORTH, 0, rate)]).astype(np.float64)
        pad = np.concatenate([np.zeros(taps // 2 - 1), c, np.zeros(taps // 2)])
        up = np.stack([np.convolve(pad, phase[::-1], "valid") for phase in bank[::-1]], 1).ravel()  # later phases of the bank stand earlier
        bent = np.interp(up, grid, curve)
        centre = len(kernel) // 2  # together with the bank's half step no delay
        down = np.convolve(np.concatenate([np.zeros(centre), bent, np.zeros(len(kernel) - 1 - centre)]), kernel, "valid")[::4]
        out.append(filtered(down[: len(c)], [d.biquad("lowpass", min(22_000, rate * 0.49), d.BUTTERWORTH, 0, rate)]))
    return np.stack(out)


def compressed(bands: np.ndarray, rate: int, amount: float, speed: str) -> np.ndarray:
    """One band of all channels, linked; no amount, no change."""
    if amount <= 0:
        return bands
    attack, release = (1 - math.exp(-1 / (ms / 1000 * rate)) for ms in SPEEDS[speed])
    out, _ = follow(np.abs(bands).max(0), attack, release, np.zeros(1))
    gain = curve_db(20 * np.log10(np.maximum(out[0], 1e-9)), -0.24 * amount, 1 + 0.02 * amount, 12.0)
    return bands * 10 ** (gain / 20)


def multiband(x: np.ndarray, rate: int, low: float, mid: float, high: float, mix: float = 100, speed: str = "med", solo: str = "none") -> np.ndarray:
    """Three phase-aligned bands compressed each by its amount, and mixed with an aligned dry path."""
    tree = d.crossover(LOW_HZ, HIGH_HZ, rate)
    split = lambda k: np.stack([filtered(c, tree[k]) for c in x]).astype(np.float64)
    amounts = {"low": low, "mid": mid, "high": high}
    wet = sum(compressed(split(k), rate, a, speed) for k, a in amounts.items() if solo in ("none", k))
    if solo != "none" or mix >= 100:
        return wet.astype(np.float32)
    return (wet * mix / 100 + split("dry") * (1 - mix / 100)).astype(np.float32)


def haas(x: np.ndarray, rate: int, ms: float, side: int = 1) -> np.ndarray:
    """One channel late: the right for a positive side."""
    if ms <= 0 or len(x) != 2:
        return x
    late = delayed(x[1 if side >= 0 else 0], ms / 1000, rate)
    return np.stack([x[0], late] if side >= 0 else [late, x[1]])


def crossfeed(x: np.ndarray, rate: int, amount: float) -> np.ndarray:
    """Each ear hears the other side 0.3 ms late, between 120 and 700 Hz."""
    if amount <= 0 or len(x) != 2:
        return x
    v = min(1.0, amount)
    t = max(0.0, (v - 0.55) / 0.45)
    g = 0.45 * v if v <= 0.55 else 0.2475 + 0.0825 * t * t * (3 - 2 * t)
    shape = [d.biquad("highpass", 120, d.BUTTERWORTH, 0, rate)] * 2 + [d.biquad("lowpass", 700, d.BUTTERWORTH, 0, rate)]
    other = [filtered(delayed(c, 0.0003, rate), shape) * g for c in x]
    return np.stack([x[0] + other[1], x[1] + other[0]])


def side_bands(x: np.ndarray, rate: int, low: float, mid: float, high: float, comb: float = 0.0) -> np.ndarray:
    """Width of the side signal in three bands, and its blend with an all-pass copy."""
    if len(x) != 2 or (low == mid == high == 1 and not comb):
        return x
    m, s = (x[0] + x[1]) / 2, (x[0] - x[1]) / 2
    if comb:
        s = s * (1 - comb / 2) + filtered(s, [d.biquad("allpass", 800, 0.5, 0, rate)]) * comb / 2
    tree = d.crossover(LOW_HZ, HIGH_HZ, rate)
    caps = {"low": min(low, 1.5), "mid": min(mid, 2.2), "high": min(high, 2.2)}
    s = sum(filtered(s, tree[k]) * g for k, g in caps.items())
    m = filtered(m, tree["dry"])
    return np.stack([m + s, m - s])


def depth(x: np.ndarray, rate: int, amount: float, size: str = "med", mode: str = "classic") -> np.ndarray:
    """Early reflections: two cross-fed taps, or four diffused ones that alternate between the ears."""
    a = min(100.0, max(0.0, amount)) / 100
    if not a or len(x) != 2:
        return x
    out = x.astype(np.float64)
    if mode == "clean":
        shape = [d.biquad("highpass", 220, d.BUTTERWORTH, 0, rate), d.biquad("lowpass", 6400, d.BUTTERWORTH, 0, rate), d.biquad("allpass", 900, 0.7, 0, rate), d.biquad("allpass", 2300, 0.7, 0, rate)]
        wet = [filtered(c, shape) for c in x]
        for i, (t, g) in enumerate(zip(CLEAN[size], CLEAN_LEVELS, strict=True)):
            out[i % 2] += delayed(wet[i % 2], t, rate) * g * a
        return out
    for i, (t, g, top) in enumerate(zip(CLASSIC[size], (0.28, 0.22), (4200, 3400), strict=True)):
        wet = filtered(delayed(x[i], t, rate), [d.biquad("highpass", 180, d.BUTTERWORTH, 0, rate), d.biquad("lowpass", top, d.BUTTERWORTH, 0, rate)])
        out[1 - i] += wet * g * a
    return out


def tape(x: np.ndarray, rate: int, amount: float) -> np.ndarray:
    """Wow, flutter and drift as a moving delay, a bump at 60 Hz and a softer top."""
    a = min(100.0, max(0.0, amount)) / 100
    if not a:
        return x
    t = np.arange(x.shape[1]) / rate
    sway = lambda hz, by: by * a * np.sin(2 * np.pi * hz * t)
    at = np.arange(x.shape[1]) - (0.006 + sway(0.4, 0.0012) + sway(6.7, 0.00018) + sway(0.13, 0.0006)) * rate
    tone = [d.biquad("peaking", 60, 0.9, 2 * a, rate), d.biquad("lowpass", min(22_000 - 9000 * a, rate * 0.49), d.BUTTERWORTH, 0, rate)]
    return np.stack([filtered(np.interp(at, np.arange(len(c)), c, left=0.0), tone) for c in x])


def beds(n: int, rate: int, hiss: float, vinyl: float, seed: int) -> np.ndarray:
    """Seeded noise of a medium: hiss over 2.5 kHz, sparse crackle, and a leaky rumble; loops of 12 seconds."""
    loop = min(n, 12 * rate)
    out = np.zeros(loop)
    if hiss > 0:
        out += filtered(d.gaussian(d.derived_seed(seed, "hiss"), loop) * 0.25, [d.biquad("highpass", 2500, d.BUTTERWORTH, 0, rate)]) * hiss / 100 * 0.01
    if vinyl > 0:
        u = d.uniform(d.derived_seed(seed, "crackle"), 0, 2 * loop).reshape(-1, 2)
        clicks = np.where(u[:, 0] < 6 / rate, u[:, 1] * 2 - 1, 0.0)
        out += filtered(clicks, [d.biquad("bandpass", 3200, 0.8, 0, rate)]) * vinyl / 100 * 0.1
        rumble = _stage(d.uniform(d.derived_seed(seed, "rumble"), 0, loop) * 2 - 1, (0.02, 0.0, 0.0, -0.98, 0.0))
        out += filtered(rumble, [d.biquad("lowpass", 45, d.BUTTERWORTH, 0, rate), d.biquad("highpass", 15, d.BUTTERWORTH, 0, rate)]) * vinyl / 100 * 0.02
    return np.resize(out, n)
