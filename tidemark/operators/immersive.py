"""Speaker feeds of a stereo programme, and identification of channels."""

from __future__ import annotations

import numpy as np

from tidemark.functions import design as d
from tidemark.operators.kernels import filtered

#: Delay (ms), all-pass (Hz) and gain of decorrelated feeds; left of the colon the speaker.
SURROUND = {"Ls": (9, 900, 1.0), "Rs": (12, 1100, 1.0), "Lss": (9, 900, 1.0), "Rss": (12, 1100, 1.0), "Lrs": (20, 700, 0.85), "Rrs": (23, 800, 0.85)}
HEIGHT = {"Ltf": (8, 1500), "Rtf": (10, 1700), "Ltm": (12, 1600), "Rtm": (14, 1750), "Ltr": (16, 1300), "Rtr": (18, 1450)}
WIDE = {"Lw": (6, 1200), "Rw": (7, 1400)}


def decorrelated(x: np.ndarray, rate: int, ms: float, hz: float) -> np.ndarray:
    n = int(ms / 1000 * rate + 0.5)
    late = np.concatenate([np.zeros(n), x])[: len(x)]
    return filtered(late, [d.biquad("allpass", hz, d.BUTTERWORTH, 0, rate)])


def feeds(x: np.ndarray, rate: int, channels: list[str], centre: float = 0.5, surround: float = 0.7, height: float = 0.5, front_rear: float = 0.5, lfe_hz: float = 120) -> dict[str, np.ndarray]:
    """A feed for each speaker of a layout, by a linear mix of left, right, mid and side."""
    left, right = x[0].astype(np.float64), x[-1].astype(np.float64)
    mid, side = (left + right) / 2, (left - right) / 2
    front, rear = 1 - 0.6 * max(0.0, front_rear - 0.5), 1 - 0.6 * max(0.0, 0.5 - front_rear)
    out = {}
    for sp in channels:
        own, sign = (left, 1) if sp.startswith("L") else (right, -1)
        if sp == "LFE":
            out[sp] = filtered(mid, d.lr4("lowpass", lfe_hz, rate))
        elif sp == "C":
            out[sp] = mid * centre
        elif sp in ("L", "R"):
            out[sp] = front * own - 0.3 * centre * mid
        elif sp in WIDE:
            out[sp] = 0.75 * front * own + sign * decorrelated(side, rate, *WIDE[sp]) * 0.5
        elif sp in SURROUND:
            ms, hz, g = SURROUND[sp]
            out[sp] = rear * surround * g * (decorrelated(side, rate, ms, hz) + 0.25 * own)
        elif sp in HEIGHT:
            ms, hz = HEIGHT[sp]
            late = filtered(decorrelated(side, rate, ms, hz), [d.biquad("highpass", 700, d.BUTTERWORTH, 0, rate), d.biquad("allpass", 1.7 * hz, d.BUTTERWORTH, 0, rate)])
            out[sp] = rear * height * late
        else:
            out[sp] = mid * 0
    return {k: np.asarray(v, np.float32) for k, v in out.items()}


def goertzel(x: np.ndarray, hz: float, rate: int) -> float:
    """Amplitude of one frequency, as a product with its sine and cosine."""
    if not len(x):
        return 0.0
    return float(np.abs((x * np.exp(-2j * np.pi * hz * np.arange(len(x)) / rate)).sum()) / (len(x) / 2))


def beeps(x: np.ndarray, rate: int, amp: float = 0.25, gap_ms: float = 120, beep_ms: float = 120) -> int:
    """Bursts no longer than one and a half beeps, parted by half a gap of quiet or more."""
    at = np.flatnonzero(np.abs(x) > amp * 0.35)
    if not len(at):
        return 0
    cut = np.flatnonzero(np.diff(at) > gap_ms / 1000 * rate * 0.5)
    first, last = np.r_[at[0], at[cut + 1]], np.r_[at[cut], at[-1]]
    return int((last - first + 1 <= beep_ms / 1000 * rate * 1.5).sum())


def identify(x: np.ndarray, rate: int, base: float = 220.0) -> list[tuple[int, int, float, int]]:
    """channel, detected tone (from 1), its lead over the runner-up, and beeps, for each channel."""
    out = []
    for c, row in enumerate(x):
        mags = np.array([goertzel(row, base * 2 ** (k / 12), rate) for k in range(len(x))])
        order = np.argsort(-mags, kind="stable")
        second = mags[order[1]] if len(mags) > 1 else 0.0
        out.append((c + 1, int(order[0]) + 1, float(mags[order[0]] / second) if second > 0 else float("inf"), beeps(row, rate)))
    return out
