"""The render plan: a list of stages compiled to one Arrow group for each clip."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from tidemark.functions import design as d
from tidemark.operators import clips
from tidemark.operators import stages as st
from tidemark.operators import kernels as k


@dataclass
class Job:
    target: float | None = -14.0
    ceiling: float = -1.0
    drive: float = 0.0
    #: Peaking filters as (Hz, dB), shelf tilt in dB, side gain, and saturation from 0 to 1.
    eq: list[tuple[float, float]] = field(default_factory=list)
    tilt: float = 0.0
    width: float = 1.0
    bass_mono: float = 0.0
    saturation: float = 0.0
    #: Compressor amounts of three bands, their mix, ballistics and solo.
    bands: tuple[float, float, float] = (0.0, 0.0, 0.0)
    mix: float = 100.0
    speed: str = "med"
    solo: str = "none"
    #: Side width by band, all-pass blend, Haas delay (ms) and side, crossfeed.
    side_bands: tuple[float, float, float] = (1.0, 1.0, 1.0)
    phase_blend: float = 0.0
    haas: float = 0.0
    haas_side: int = 1
    crossfeed: float = 0.0
    tape: float = 0.0
    hiss: float = 0.0
    vinyl: float = 0.0
    depth: float = 0.0
    depth_size: str = "med"
    depth_mode: str = "classic"
    attack: float = 0.0
    sustain: float = 0.0
    rate: int | None = None
    bits: int = 24
    dither: str = "tpdf"
    seed: int = 0x5164A17


def stages(job: Job, rate: int) -> list[tuple[str, object]]:
    """Named functions of (channels, frames); neutral stages aren't there."""
    out: list[tuple[str, object]] = []
    if job.drive:
        out.append(("drive", lambda x: x * 10 ** (job.drive / 20)))
    cascade = [d.biquad("peaking", f, 1.0, g, rate) for f, g in job.eq if g]
    if job.tilt:
        cascade += [d.biquad("lowshelf", 650, d.BUTTERWORTH, -job.tilt / 2, rate), d.biquad("highshelf", 650, d.BUTTERWORTH, job.tilt / 2, rate)]
    if cascade:
        out.append(("tone", lambda x: np.stack([k.filtered(c, cascade) for c in x])))
    if any(job.bands) or job.solo != "none":
        out.append(("multiband", lambda x: st.multiband(x, rate, *job.bands, job.mix, job.speed, job.solo)))
    if job.width != 1 or job.bass_mono:

        def stereo(x):
            if len(x) != 2:
                return x
            m, s = (x[0] + x[1]) / 2, (x[0] - x[1]) / 2 * job.width
            if job.bass_mono:
                s = k.filtered(s, d.lr4("highpass", job.bass_mono, rate))
            return np.stack([m + s, m - s])

        out.append(("stereo", stereo))
    if job.side_bands != (1.0, 1.0, 1.0) or job.phase_blend:
        out.append(("side bands", lambda x: st.side_bands(x, rate, *job.side_bands, job.phase_blend)))
    if job.haas > 0:
        out.append(("haas", lambda x: st.haas(x, rate, job.haas, job.haas_side)))
    if job.crossfeed > 0:
        out.append(("crossfeed", lambda x: st.crossfeed(x, rate, job.crossfeed)))
    if job.tape > 0:
        out.append(("tape", lambda x: st.tape(x, rate, job.tape)))
    if job.hiss > 0 or job.vinyl > 0:
        out.append(("beds", lambda x: x + st.beds(x.shape[1], rate, job.hiss, job.vinyl, job.seed)))
    if job.depth > 0:
        out.append(("depth", lambda x: st.depth(x, rate, job.depth, job.depth_size, job.depth_mode)))
    if job.saturation > 0:
        out.append(("saturation", lambda x: st.saturate(x, rate, job.saturation)))
    if job.attack or job.sustain:
        out.append(("transients", lambda x: k.shape_transients(x, rate, job.attack, job.sustain)))
    return out


def apply(job: Job, x: np.ndarray, rate: int) -> tuple[np.ndarray, int, dict]:
    """Rendered channels, their rate, and the report."""
    before = k.loudness(x, rate)
    own = stages(job, rate)
    for _, fn in own:
        x = np.asarray(fn(x), np.float32)
    if job.rate and job.rate != rate:
        x, rate = k.resample(x, rate, job.rate), job.rate
    if job.target is not None:
        x, norm = k.normalise(x, rate, job.target, job.ceiling)
    else:
        x, st = k.limit(x, rate, job.ceiling)
        norm = {"gain_db": 0.0, "passes": 1, "reason": "off", **st}
    x = k.dither(x, job.dither, job.bits, job.seed)
    after = k.loudness(x, rate)
    return x, rate, {"stages": [n for n, _ in own], "before": before["integrated"], "after": after["integrated"], **norm}


REPORT = "clip_id string, sample_rate int, stages array<string>, loudness_before double, loudness_after double, gain_db double, passes int, reason string, peak_gr_db double, true_peak_db double, ceiling_respected boolean"


def render(chunks: DataFrame, job: Job) -> DataFrame:
    """A report row for each clip; all clips render in parallel."""

    def run(clip, x, rate):
        _, rate, rep = apply(job, x, rate)
        fin = lambda v: float(v) if np.isfinite(v) else None
        return [{"clip_id": clip, "sample_rate": rate, "stages": rep["stages"], "loudness_before": fin(rep["before"]), "loudness_after": fin(rep["after"]), "gain_db": rep["gain_db"], "passes": rep["passes"], "reason": rep["reason"], "peak_gr_db": rep["peak_gr_db"], "true_peak_db": rep["true_peak_db"], "ceiling_respected": rep["ceiling_respected"]}]

    return clips.each_clip(chunks, run, REPORT)


def rendered(chunks: DataFrame, job: Job) -> DataFrame:
    """Chunk rows, with sample_rate, of the rendered clips."""

    def run(clip, x, rate):
        y, out, _ = apply(job, x, rate)
        return [row | {"sample_rate": out} for row in clips.chunked(clip, y)]

    return clips.each_clip(chunks, run, clips.CHUNKS + ", sample_rate int")
