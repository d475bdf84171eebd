"""Kernels against sample-by-sample versions, known answers and properties."""

import numpy as np
import pytest

from tidemark.functions import design as d
from tidemark.operators import immersive, kernels as k, stages as st
from tidemark.plans import render
from tidemark.sources import signals as sg

SR = 48_000


def stereo(x):
    return np.stack([x, x]).astype(np.float32)


def test_biquad_blocks_equal_the_plain_recursion():
    x = sg.white(0.1)
    for c in [*d.k_weighting(SR), d.biquad("peaking", 900, 1.2, 5, SR), d.biquad("lowshelf", 200, 0.7, -4, SR)]:
        assert np.abs(k._stage(x, c) - k.naive_stage(x, c)).max() < 1e-9


def test_k_weighting_against_the_published_table():
    shelf, high = d.k_weighting(SR)
    assert np.allclose(shelf, (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585), atol=1e-9)
    assert np.allclose(high, (1, -2, 1, -1.99004745483398, 0.99007225036621), atol=1e-9)


@pytest.mark.parametrize("db", [-23.0, -33.0])
def test_loudness_of_a_sine(db):
    x = sg.sine(1000, 5, 10 ** (db / 20))
    assert abs(k.loudness(stereo(x), SR)["integrated"] - db) < 0.1
    assert abs(k.loudness(x[None].astype(np.float32), SR)["integrated"] - (db - 3.01)) < 0.1


def test_gates_and_range():
    quiet, loud = sg.sine(1000, 10, 10 ** (-36 / 20)), sg.sine(1000, 20, 10 ** (-23 / 20))
    assert abs(k.loudness(stereo(np.concatenate([quiet, loud, quiet])), SR)["integrated"] + 23) < 0.2
    pair = np.concatenate([sg.sine(1000, 20, 10 ** (-20 / 20)), sg.sine(1000, 20, 10 ** (-30 / 20))])
    assert abs(k.loudness(stereo(pair), SR)["lra"] - 10) < 1
    assert k.loudness(np.zeros((2, SR), np.float32), SR)["silent"] and k.loudness(np.zeros((2, 100), np.float32), SR)["too_short"]


def test_true_peak_between_samples():
    x = np.sin(2 * np.pi * np.arange(4800) / 4 + np.pi / 4)
    assert abs(k.to_db(float(np.abs(x).max())) + 3.01) < 0.01
    assert k.to_db(k.true_peak(x, SR)) > -0.25 and abs(k.to_db(k.true_peak_verified(x[:4096], SR))) < 0.6


@pytest.mark.parametrize("ceiling", [-0.1, -1.0, -2.0])
def test_limiter_holds_its_ceiling(ceiling):
    x = stereo(sg.bursts(1)) * np.array([[1], [0.5]], np.float32)
    y, st = k.limit(x, SR, ceiling)
    assert st["ceiling_respected"] and st["peak_gr_db"] < -1
    live = np.abs(x[0]) > 1e-3
    assert np.allclose(y[1][live] / y[0][live], 0.5, atol=1e-5)  # one gain for all channels
    g = k.limiter_gain(x, SR, ceiling)
    assert (g <= k.required_gain(k.envelope(x, SR), 10 ** ((ceiling - 0.3) / 20)) + 1e-9).all() and np.abs(np.diff(g)).max() < 0.05


def test_centred_minimum():
    x = np.random.default_rng(1).random(500)
    for h in (1, 4, 13):
        assert np.array_equal(k.centred_minimum(x, h), [x[max(0, i - h) : i + h + 1].min() for i in range(500)])


def test_normalise_reaches_its_target():
    y, stats = k.normalise(stereo(sg.pink(4)), SR, -18.0, -1.0)
    assert abs(k.loudness(y, SR)["integrated"] + 18) < 0.25 and stats["ceiling_respected"]


def test_resample_keeps_a_sine():
    x = stereo(sg.sine(1000, 0.5, 0.5))
    y = k.resample(x, SR, 44_100)
    assert y.shape[1] == 22_050
    assert np.abs(y[0, 500:-500] - 0.5 * np.sin(2 * np.pi * 1000 * np.arange(22_050) / 44_100)[500:-500]).max() < 2e-3
    with pytest.raises(ValueError):
        k.resample(x, SR, 400_000)


def test_dither_is_deterministic_and_small():
    x = stereo(sg.sine(1000, 0.2))
    a, b = k.dither(x, "tpdf", 16, 5), k.dither(x, "tpdf", 16, 5)
    assert np.array_equal(a, b) and not np.array_equal(a[0], a[1]) and np.abs(a - x).max() <= 2**-15 + 1e-7
    assert k.dither(x, "shaped", 24, 1).shape == x.shape and k.dither(x, "tpdf", 32, 1) is x


def test_random_numbers_by_access_equal_the_sequence():
    state, want = 7, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        want.append((t ^ t >> 14) / 4294967296)
    assert d.uniform(7, 0, 50).tolist() == want and d.uniform(7, 20, 5).tolist() == want[20:25]


def test_crossover_sums_flat():
    f = np.geomspace(20, 20_000, 300)
    b = d.crossover(140, 3200, SR)
    total = sum(d.response(b[x], f, SR) for x in ("low", "mid", "high"))
    assert np.abs(20 * np.log10(np.abs(total))).max() < 0.1


def test_fingerprint_mono_and_brightness():
    x = stereo(sg.sine(1000, 4))
    f = k.fingerprint(x, SR)
    assert int(np.argmax(f["bands_db"])) == 3 and abs(sum(f["bands_db"])) < 1e-6
    assert k.fingerprint(np.zeros((2, SR), np.float32), SR) is None
    p = sg.pink(2)
    assert all(b["mono_loss_db"] < -60 for b in k.mono_bands(p, -p, SR)) and all(abs(b["correlation"] - 1) < 1e-6 for b in k.mono_bands(p, p, SR))
    assert k.brightness(stereo(sg.sine(12_000, 1)), SR) > -3 > -30 > k.brightness(x, SR)


def test_identification():
    x = sg.identification(4)
    got = immersive.identify(x[[2, 0, 3, 1]], SR)
    assert [g[1] for g in got] == [3, 1, 4, 2] and [g[3] for g in got] == [3, 1, 4, 2]


def test_render_leaves_out_neutral_stages():
    assert render.stages(render.Job(), SR) == []
    assert [n for n, _ in render.stages(render.Job(drive=1, eq=[(100, 2)], width=1.2, saturation=0.3, attack=10), SR)] == ["drive", "tone", "stereo", "saturation", "transients"]
    c = d.saturation_curve(0.5)
    assert abs(c.mean()) < 1e-6 and np.all(np.diff(c) > 0)


def test_stages_are_neutral_when_off_and_do_what_they_say():
    x = np.stack([sg.pink(1), sg.pink(1, seed=9)]).astype(np.float32)
    assert st.haas(x, SR, 0) is x and st.depth(x, SR, 0) is x and st.tape(x, SR, 0) is x and st.crossfeed(x, SR, 0) is x and st.side_bands(x, SR, 1, 1, 1) is x
    flat = st.multiband(x, SR, 0, 0, 0)
    dry = np.stack([k.filtered(c, d.crossover(140, 3200, SR)["dry"]) for c in x])
    assert np.abs(flat - dry).max() < 1e-4
    loud = x * 4
    assert np.abs(st.multiband(loud, SR, 80, 80, 80)).max() < np.abs(loud).max()
    late = st.haas(x, SR, 10)
    assert np.array_equal(late[1, 480:], x[1, :-480]) and np.array_equal(late[0], x[0])
    mono = st.side_bands(x, SR, 0, 0, 0)
    assert np.abs(mono[0] - mono[1]).max() < 1e-6
    assert np.array_equal(st.beds(1000, SR, 50, 50, 3), st.beds(1000, SR, 50, 50, 3)) and np.abs(st.beds(SR, SR, 100, 100, 3)).max() < 0.2
    for y in (st.depth(x, SR, 60), st.depth(x, SR, 60, "large", "clean"), st.tape(x, SR, 50), st.crossfeed(x, SR, 0.8)):
        assert y.shape == x.shape and np.isfinite(y).all() and np.abs(y).max() < 2


def test_normalise_obeys_its_budget():
    y, got = k.normalise(stereo(sg.bursts(1)), SR, -6.0, -1.0)
    assert got["reason"] == "budget" and -got["avg_gr_db"] <= 2 and -got["peak_gr_db"] <= 6


def test_spectra_and_estimates():
    x = sg.sine(1000, 1) + sg.sine(3000, 1, 0.05)
    h = k.harmonics(x, SR, 1000)
    assert h[0] == 0 and abs(h[2] + 20) < 1 and h[1] < -60
    assert abs(k.spectral_summary(stereo(sg.sine(1000, 1)), SR)["centroid_hz"] - 1000) < 5 and k.spectral_summary(np.zeros((2, 10)), SR) is None
    y = np.sin(2 * np.pi * np.arange(4800) / 4 + np.pi / 4)
    assert -0.6 < k.to_db(k.true_peak_estimate(y, SR)) < 0.2 and k.true_peak_estimate(y, SR, 7) <= k.true_peak_estimate(y, SR) + 1e-12
    assert k.spatial_energy({"L": 1, "R": 1, "Ls": 1, "Ltf": 1, "LFE": 0})["front"] == 50


def test_saturation_keeps_quiet_signals_and_folds_little():
    n = np.arange(48_000)
    quiet = (0.01 * np.sin(2 * np.pi * 1000 * n / 48_000)).astype(np.float32)[None]
    y = st.saturate(quiet, 48_000, 0.5)
    assert y.shape == quiet.shape and abs(np.ptp(y[0, 20_000:]) / 0.02 - 1) < 0.02
    assert np.abs(y[0, 20_000:40_000] - y[0, 20_000:40_000].mean() - quiet[0, 20_000:40_000]).max() < 0.0005  # no delay
    assert abs(st.saturate(quiet + 0.2, 48_000, 0.5)[0, 40_000:].mean()) < 0.02  # direct current is blocked
    loud = (0.9 * np.sin(2 * np.pi * 10_000 * n / 48_000)).astype(np.float32)[None]
    spectrum = np.abs(np.fft.rfft(st.saturate(loud, 48_000, 0.8)[0] * np.hanning(48_000)))
    plain = np.abs(np.fft.rfft(np.interp(loud[0], np.linspace(-2, 2, 2048), d.saturation_curve(0.8)) * np.hanning(48_000)))
    folded = 48_000 - 3 * 10_000  # where the third harmonic lands without oversampling
    assert spectrum[folded - 5 : folded + 6].max() < 0.1 * plain[folded - 5 : folded + 6].max()
    assert st.saturate(quiet, 48_000, 0) is quiet


def test_exponential_knee():
    level = np.linspace(-60, 0, 601)
    gain = st.curve_db(level, -24, 4, 12)
    assert (gain[level <= -24] == 0).all() and (np.diff(gain) <= 1e-9).all()
    slope = np.diff(level + gain) / np.diff(level)
    assert abs(slope[-1] - 0.25) < 1e-6 and abs(slope[np.searchsorted(level, -12.2)] - 0.25) < 0.02
    assert (st.curve_db(level, -24, 1, 12) == 0).all()


def test_walk_back_trades_loudness_for_peaks():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((1, 96_000)) * 0.05).astype(np.float32)
    x[0, ::4800] = 0.9
    gain = 18.0
    y, stats = k.limit((x * 10 ** (gain / 20)).astype(np.float32), 48_000, -1.0)
    got = k.loudness(y, 48_000)["integrated"]
    back = k.walked_back(x, 48_000, got + 1.0, -1.0, gain, got, stats, lambda s: True)
    if back:
        lower, _, own, level = back
        assert lower in (16.5, 15.0) and own["peak_gr_db"] > stats["peak_gr_db"] and got - level < 0.4 * (own["peak_gr_db"] - stats["peak_gr_db"])
    assert k.walked_back(x, 48_000, got - 1.0, -1.0, gain, got, stats, lambda s: True) is None
    assert k.walked_back(x, 48_000, got + 1.0, -1.0, gain, got, stats, lambda s: False) is None
