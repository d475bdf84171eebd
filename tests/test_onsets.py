import numpy as np
import pytest
from tidemark.operators import onsets


def plain(x, win, most=60):
    """The same in arrays."""
    power = np.convolve(x * x, np.ones(win) / win, "same")
    d = np.diff(power)
    at = np.flatnonzero(d > np.percentile(np.abs(d), 99))
    at = at[:: max(1, len(at) // most)][:most]
    out = []
    for o in at.tolist():
        if o + 2 * win <= len(x):
            a, b = power[o : o + win], power[o + win : o + 10 * win]
            out.append((o, 10 * np.log10((a.mean() + 1e-18) / (b.mean() + 1e-18)), np.abs(x[o : o + win]).max()))
    return out


@pytest.mark.parametrize("win,stretch", [(8, 1 << 16), (8, 100), (5, 37), (1, 64)])
def test_attacks_on_any_stretches(spark, win, stretch):
    rng = np.random.default_rng(win)
    series = {}
    for name, n in (("bursts", 3000), ("noise", 900), ("brief", 30)):
        x = 0.01 * rng.standard_normal(n)
        for o in range(50, n, 331):
            x[o : o + 60] += np.exp(-np.arange(60) / 20)[: len(x[o : o + 60])]
        series[name] = x
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, frame long, value double")
    got = {}
    for r in onsets.attacks(df, "name", win, stretch=stretch).orderBy("frame").collect():
        got.setdefault(r.name, []).append((r.frame, r.ratio_db, r.peak))
    for k, x in series.items():
        want = plain(x, win)
        assert [g[0] for g in got.get(k, [])] == [w[0] for w in want]
        assert np.allclose(got.get(k, []), want, atol=1e-7)
    assert len(got["bursts"]) > 5


def test_silence_and_no_rows(spark):
    df = spark.createDataFrame([("quiet", i, 0.0) for i in range(50)], "name string, frame long, value double")
    assert onsets.attacks(df, "name", 4).collect() == [] and onsets.summary(onsets.attacks(df.limit(0), "name", 4), "name").collect() == []
