import numpy as np
import pytest
from tidemark.operators import alignment

SCHEMA = "pair string, chunk_idx long, samples array<double>"


def rows(name, x, size):
    return [(name, i, [float(v) for v in x[i * size : (i + 1) * size]]) for i in range(-(-len(x) // size))]


def plain(a, b, reach):
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    wide = np.concatenate([np.zeros(reach), a, np.zeros(reach)])
    dots = [float(b @ wide[reach + k : reach + k + n]) for k in range(-reach, reach + 1)]
    k = int(np.argmax(np.abs(dots)))
    own = wide[k : k + n]
    gain = dots[k] / (own @ own)
    rest = b - gain * own
    return k - reach, gain, 10 * np.log10((rest @ rest) / (b @ b))


@pytest.mark.parametrize("size,reach", [(100, 512), (1024, 512), (4096, 30), (7, 20)])
def test_planted_lags(spark, size, reach):
    rng = np.random.default_rng(size)
    takes = {}
    for name, lag, gain, n in (("late", 17, 0.5, 3000), ("early", -20, -2.0, 3000), ("none", 0, 1.0, 1024), ("short", 5, 0.1, 900)):
        a = rng.standard_normal(n + 100)
        takes[name] = a, gain * np.roll(a, -lag)[:n] + 0.05 * rng.standard_normal(n)
    dfs = [spark.createDataFrame([r for k, ab in takes.items() for r in rows(k, ab[i], size)], SCHEMA) for i in (0, 1)]
    got = {r.pair: r for r in alignment.best_fit(alignment.lag_sums(*dfs, "pair", size, reach), "pair").collect()}
    for k, (a, b) in takes.items():
        lag, gain, residual = plain(a, b, reach)
        assert got[k].lag == lag and abs(got[k].gain - gain) < 1e-9 and abs(got[k].residual_db - residual) < 1e-6 and got[k].inverted == (gain < 0)
    assert got["late"].lag == 17 and got["early"].lag == -20
    ahead = {r.pair: r.lag for r in alignment.best_fit(alignment.lag_sums(*dfs, "pair", size, reach), "pair", 0).collect()}
    assert min(ahead.values()) >= 0 and ahead["late"] == 17


def test_gaps_silence_and_lone_takes(spark):
    a = spark.createDataFrame([("gap", 0, [1.0, 2.0]), ("lone", 0, [1.0]), ("quiet", 0, [0.0, 0.0]), ("null", 0, None)], SCHEMA)
    b = spark.createDataFrame([("gap", 0, [1.0, 2.0]), ("gap", 9, [5.0]), ("quiet", 0, [0.0, 0.0]), ("null", 0, [1.0])], SCHEMA)
    got = {r.pair: r for r in alignment.best_fit(alignment.lag_sums(a, b, "pair", 2, 1), "pair").collect()}
    assert set(got) == {"gap", "quiet"} and got["gap"].lag == 0 and abs(got["gap"].gain - 1) < 1e-12 and got["quiet"].gain == 0


@pytest.mark.parametrize("size", [16, 100])
def test_exact_fits_leave_nothing(spark, size):
    rng = np.random.default_rng(size)
    takes = {}
    for k in range(40):
        a, lag = rng.standard_normal(64 + k) / 10, k % 13 - 6
        line = np.concatenate([np.zeros(10), a, np.zeros(10)])
        takes[f"exact-{k}"] = a, (-0.8 if k % 3 == 0 else 0.8) * line[10 + lag :][: len(a)]
    a, b = rng.standard_normal(300), rng.standard_normal(300)
    takes["deep"] = a, a + 1e-8 * b  # -160 dB
    takes["loose"] = a, 0.5 * np.roll(a, -17) + 0.05 * b
    dfs = [spark.createDataFrame([r for k, ab in takes.items() for r in rows(k, ab[i], size)], SCHEMA) for i in (0, 1)]
    fit = alignment.best_fit(alignment.lag_sums(*dfs, "pair", size, 20), "pair")
    got = {r.pair: r for r in alignment.residuals(fit, *dfs, "pair", size).collect()}
    assert set(got) == set(takes)
    for k, (a, b) in takes.items():
        floor = 10 * np.log10(1e-20 / (b @ b + 1e-20))
        if k.startswith("exact"):
            assert abs(got[k].residual_db - floor) < 1e-3
        else:
            assert abs(got[k].residual_db - plain(a, b, 20)[2]) < 1e-2
    gap = [spark.createDataFrame(r, SCHEMA) for r in ([("gap", 0, [1.0, 2.0])], [("gap", 0, [1.0, 2.0]), ("gap", 9, [5.0])])]
    assert alignment.residuals(alignment.best_fit(alignment.lag_sums(*gap, "pair", 2, 1), "pair"), *gap, "pair", 2).first().residual_db < -190
    holes = [spark.createDataFrame(r, SCHEMA) for r in ([("h", 0, [1.0, 2.0]), ("h", 9, [0.0, 1.0])], [("h", 0, [1.0, 2.0]), ("h", 5, [5.0, 0.0]), ("h", 9, [0.0, 1.0])])]
    got = alignment.residuals(alignment.best_fit(alignment.lag_sums(*holes, "pair", 2, 1), "pair"), *holes, "pair", 2).first()
    assert got.lag == 0 and abs(got.residual_db - 10 * np.log10(25 / 31)) < 1e-9
