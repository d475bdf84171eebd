import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.functions import design
from tidemark.operators import kernels as k
from tidemark.operators import stages
from tidemark.operators.scans import Cascade, Follower, linked_peak, over_chunks


def loop(v, attack, release, level=0.0):
    out = []
    for x in v:
        level += (x - level) * (attack if x > level else release)
        out.append(level)
    return np.array(out)


def naive(x, cascade):
    for c in cascade:
        x = k.naive_stage(x, c)
    return x


def cut(x, ends):
    return [x[a:b] for a, b in zip([0, *ends], [*ends, len(x)])]


CASCADE = design.k_weighting(48_000) + [design.biquad("peaking", 500, 1.0, 6, 48_000)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=8), st.integers(0, 10**6))
def test_effects_say_what_running_does(ends, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(900)
    for r, v, want in ((Cascade(CASCADE), x, naive(x, CASCADE)), (Follower(0.3, 0.01), np.abs(x), loop(np.abs(x), 0.3, 0.01))):
        state, out, effects = r.start, [], []
        for part in cut(v, sorted(ends)):
            effects.append(r.effect(part))
            y, after = r.run(part, state)
            assert np.allclose(r.after(effects[-1], state), after, atol=1e-10)
            state = after
            out.append(y)
        assert np.allclose(np.concatenate(out), want, atol=1e-9)
        whole = effects[0]
        for e in effects[1:]:
            whole = r.both(whole, e)
        assert np.allclose(r.after(whole, r.start), state, atol=1e-10)


@pytest.mark.parametrize("attack,release", [(0.3, 0.3), (0.9, 0.001), (1.0, 0.5), (0.003, 0.0001)])
def test_follow_is_the_loop(attack, release):
    rng = np.random.default_rng(2)
    for v in (np.abs(rng.standard_normal(5000)), np.zeros(300), np.r_[np.zeros(700), np.ones(10), np.zeros(900)], np.abs(np.sin(np.arange(4000) / 7))):
        for start in (0.0, 0.5, 7.0):
            out, rises = k.follow(v, attack, release, np.array([start, 2 * start]))
            want = loop(v, attack, release, start)
            assert np.allclose(out[0], want, rtol=1e-12, atol=1e-15)
            assert np.allclose(out[1], loop(v, attack, release, 2 * start), rtol=1e-12, atol=1e-15)
            assert abs(rises[0] - (v > np.r_[start, want[:-1]]).sum()) <= 3  # equal but for rounding


def test_follow_is_fast():
    v = np.abs(np.random.default_rng(1).standard_normal(3_000_000)) * np.abs(np.sin(np.arange(3_000_000) / 90_000))
    attack, release = (1 - np.exp(-1 / (ms / 1000 * 48_000)) for ms in stages.SPEEDS["med"])
    began = time.perf_counter()
    out, _ = k.follow(v, attack, release, np.zeros(1))
    fast = time.perf_counter() - began
    began = time.perf_counter()
    level, want = 0.0, np.empty(len(v))
    for i, x in enumerate(v.tolist()):
        level += (x - level) * (attack if x > level else release)
        want[i] = level
    slow = time.perf_counter() - began
    print(f"{slow / fast:.1f} times as fast")
    assert np.allclose(out[0], want, rtol=1e-11) and slow > 2 * fast


def chunk_rows(x, ends, clip="a"):
    out = []
    for ch, row in enumerate(x):
        at = 0
        for i, part in enumerate(cut(row, ends)):
            out.append((clip, ch, i, at, len(part), [float(v) for v in part]))
            at += len(part)
    return out


def test_any_cut_gives_the_same(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2, 20_000)).astype(np.float32)
    schema = "clip_id string, channel int, chunk_idx long, start_frame long, frame_count int, samples array<float>"
    want = np.stack([naive(c.astype(float), CASCADE) for c in x])
    many = sorted(rng.choice(20_000, 999, replace=False).tolist())
    for ends, stretch in (([], 1024), (many, 1024), (many, 7), ([0, 0, 10_000, 20_000], 2)):
        df = spark.createDataFrame(chunk_rows(x, ends) + chunk_rows(x[:1, :50] * 2, [20], "b"), schema)
        out = over_chunks(df, Cascade(CASCADE), stretch=stretch)
        assert out.columns == df.columns
        got = {}
        for r in sorted(out.collect(), key=lambda r: (r.clip_id, r.channel, r.chunk_idx)):
            got.setdefault((r.clip_id, r.channel), []).extend(r.samples)
        assert np.allclose(np.array([got["a", 0], got["a", 1]]), want, atol=1e-9)
        assert np.allclose(got["b", 0], naive(x[0, :50].astype(float) * 2, CASCADE), atol=1e-9)


def test_linked_compression_over_chunks(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((2, 9000)) * np.abs(np.sin(np.arange(9000) / 700))).astype(np.float32)
    schema = "clip_id string, channel int, chunk_idx long, start_frame long, frame_count int, samples array<float>"
    df = spark.createDataFrame(chunk_rows(x, [100, 3000, 3001, 8000]), schema)
    out = over_chunks(linked_peak(df), Follower(0.01, 0.0005), ("clip_id",), stretch=2)
    got = np.concatenate([r.samples for r in sorted(out.collect(), key=lambda r: r.chunk_idx)])
    assert np.allclose(got, loop(np.abs(x.astype(float)).max(0), 0.01, 0.0005), atol=1e-12)


def test_empty_and_null_chunks(spark):
    schema = "clip_id string, channel int, chunk_idx long, samples array<double>"
    df = spark.createDataFrame([("a", 0, 0, [1.0]), ("a", 0, 1, None), ("a", 0, 2, []), ("a", 0, 3, [0.0, 0.0]), (None, 0, 0, [1.0])], schema)
    out = {(r.clip_id, r.chunk_idx): r.samples for r in over_chunks(df, Follower(0.5, 0.25)).collect()}
    assert out == {("a", 0): [0.5], ("a", 1): None, ("a", 2): [], ("a", 3): [0.375, 0.28125]}
    assert over_chunks(df.limit(0), Cascade(CASCADE)).collect() == []
