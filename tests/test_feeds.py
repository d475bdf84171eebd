import numpy as np
from tidemark.functions import design as d
from tidemark.operators import dims, feeds
from tidemark.operators.kernels import naive_stage
from tidemark.operators.scene import BANDS

RATE, SIZE = 48_000, 256
#: frontM, centreM, frontS, sideS, rearS, heightS, lfeM, decorr of a scene's bands.
ROWS = {"sub": (1.0, 0.2, 0.0, 0.0, 0.0, 0.0, 0.7, 0.0), "low": (1.0, 0.5, 0.3, 0.0, 0.0, 0.0, 0.0, 0.2), "lowmid": (0.9, 0.6, 0.5, 0.4, 0.3, 0.2, 0.0, 0.5), "mid": (0.9, 0.8, 0.4, 0.5, 0.6, 0.2, 0.0, 0.7), "presence": (0.8, 0.3, 0.6, 0.7, 0.5, 0.4, 0.0, 0.9), "air": (0.8, 0.0, 0.7, 0.8, 0.2, 0.9, 0.0, 1.0)}


def through(x, stages):
    for s in stages:
        x = naive_stage(x, s)
    return x


def late(x, ms):
    n = int(ms / 1000 * RATE + 0.5)
    return np.concatenate([np.zeros(n), x])[: len(x)]


def by_hand(left, right, venue):
    """The feeds of one scene, bus by bus, with neutral knobs and ring levels of 1."""
    mid, side = (left + right) / 2, (left - right) / 2
    bus = {k: np.zeros(len(mid)) for k in "frontL frontR centre sideL sideR rearL rearR heightL heightR groundL groundR lfe".split()}
    around, above = 10 ** (-3 / 20), 10 ** (-6 / 20)
    above_edges = []
    for band, edge in zip(BANDS, (100, 300, 900, 3000, 8000, None), strict=True):
        own = above_edges + (d.lr4("lowpass", edge, RATE) if edge else [])
        m, s = through(mid, own), through(side, own)
        above_edges = above_edges + (d.lr4("highpass", edge, RATE) if edge else [])
        fm, cm, fs, ss, rs, hs, lm, depth = ROWS[band]
        centre = 0.0 if venue else cm * 0.5
        bus["centre"] += m * centre
        bus["frontL"] += m * (fm - 0.3 * centre) + s * fs
        bus["frontR"] += m * (fm - 0.3 * centre) - s * fs
        if lm:
            bus["lfe"] += lm * through(mid, d.lr4("lowpass", 120, RATE)) * around
        if band in feeds.DECORRELATION:
            pre, hz, ear_ms = feeds.DECORRELATION[band]
            for i, ear in enumerate("LR"):
                wet = through(s, [d.biquad("allpass", hz, 0.55, 0, RATE), d.biquad("allpass", hz * (1.4, 0.65)[i], (0.45, 0.6)[i], 0, RATE)])
                ms = pre * (0.4 + 0.6 * depth) + ear_ms * (1, 1.7)[i] * depth
                bus[f"side{ear}"] += late(wet, ms) * ss * around
                if band != "lowmid":
                    bus[f"rear{ear}"] += late(wet, ms + (4.6, 5.3)[i]) * rs * around
                    bus[f"height{ear}"] += late(wet, ms + (9.4, 10.6)[i]) * hs * above
                if band != "air" and venue:
                    dark = through(wet, [d.biquad("lowpass", 3000, 10 ** (0.7 / 20), 0, RATE)])
                    bus[f"ground{ear}"] += late(dark, ms + (2.8, 3.4)[i]) * ss * around
    return bus


def test_feeds_of_two_layouts(spark):
    rng = np.random.default_rng(3)
    clips = {"hall": "venue", "room": "7.1.4"}
    x = {k: rng.standard_normal((2, 1700)).astype(np.float32) for k in clips}
    rows = [(k, ch, i, [float(v) for v in x[k][ch, i * SIZE : (i + 1) * SIZE]]) for k in clips for ch in (0, 1) for i in range(7)]
    chunks = spark.createDataFrame(rows, "clip_id string, channel int, chunk_idx long, samples array<float>")
    names = ["frontM", "centreM", "frontS", "sideS", "rearS", "heightS", "lfeM", "decorr"]
    planned = spark.createDataFrame([(k, v, v != "venue", True, b, *ROWS[b]) for k, v in clips.items() for b in BANDS], "scene string, layout_id string, has_centre boolean, has_lfe boolean, band string, " + ", ".join(f"{n} double" for n in names))
    planned = planned.selectExpr("*", "cast(null as double) as centre_extract")
    scenes = spark.createDataFrame([(k, v, None, None, None, None, 1.0, 1.0, 1.0, 1.0) for k, v in clips.items()], "scene string, layout_id string, front_rear double, lfe_db double, surround_db double, height_db double, side double, rear double, height double, ground double")
    tapped = feeds.taps(dims.speakers(spark), dims.layout_channels(spark))
    gains = feeds.feed_gains(planned, scenes, tapped).withColumnRenamed("scene", "clip_id")
    got = {}
    for r in sorted(feeds.feeds(chunks, gains, SIZE, RATE).collect(), key=lambda r: r.chunk_idx):
        got.setdefault((r.clip_id, r.speaker_id), {})[r.chunk_idx] = r.samples
    of = {(r.layout_id, r.speaker_id): (r.bus, r.tap) for r in tapped.collect()}
    for clip, layout in clips.items():
        want = by_hand(*x[clip].astype(float), layout == "venue")
        for (lay, speaker), (bus, tap) in of.items():
            if lay == layout:
                parts = got.get((clip, speaker), {})
                y = np.zeros(1700)
                for i, s in parts.items():
                    y[i * SIZE : i * SIZE + len(s)] = s
                assert np.allclose(y, want[bus] * tap, atol=1e-9), (clip, speaker)
    assert ("room", "C") in got and of["venue", "V17"] == ("heightL", 1.05) and of["5.1", "Ls"] == ("sideL", 1.0) and of["9.1.6", "Lw"] == ("frontL", 0.75)


def test_groups_name_every_bus(spark):
    tapped = {r.bus for r in feeds.taps(dims.speakers(spark), dims.layout_channels(spark)).collect()}
    assert tapped <= {b for g in feeds.GROUPS.values() for b in g}


def test_without_rows(spark):
    gains = spark.createDataFrame([], "clip_id string, speaker_id string, path string, gain double, delay_ms double")
    chunks = spark.createDataFrame([("a", 0, 0, [1.0]), ("a", 1, 0, [1.0])], "clip_id string, channel int, chunk_idx long, samples array<float>")
    assert feeds.feeds(chunks, gains, 1, RATE).collect() == []
