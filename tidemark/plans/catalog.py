"""Every registered query: the operators bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import text as tx
from tidemark.operators import clips, compare, delivery, dims, frames, immersive, kernels, levels, matching, rules
from tidemark.plans import designs, measures, records, series, render
from tidemark.plans.base import CYCLES, VECTORS, asked, asked_sql, cycles, eighths
from tidemark.plans.sql import ORACLES
from tidemark.sources import containers, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = records.query.queries | designs.query.queries | measures.query.queries | series.query.queries
ORACLES = ORACLES | records.query.oracles | designs.query.oracles | measures.query.oracles | series.query.oracles
c = F.col


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x, digits: int = 4):
    return s.js_round(x, digits)


def event_frames(spark, sf, series: str) -> DataFrame:
    """series, frame, value of all events, numbered by day so that no series needs one task."""
    rows = table(spark, sf, "events").select(series, "ts", "event_id", (c("value") / 500.0).alias("value"))
    return frames.framed(rows, series, ["ts", "event_id"], F.to_date("ts")).select(series, "frame", "value")


def components(spark, sf) -> DataFrame:
    """vec_id, i, v of every component."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), c("v").cast("double").alias("v"))


def stereo(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", (c("l_extendedprice") / 100000.0).alias("x"), (c("l_quantity") / 50.0).alias("y"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


def stats(spark, sf) -> DataFrame:
    k = c("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", (k % 23 - 26.0).alias("integrated"), (k % 12 + 1.0).alias("lra"), (k % 15 + 4.0).alias("crest_db"), ((k % 9) * 0.5 - 4.0).alias("true_peak_db"), (k % 8 - 2.0).alias("bass_db"), (k % 7 - 1.0).alias("presence_db"), (k % 8 - 3.0).alias("treble_db"), ((k % 12) * 0.1 - 0.2).alias("correlation"), (k % 2 + 1).alias("channels"))


@query
def gated_block_level(spark, sf):
    own = frames.integrated(frames.block_levels(event_frames(spark, sf, "event_type"), "event_type", 16, 4), "event_type")
    return own.select("event_type", r(c("integrated")).alias("integrated"), "n_blocks")


@query
def loudness_range(spark, sf):
    own = frames.loudness_range(frames.block_levels(event_frames(spark, sf, "user_id"), "user_id", 8, 2), "user_id")
    return own.select("user_id", r(c("lra")).alias("lra"), "n_blocks")


@query
def uneven_block_level(spark, sf):
    return frames.block_levels(event_frames(spark, sf, "user_id"), "user_id", 10, 3).select("user_id", "block_idx", r(c("level")).alias("level"))


@query
def rms_crest_by_series(spark, sf):
    v = c("value") / 500.0
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r(levels.rms(v), 6).alias("rms"), r(levels.rms_db(v)).alias("rms_db"), r(levels.peak(v), 6).alias("peak"), r(levels.crest_db(v)).alias("crest_db"), r(F.avg(v), 6).alias("dc"), F.bool_and(v == 0).alias("silent"))


@query
def rms_envelope(spark, sf):
    f = event_frames(spark, sf, "user_id")
    return frames.hop_blocks(f, "user_id", 10, 5, {"sq": c("value") * c("value")}).select("user_id", "block_idx", r(F.sqrt(c("sq") / 10), 6).alias("rms"))


@query
def channel_correlation(spark, sf):
    return stereo(spark, sf).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(levels.correlation(c("x"), c("y")), 6).alias("correlation"))


@query
def mono_loss(spark, sf):
    return stereo(spark, sf).groupBy("l_suppkey").agg(r(levels.mono_loss_db(c("x"), c("y"))).alias("mono_loss_db"))


@query
def mid_side_energy(spark, sf):
    m, d = levels.mid(c("x"), c("y")), levels.side(c("x"), c("y"))
    return stereo(spark, sf).groupBy("l_suppkey").agg(r(s.power_db(F.sum(m * m), 1e-20)).alias("mid_db"), r(s.power_db(F.sum(d * d), 1e-20)).alias("side_db"))


@query
def correlation_envelope(spark, sf):
    f = frames.framed(stereo(spark, sf), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], F.year("l_shipdate"))
    own = frames.hop_blocks(f, "l_suppkey", 32, 16, {"xy": c("x") * c("y"), "xx": c("x") * c("x"), "yy": c("y") * c("y")})
    return own.select("l_suppkey", "block_idx", r(c("xy") / F.sqrt(c("xx") * c("yy")), 6).alias("correlation"))


@query
def sliding_minimum(spark, sf):
    return frames.sliding_minimum(event_frames(spark, sf, "user_id"), "user_id", 5).select("user_id", "frame", r(c("low"), 6).alias("low"))


@query
def peak_buckets(spark, sf):
    return frames.peak_buckets(event_frames(spark, sf, "user_id"), "user_id", 8).select("user_id", "bucket", r(c("peak"), 6).alias("peak"))


@query
def waveform_pyramid(spark, sf):
    return frames.pyramid(event_frames(spark, sf, "user_id"), "user_id", 4, 3).select("user_id", "level", "bucket", r(c("vmin"), 6).alias("vmin"), r(c("vmax"), 6).alias("vmax"))


@query
def tumbling_blocks(spark, sf):
    return frames.hop_blocks(event_frames(spark, sf, "user_id"), "user_id", 16, 16, {"v": c("value")}).select("user_id", "block_idx", r(c("v") / 16, 8).alias("mean"))


@query
def downsampled_maxima(spark, sf):
    f = event_frames(spark, sf, "user_id")
    step = f.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / 20).alias("step"))
    return f.join(step, "user_id").groupBy("user_id", F.floor(c("frame") / c("step")).alias("point")).agg(r(F.max("value"), 6).alias("value"))


@query
def percentile_range(spark, sf):
    v = c("value") / 500.0
    return table(spark, sf, "events").groupBy("user_id").agg(*(r(F.percentile(v, F.lit(p)), 6).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95))))


@query
def clip_runs(spark, sf):
    return frames.runs(event_frames(spark, sf, "user_id"), "user_id", c("value") >= 0.3)


@query
def beep_sessions(spark, sf):
    own = frames.bursts(event_frames(spark, sf, "user_id"), "user_id", c("value") > 0.35, 3)
    return own.groupBy("user_id").agg(F.count_if(c("length") <= 6).alias("beeps"), F.count_if(c("length") > 6).alias("tones"))


@query
def event_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", c("ts").cast("timestamp").alias("ts"))
    own = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", c("w.start").cast("timestamp_ntz").alias("session_start"), c("w.end").cast("timestamp_ntz").alias("session_end"), "n")


@query
def short_term_levels(spark, sf):
    e = table(spark, sf, "events").withColumn("v", c("value") / 500.0)
    own = e.groupBy("event_type", F.window(c("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), s.block_level(F.avg(c("v") * c("v"))).alias("level"))
    return own.select("event_type", c("w.start").cast("timestamp_ntz").alias("day"), "n", r(c("level")).alias("level"))


@query
def quantise_16bit(spark, sf):
    return components(spark, sf).select("vec_id", "i", s.quantise(c("v"), 16).alias("pcm"))


@query
def gain_and_sample_peak(spark, sf):
    e = clips.gain(table(spark, sf, "embeddings").select("vec_id", c("embedding").alias("samples")), 0.5)
    own = e.select("vec_id", F.explode("samples").alias("v")).select("vec_id", c("v").cast("double").alias("v"))
    return own.groupBy("vec_id").agg(r(levels.peak(c("v")), 6).alias("peak"), r(levels.rms(c("v")), 6).alias("rms"))


@query
def js_round_db(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", r(s.gain_to_db(c("o_totalprice") / 500000.0), 2).alias("level_db"), r(s.db_to_gain(-(c("o_orderkey") % 97).cast("double")), 6).alias("gain"))


@query
def band_smooth_3pt(spark, sf):
    own = frames.smooth_3pt(components(spark, sf).withColumnRenamed("i", "frame").withColumnRenamed("v", "value"), "vec_id", 0.3)
    return own.select("vec_id", c("frame").alias("i"), r(c("smooth"), 6).alias("smooth"))


@query
def hann_smooth(spark, sf):
    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.hann_smooth(np.asarray(x, np.float64), 3) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), r(c("v"), 5).alias("smooth"))


@query
def goertzel_dot(spark, sf):
    """Best of eight tones of each channel by the magnitude of its product with the tone, and how far ahead it is."""

    @F.pandas_udf("best int, magnitude double, second double")
    def run(e: pd.Series) -> pd.DataFrame:
        rows = []
        for x in e:
            x = np.asarray(x, np.float64)
            top = sorted(((immersive.goertzel(x, b, len(x)), b) for b in range(1, 9)), reverse=True)
            rows.append((top[0][1], top[0][0], top[1][0]))
        return pd.DataFrame(rows, columns=["best", "magnitude", "second"])

    own = table(spark, sf, "embeddings").select("vec_id", run("embedding").alias("g"))
    return own.select("vec_id", "g.best", r(c("g.magnitude"), 5).alias("magnitude"), r(c("g.magnitude") / c("g.second"), 3).alias("confidence"))


@query
def lag_alignment(spark, sf):
    """Lag within 8 samples at which a vector fits the next one best."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    j = e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("e").alias("o")), "vec_id")
    best = matching.best_lag(c("e"), c("o"), 8)
    return j.select("vec_id", best.alias("b")).select("vec_id", c("b.lag").alias("lag"), r(c("b.dot"), 5).alias("dot"))


@query
def limiter_required_gain(spark, sf):
    @F.pandas_udf("double")
    def need(peaks: pd.Series) -> pd.Series:
        return pd.Series(kernels.required_gain(peaks.to_numpy(), 10 ** (-1.3 / 20)))

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(need(c("l_extendedprice") / 60000.0), 6).alias("gain"))


@query
def limiter_statistics(spark, sf):
    g = F.least(F.lit(1.0), F.lit(40000.0) / c("l_extendedprice"))
    own = levels.reduction(g)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*(r(v).alias(k) for k, v in own.items()))


@query
def classify_source(spark, sf):
    return stats(spark, sf).select("c_custkey", rules.source_class().alias("source_class"))


@query
def adapt_params(spark, sf):
    """A creative preset eased for every source; the number of edits."""
    preset = {"normalize": True, "targetLUFS": -12.0, "drive": 2.0, "sat": 35.0, "mbLow": 30.0, "mbMid": 22.0, "mbHigh": 18.0, "mbMix": 90.0, "transAttack": 20.0, "transSustain": -10.0, "air": 1.2, "clarity": 1.0, "tilt": 0.5, "harsh": 0.5, "sub": 1.5, "warm": 1.5, "width": 1.35, "bassMono": 80.0, "haas": 6.0, "spread": 0.2, "phaseRot": 0.1, "widthLow": 1.0, "widthMid": 1.2, "widthHigh": 1.4}
    own = rules.adapt(stats(spark, sf).withColumns({k: F.lit(v) for k, v in preset.items()}))
    return own.select("c_custkey", "source_class", F.size("edits").alias("n_edits"), *(r(c(k)).alias(k) for k in preset if k not in ("normalize", "targetLUFS")))


@query
def hf_budget(spark, sf):
    p = table(spark, sf, "part")
    k = c("p_partkey")
    match = F.array(*(((k + i) % 7 - 3).cast("double") for i in range(8)))
    plan = rules.hf_budget((k % 13 - 3) / 2.0, (k % 11) / 10.0, k % 2 == 0, (k % 9 - 2) / 2.0, (k % 5 - 1) / 2.0, match, rules.brightness_factor((k % 21 - 24).cast("double")))
    return p.select("p_partkey", plan.alias("b")).select("p_partkey", "b.*")


@query
def spatial_laws(spark, sf):
    k = c("p_partkey")
    w, b, h, x = (k % 31) / 10.0, (k % 11) / 10.0, (k % 36) * 1.0, (k % 21) / 20.0
    side = rules.width_side_gain(w)
    return table(spark, sf, "part").select("p_partkey", r(side, 6).alias("side_gain"), r(rules.cap_side_gain(side, "low"), 6).alias("low_gain"), r(rules.mid_balance_gain(b), 6).alias("mid_gain"), r(rules.haas_width_scale(h), 6).alias("haas_scale"), r(rules.crossfeed_tap_gain(x), 6).alias("crossfeed"), r(rules.side_width_gain(w, F.lit(0.0), F.lit(False), F.lit(0.0), h), 6).alias("side_width"))


@query
def phase_risk(spark, sf):
    k = c("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", ((k % 26) / 10.0).alias("width"), ((k % 5) * 60).alias("bassMono"), ((k % 36) * 1.0).alias("haas"), ((k % 11) / 10.0).alias("phaseRot"), ((k % 21) / 10.0 - 1).alias("ms"), ((k % 17) / 10.0).alias("widthLow"))
    return p.select("p_partkey", rules.phase_risk().alias("x")).select("p_partkey", "x.level", F.size("x.messages").alias("n_messages"))


@query
def memory_class(spark, sf):
    b = rules.audio_memory(1 + c("o_orderkey") % 24, F.floor(c("o_totalprice") * 100), 8)
    return table(spark, sf, "orders").select("o_orderkey", b.alias("peak_bytes"), rules.memory_class(b, F.lit(float(1 << 30))).alias("memory_class"))


@query
def top_bottlenecks(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_extendedprice"), 2).alias("total"))
    return own.orderBy(F.desc("total"), "l_returnflag", "l_linestatus").limit(3)


@query
def union_catalog(spark, sf):
    own = lambda t, col, name: table(spark, sf, t).select(F.lit(name).alias("catalogue"), c(col).alias("name"))
    return own("nation", "n_name", "nation").unionAll(own("region", "r_name", "region")).unionAll(own("part", "p_brand", "brand").distinct())


@query
def missing_measurements(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def present_measurements(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query
def channel_weights(spark, sf):
    """Weights of a lookup, and a default where there is none."""
    w = spark.createDataFrame([("EUROPE", 1.41), ("ASIA", 0.0)], "r_name string, weight double")
    s_ = table(spark, sf, "supplier").join(table(spark, sf, "nation"), c("n_nationkey") == c("s_nationkey")).join(table(spark, sf, "region"), c("r_regionkey") == c("n_regionkey"))
    return dims.weighted(s_.withColumn("lfe", c("s_acctbal") < 0), w, "r_name").select("s_suppkey", "weight")


@query
def pcm_compare(spark, sf):
    e = components(spark, sf).select(c("vec_id").alias("clip"), F.lit(0).alias("channel"), c("i").alias("frame"), c("v").alias("value"))
    decoded = e.withColumn("value", s.quantise(c("value"), 16) / 32768.0)
    own = compare.pcm_differences(e, decoded, s.quantisation_tolerance(F.lit(16)))
    return own.select(c("clip").alias("vec_id"), r(c("max_error"), 7).alias("max_error"), (c("max_error") <= s.quantisation_tolerance(F.lit(16))).alias("ok"))


@query
def delivery_checksums(spark, sf):
    files = table(spark, sf, "documents").select(c("doc_id").alias("package"), F.concat(F.lit("document_"), c("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return delivery.checksum_lines(files).select(c("package").alias("doc_id"), F.substring("text", 1, 64).alias("sha256"), c("text").alias("line"))


@query
def sanitise_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.sanitise_filename(c("url"), fallback="").alias("raw"))


@query
def xml_escape(spark, sf):
    e = tx.xml_escape(c("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(F.encode(e, "UTF-8")).alias("digest"), (tx.xml_unescape(e) == c("html")).alias("round_trip"))


@query
def fuzzy_match(spark, sf):
    return table(spark, sf, "part").where(tx.fuzzy_match("rdg", c("p_name"))).select("p_partkey", "p_name")


@query
def unique_names(spark, sf):
    k = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("k", k).select("p_partkey", F.concat("p_type", F.when(c("k") > 1, F.concat(F.lit(" ("), c("k").cast("string"), F.lit(")"))).otherwise("")).alias("name"))


@query
def timecodes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.timecode(c("o_totalprice")).alias("timecode"))


@query
def waveform_energy_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r(levels.rms(c("l_quantity")), 6).alias("rms"))


@query
def finite_audit(spark, sf):
    v = c("value")
    inf = F.abs(v) == float("inf")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(inf).alias("inf"), F.bool_and(~F.isnan(v) & ~inf).alias("ok"))


@query
def normalisation_gain(spark, sf):
    return stats(spark, sf).select("c_custkey", r(s.normalisation_gain(c("integrated"), F.lit(-14.0))).alias("gain_db"))


@query
def refinement_score(spark, sf):
    return stats(spark, sf).select("c_custkey", r(s.refinement_score((c("c_custkey") % 9) * 0.1 - 0.4, -c("lra"), -c("crest_db"))).alias("score"))


@query
def band_settings(spark, sf):
    b = rules.band_settings(c("p_size") * 2.0)
    return table(spark, sf, "part").select("p_partkey", r(b["threshold"], 6).alias("threshold"), r(b["ratio"], 6).alias("ratio"))


@query
def identification_tones(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", r(s.identification_hz(c("s_suppkey") % 24)).alias("hz"))


@query
def as_of_latest_order(spark, sf):
    """The latest order of each event's user at its time."""
    e = table(spark, sf, "events").select("event_id", c("user_id").alias("k"), c("ts").cast("timestamp").alias("t"))
    o = table(spark, sf, "orders").select(c("o_custkey").alias("k"), c("o_orderdate").cast("timestamp").alias("t"), "o_orderkey")
    return frames.as_of(e, o, "k", "t", "o_orderkey", F.date_trunc("month", "t")).where("o_orderkey is not null").select("event_id", "o_orderkey")


@query
def layout_report(spark, sf):
    j = dims.layout_channels(spark).join(dims.speakers(spark), "speaker_id")
    return j.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n_channels"), F.count_if("lfe").alias("n_lfe"), F.count_if(c("elevation") > 0).alias("n_height"), F.count_if(~c("lfe") & (c("azimuth_adm") > 0)).alias("n_left"), F.count_if(~c("lfe") & (c("azimuth_adm") < 0)).alias("n_right"))


@query
def profile_conformance(spark, sf):
    k = c("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    renders = table(spark, sf, "part").select(k.alias("render_id"), pick(["stereo-distribution", "film-video", "high-res-archive", "bed-714", "venue-204", "adm-ingest"], k % 6).alias("profile_id"), pick([44100, 48000, 96000], k % 3).alias("sample_rate"), pick([16, 24, 32], k % 3).alias("bit_depth"), pick(["stereo", "7.1.4", "venue"], F.floor(k / 3) % 3).alias("layout"), ((k % 10) * 0.4 - 3.0).alias("true_peak"), (k % 14 - 25.0).alias("integrated"))
    return dims.conformance(renders, spark)


@query
def compare_measurements(spark, sf):
    k = c("c_custkey")
    none = F.lit(None).cast("double")
    own = lambda kept, i, crest, rms, corr, dc: table(spark, sf, "customer").where(kept).select(k.alias("id"), F.when(k % 2 == 0, "creative").otherwise("reference").alias("class"), F.lit(0).alias("nan"), F.lit(0).alias("inf"), dc.alias("dc"), none.alias("true_peak_db"), i.alias("integrated"), crest.alias("crest_db"), rms.alias("rms_db"), corr.alias("correlation"), none.alias("mono_loss_db"), none.alias("centroid_hz"))
    base = own(F.lit(True), k % 5 - 14.0, k % 4 + 10.0, k % 3 - 18.0, F.lit(0.9), F.lit(0.0))
    cand = own(k % 10 != 3, k % 7 - 14.0, F.lit(10.0) - k % 6, k % 5 - 18.0, F.lit(0.9) - (k % 8) * 0.1, F.when(k % 11 == 0, 0.06).otherwise(0.0))
    return compare.flags(base, cand).select("severity", "kind", "id", "class")


@query
def hf_stack(spark, sf):
    k = c("p_partkey")
    plan = rules.hf_budget((k % 13 - 3) / 2.0, (k % 11) / 10.0, k % 2 == 0, (k % 9 - 2) / 2.0, (k % 5 - 1) / 2.0, F.array(*[F.lit(0.0)] * 8), rules.brightness_factor((k % 21 - 24).cast("double")))
    return table(spark, sf, "part").select("p_partkey", plan.alias("b")).select("p_partkey", "b.engaged", "b.estimate_db", "b.cut_db")


@query
def match_curve(spark, sf):
    """Means of each vector's eighths as levels of bands, matched to the next vector's."""
    bands = table(spark, sf, "embeddings").select("vec_id", eighths(c("embedding")).alias("bands"))
    pairs = bands.join(bands.select((c("vec_id") - 1).alias("vec_id"), c("bands").alias("reference")), "vec_id")
    out = pairs.select("vec_id", matching.curve(c("bands"), c("reference")).alias("m"))
    return out.select("vec_id", c("m.confidence").alias("confidence"), F.posexplode("m.gains").alias("i", "gain_db")).select("vec_id", c("i").cast("bigint").alias("i"), "gain_db", "confidence")


@query
def wav_channel_order(spark, sf):
    return dims.wav_channel_order(spark)


@query
def delivery_sidecars(spark, sf):
    return dims.profiles(spark).select("profile_id", F.explode(F.transform("sidecars", lambda x: F.replace(x, F.lit("{base}"), F.lit("programme")))).alias("file"))


@query
def param_coercion(spark, sf):
    """Settings as text from orders, against the parameter table."""
    spec = dims.param_spec(spark).where(c("kind") != "array")
    keys = [x for x, v in dims.defaults().items() if "," not in v]
    o = table(spark, sf, "orders")
    key = F.element_at(F.array(*map(F.lit, keys)), (c("o_orderkey") % len(keys) + 1).cast("int"))
    rows = o.select((c("o_custkey") % 20).alias("set_id"), key.alias("key"), F.when(c("o_orderkey") % 5 == 0, "bad").otherwise((c("o_orderkey") % 301 - 150).cast("string")).alias("value"))
    return rules.coerce(rows, spec)


@query
def compressor_makeup(spark, sf):
    p = table(spark, sf, "part")
    b = rules.band_settings(c("p_size") * 2.0)
    return p.select("p_partkey", r(rules.makeup_db(b["threshold"], b["knee"], b["ratio"])).alias("makeup_db"))


@query
def measure_clips(spark, sf):
    """The measurement document of every clip."""
    return clips.each_clip(cycles(spark, sf), clips.measure, clips.MEASURES)


@query
def limit_true_peak(spark, sf):
    def run(clip, x, rate):
        y, st = kernels.limit((x * 2).astype("float32"), rate, -1.0)
        return [{"clip_id": clip, **{k: st[k] for k in ("peak_gr_db", "avg_gr_db", "active", "trim_db", "true_peak_db", "ceiling_respected")}}]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, peak_gr_db double, avg_gr_db double, active double, trim_db double, true_peak_db double, ceiling_respected boolean")


@query
def render_report(spark, sf):
    return render.render(cycles(spark, sf), render.Job(target=-16.0))


@query
def fingerprint_fft(spark, sf):
    def run(clip, x, rate):
        f = kernels.fingerprint(x, rate)
        return [{"clip_id": clip, "bands_db": f and f["bands_db"], "frames_used": f and f["frames_used"], "frames_rejected": f and f["frames_rejected"]}]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, bands_db array<double>, frames_used int, frames_rejected int")


@query
def resample(spark, sf):
    def run(clip, x, rate):
        y = kernels.resample(x, rate, 44_100)
        return [{"clip_id": clip, "n_frames": y.shape[1], "peak": float(abs(y).max())}]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, n_frames bigint, peak double")


@query
def dither_tpdf(spark, sf):
    def run(clip, x, rate):
        return [{"clip_id": clip, "mode": m, "error_db": kernels.to_db(float(((kernels.dither(x, m, 16, 7) - x) ** 2).mean() ** 0.5))} for m in ("none", "tpdf", "shaped")]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, mode string, error_db double")


@query
def shape_transients(spark, sf):
    def run(clip, x, rate):
        y = kernels.shape_transients(x, rate, 60, -20)
        return [{"clip_id": clip, "peak_before": float(abs(x).max()), "peak_after": float(abs(y).max())}]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, peak_before double, peak_after double")


@query
def spatial_profiles(spark, sf):
    def run(clip, x, rate):
        return [{"clip_id": clip, **kernels.spatial_profile(x[0], x[1], rate)}]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, brightness_air_db double, centre_dominance double, width double, bass_coherence double, ambient_ratio double, onsets_per_s double")


@query
def inspect_containers(spark, sf):
    """A file of every clip, written and inspected again: chunk rows."""
    def run(clip, x, rate):
        raw = containers.write_wav(x, rate, 24)
        found = containers.inspect(raw)
        return [{"clip_id": clip, "idx": i, "id": ch["id"], "starts_at": ch["offset"], "size": ch["size"], "errors": len(found["errors"]), "sniffed_rate": containers.sniff_rate(raw)} for i, ch in enumerate(found["chunks"])]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, idx int, id string, starts_at bigint, size bigint, errors int, sniffed_rate int")


@query
def speaker_feeds(spark, sf):
    """Levels of a stereo programme's feeds in each standard layout."""
    def run(clip, x, rate):
        return [{"clip_id": clip, "layout_id": lay, "channel": i, "speaker_id": sp, "rms": float((feed**2).mean() ** 0.5)} for lay in dims.LAYOUTS for i, (sp, feed) in enumerate(immersive.feeds(x, rate, dims.LAYOUTS[lay].split()).items())]

    return clips.each_clip(cycles(spark, sf), run, "clip_id string, layout_id string, channel int, speaker_id string, rms double")


@query
def identify_channels(spark, sf):
    """Which tone each channel of the identification signal carries, with a runner-up ratio, and its beeps."""
    rows = table(spark, sf, "part").select((2 + c("p_size") % 7).cast("int").alias("n")).distinct().repartition(7)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(n, *x) for n in b["n"] for x in immersive.identify(signals.identification(n), signals.RATE)], columns=["n", "channel", "detected", "confidence", "beeps"])

    return rows.mapInPandas(run, "n int, channel int, detected int, confidence double, beeps int")


@query
def crossover_response(spark, sf):
    """Worst deviation of the three-band tree's sum from flat, by rate, over the frequencies that the parts ask for."""
    from tidemark.functions import design

    k = c("p_partkey")
    rate = F.element_at(F.array(*map(F.lit, (44_100, 48_000, 96_000))), (k % 3 + 1).cast("int"))
    asked_for = table(spark, sf, "part").select(rate.alias("rate"), (20 * F.pow(F.lit(1000.0), F.pmod(k, F.lit(512)) / 511)).alias("hz"))

    def run(batches):
        for b in batches:
            for rate, own in b.groupby("rate"):
                f = own["hz"].to_numpy()
                bands = design.crossover(140, 3200, int(rate))
                db = 20 * np.log10(np.abs(sum(design.response(bands[k], f, int(rate)) for k in ("low", "mid", "high"))))
                yield pd.DataFrame({"rate": own["rate"].to_numpy(), "hz": f, "db": np.abs(db)})

    each = asked_for.mapInPandas(run, "rate int, hz double, db double")
    return each.groupBy("rate").agg(F.max("db").alias("worst_db"), F.max_by("hz", "db").alias("worst_hz"))


@query
def spectral_centroid(spark, sf):
    """Centre of the power of each vector's spectrum, in bins: an FFT in Arrow batches."""
    @F.pandas_udf("double")
    def centroid(e: pd.Series) -> pd.Series:
        p = np.abs(np.fft.rfft(np.stack(e.to_numpy()).astype(np.float64))) ** 2
        k = np.arange(p.shape[1])
        return pd.Series((p[:, 1:] * k[1:]).sum(1) / p[:, 1:].sum(1))

    return table(spark, sf, "embeddings").select("vec_id", r(centroid("embedding"), 5).alias("centroid_bin"))


@query
def filename_durations(spark, sf):
    price = c("o_totalprice")
    short = F.when(price.isNotNull(), tx.short_duration(price))  # which reads null as 0
    return table(spark, sf, "orders").select("o_orderkey", short.alias("short"), tx.format_bytes(price * 100).alias("size"))


@query
def conversation_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query
def requires_stereo(spark, sf):
    k = c("p_partkey")
    zero = F.lit(0.0)
    p = table(spark, sf, "part").select("p_partkey", (k % 3).alias("width"), F.when(k % 5 > 2, 5.0).otherwise(0.0).alias("haas"), (k % 7 == 0).alias("binaural"), *(zero.alias(x) for x in ("ms", "bassMono", "crossfeed", "phaseRot", "spread", "depth", "tape")), *(F.lit(1.0).alias(x) for x in ("widthLow", "widthMid", "widthHigh")))
    return p.select("p_partkey", rules.requires_stereo().alias("stereo"))


ORACLES["inspect_containers"] = f"""
WITH e AS (SELECT 'clip-' || (vec_id // {VECTORS}) AS clip_id, CAST(sum(len(embedding)) * {CYCLES} AS BIGINT) AS frames FROM embeddings GROUP BY 1)
SELECT clip_id, idx, id, starts_at, CASE WHEN idx = 0 THEN 16 ELSE frames * 6 END AS size, 0 AS errors, 48000 AS sniffed_rate
FROM e, (VALUES (0, 'fmt ', 12), (1, 'data', 36)) AS t(idx, id, starts_at)"""


def _for_each_part(name: str, key: str, names: list[str]) -> None:
    """Binds a query on fixed tables to the parts: each asks for the rows of one name."""
    of = QUERIES[name]
    QUERIES[name] = lambda spark, sf: asked(spark, sf, key, names).join(of(spark, sf), key)
    ORACLES[name] = asked_sql(ORACLES[name], key, names)


_SPEAKER_IDS = sorted({sp for own in dims.LAYOUTS.values() for sp in own.split()} | {f"V{k + 1}" for k in range(24)})
for _name in ("layout_report", "wav_channel_order", "channel_map_texts", "channel_map_records"):
    _for_each_part(_name, "layout_id", [*dims.LAYOUTS, "venue"])
for _name in ("audition_groups", "speaker_placements"):
    _for_each_part(_name, "speaker_id", _SPEAKER_IDS)
_for_each_part("preview_divergences", "key", ["ceiling", "transAttack", "transSustain", "dither"])
_for_each_part("delivery_sidecars", "profile_id", ["stereo-distribution", "film-video", "high-res-archive", "bed-714", "venue-204", "adm-ingest"])
_for_each_part("generated_signals", "clip_id", measures._CLIPS)
