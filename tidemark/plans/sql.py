"""DuckDB SQL of the registered queries, written apart from their plans."""

# frames of the events of each user, and of each type
FRAMES = """
WITH f AS (
  SELECT {series}, row_number() OVER (PARTITION BY {series} ORDER BY ts, event_id) - 1 AS frame, value / 500.0 AS value FROM events)
"""
USER = FRAMES.format(series="user_id")
TYPE = FRAMES.format(series="event_type")
R = "floor({x} * {f} + 0.5) / {f}"


def r(x: str, digits: int = 4) -> str:
    """Rounding with ties up."""
    return f"(floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)})"


def levels(series: str, block: int, hop: int) -> str:
    """Levels of hopping blocks by listing the blocks of each series."""
    return FRAMES.format(series=series) + f"""
, n AS (SELECT {series}, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT {series}, unnest(range(CAST(floor((n - {block}) / {hop}) AS BIGINT) + 1)) AS block_idx FROM n WHERE n >= {block}),
l AS (
  SELECT b.{series}, block_idx, -0.691 + 10 * log10(greatest(1e-30, sum(f.value * f.value) / {block})) AS level
  FROM b JOIN f ON f.{series} = b.{series} AND f.frame >= block_idx * {hop} AND f.frame < block_idx * {hop} + {block}
  GROUP BY b.{series}, block_idx)
"""


def gate(series: str, relative: float) -> str:
    return f"""
, loud AS (SELECT * FROM l WHERE level > -70),
t AS (SELECT {series}, -0.691 + 10 * log10(avg(pow(10, (level + 0.691) / 10))) + {relative} AS threshold FROM loud GROUP BY {series}),
g AS (SELECT loud.* FROM loud JOIN t USING ({series}) WHERE level > threshold)
"""


PAIR = "SELECT l_suppkey, l_extendedprice / 100000.0 AS x, l_quantity / 50.0 AS y FROM lineitem"
EMB = "SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings"
#: Statistics and settings that stand in for a measured source, from a customer's key and balance.
STATS = """
SELECT c_custkey, -26.0 + c_custkey % 23 AS integrated, 1.0 + c_custkey % 12 AS lra, 4.0 + c_custkey % 15 AS crest_db, -4.0 + (c_custkey % 9) * 0.5 AS true_peak_db,
       -2.0 + c_custkey % 8 AS bass_db, -1.0 + c_custkey % 7 AS presence_db, -3.0 + c_custkey % 8 AS treble_db, -0.2 + (c_custkey % 12) * 0.1 AS correlation, 1 + c_custkey % 2 AS channels
FROM customer
"""
CLASS = """
concat_ws('+',
  CASE WHEN integrated >= -11 THEN 'loud' WHEN integrated <= -20 THEN 'quiet' END,
  CASE WHEN crest_db < 7 OR (lra < 3 AND crest_db < 10) THEN 'dense' WHEN crest_db > 14 OR lra > 9 THEN 'dynamic' END,
  CASE WHEN true_peak_db > -1.5 THEN 'hot' END,
  CASE WHEN correlation < 0.15 THEN 'phasey' WHEN correlation < 0.35 THEN 'wide' END,
  CASE WHEN treble_db > 3 THEN 'bright' END, CASE WHEN bass_db > 4 THEN 'bass-heavy' END, CASE WHEN presence_db > 4 AND treble_db <= 3 THEN 'forward' END)
"""

CLASS_OR_BALANCED = f"CASE WHEN {CLASS} = '' THEN 'balanced' ELSE {CLASS} END"

ORACLES: dict[str, str] = {
    "gated_block_level": levels("event_type", 16, 4) + gate("event_type", -10) + f"SELECT event_type, {r('-0.691 + 10 * log10(avg(pow(10, (level + 0.691) / 10)))')} AS integrated, count(*) AS n_blocks FROM g GROUP BY event_type",
    "loudness_range": levels("user_id", 8, 2) + gate("user_id", -20) + f"SELECT user_id, {r('greatest(0, quantile_cont(level, 0.95) - quantile_cont(level, 0.10))')} AS lra, count(*) AS n_blocks FROM g GROUP BY user_id HAVING count(*) >= 2",
    "uneven_block_level": levels("user_id", 10, 3) + f"SELECT user_id, block_idx, {r('level')} AS level FROM l",
    "rms_crest_by_series": USER + f"SELECT user_id, count(*) AS n, {r('sqrt(avg(value * value))', 6)} AS rms, {r('20 * log10(greatest(1e-9, sqrt(avg(value * value)) * sqrt(2)))')} AS rms_db, {r('max(abs(value))', 6)} AS peak, CASE WHEN max(abs(value)) = 0 THEN 0 ELSE {r('20 * log10(greatest(1e-9, max(abs(value)))) - 20 * log10(greatest(1e-9, sqrt(avg(value * value))))')} END AS crest_db, {r('avg(value)', 6)} AS dc, bool_and(value = 0) AS silent FROM f GROUP BY user_id",
    "rms_envelope": USER + f", n AS (SELECT user_id, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT user_id, unnest(range(CAST(floor((n - 10) / 5) AS BIGINT) + 1)) AS block_idx FROM n WHERE n >= 10) SELECT b.user_id, block_idx, {r('sqrt(avg(value * value))', 6)} AS rms FROM b JOIN f ON f.user_id = b.user_id AND frame >= block_idx * 5 AND frame < block_idx * 5 + 10 GROUP BY ALL",
    "channel_correlation": f"WITH p AS ({PAIR}) SELECT l_suppkey, count(*) AS n, CASE WHEN sqrt(sum(x * x) * sum(y * y)) < 1e-20 THEN 1 ELSE {r('sum(x * y) / sqrt(sum(x * x) * sum(y * y))', 6)} END AS correlation FROM p GROUP BY l_suppkey",
    "mono_loss": f"WITH p AS ({PAIR}) SELECT l_suppkey, CASE WHEN greatest(sum(x * x), sum(y * y)) < 1e-20 THEN 0 ELSE {r('10 * log10(greatest(1e-20, sum(pow((x + y) / 2, 2)) / greatest(sum(x * x), sum(y * y))))')} END AS mono_loss_db FROM p GROUP BY l_suppkey",
    "mid_side_energy": f"WITH p AS ({PAIR}) SELECT l_suppkey, {r('10 * log10(greatest(1e-20, sum(pow((x + y) / 2, 2))))')} AS mid_db, {r('10 * log10(greatest(1e-20, sum(pow((x - y) / 2, 2))))')} AS side_db FROM p GROUP BY l_suppkey",
    "correlation_envelope": f"WITH p AS (SELECT l_suppkey, l_extendedprice / 100000.0 AS x, l_quantity / 50.0 AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS frame FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT l_suppkey, unnest(range(CAST(floor((n - 32) / 16) AS BIGINT) + 1)) AS block_idx FROM n WHERE n >= 32) SELECT b.l_suppkey, block_idx, {r('sum(x * y) / sqrt(sum(x * x) * sum(y * y))', 6)} AS correlation FROM b JOIN p ON p.l_suppkey = b.l_suppkey AND frame >= block_idx * 16 AND frame < block_idx * 16 + 32 GROUP BY ALL",
    "sliding_minimum": USER + f"SELECT user_id, frame, {r('min(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)', 6)} AS low FROM f",
    "peak_buckets": USER + f", n AS (SELECT user_id, greatest(1, CAST(floor(count(*) / 8) AS BIGINT)) AS step FROM f GROUP BY user_id) SELECT user_id, CAST(floor(frame / step) AS BIGINT) AS bucket, {r('max(abs(value))', 6)} AS peak FROM f JOIN n USING (user_id) WHERE floor(frame / step) < 8 GROUP BY ALL",
    "waveform_pyramid": USER + f", a AS (SELECT user_id, CAST(floor(frame / 4) AS BIGINT) AS bucket, min(value) AS vmin, max(nxt) AS vmax FROM (SELECT *, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY frame), value) AS nxt FROM f) GROUP BY ALL), b AS (SELECT user_id, CAST(floor(bucket / 4) AS BIGINT) AS bucket, min(vmin) AS vmin, max(vmax) AS vmax FROM a GROUP BY ALL), c AS (SELECT user_id, CAST(floor(bucket / 4) AS BIGINT) AS bucket, min(vmin) AS vmin, max(vmax) AS vmax FROM b GROUP BY ALL) SELECT user_id, level, bucket, {r('vmin', 6)} AS vmin, {r('vmax', 6)} AS vmax FROM (SELECT *, 0 AS level FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)",
    "tumbling_blocks": USER + f"SELECT user_id, CAST(floor(frame / 16) AS BIGINT) AS block_idx, {r('avg(value)', 8)} AS mean FROM f GROUP BY ALL HAVING count(*) = 16",
    "downsampled_maxima": USER + f", n AS (SELECT user_id, CAST(ceil(count(*) / 20) AS BIGINT) AS step FROM f GROUP BY user_id) SELECT user_id, CAST(floor(frame / step) AS BIGINT) AS point, {r('max(value)', 6)} AS value FROM f JOIN n USING (user_id) GROUP BY ALL",
    "percentile_range": USER + f"SELECT user_id, {r('quantile_cont(value, 0.1)', 6)} AS p10, {r('quantile_cont(value, 0.5)', 6)} AS p50, {r('quantile_cont(value, 0.95)', 6)} AS p95 FROM f GROUP BY user_id",
    "clip_runs": USER + ", i AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f WHERE value >= 0.3) SELECT user_id, min(frame) AS start, count(*) AS length FROM i GROUP BY user_id, run",
    "beep_sessions": USER + ", i AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) > 3 THEN 1 ELSE 0 END AS fresh FROM f WHERE value > 0.35), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS burst FROM i), u AS (SELECT user_id, max(frame) - min(frame) + 1 AS length FROM s GROUP BY user_id, burst) SELECT user_id, count(*) FILTER (length <= 6) AS beeps, count(*) FILTER (length > 6) AS tones FROM u GROUP BY user_id",
    "event_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
    "short_term_levels": f"SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, {r('-0.691 + 10 * log10(greatest(1e-30, avg(pow(value / 500.0, 2))))')} AS level FROM events GROUP BY ALL",
    "quantise_16bit": f"WITH e AS ({EMB}) SELECT vec_id, i, CAST(least(floor(least(greatest(v, -1), 1) * 32768 + 0.5), 32767) AS INTEGER) AS pcm FROM e",
    "gain_and_sample_peak": f"WITH e AS ({EMB}) SELECT vec_id, {r('max(abs(v * 0.5))', 6)} AS peak, {r('sqrt(avg(v * v * 0.25))', 6)} AS rms FROM e GROUP BY vec_id",
    "js_round_db": f"SELECT o_orderkey, {r('20 * log10(greatest(1e-9, o_totalprice / 500000.0))', 2)} AS level_db, {r('pow(10, (-(o_orderkey % 97)) / 20.0)', 6)} AS gain FROM orders",
    "band_smooth_3pt": f"WITH e AS ({EMB}), b AS (SELECT vec_id, i, v FROM e) SELECT vec_id, i, {r('v * 0.7 + (coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v)) * 0.15', 6)} AS smooth FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY i)",
    "hann_smooth": f"WITH e AS ({EMB}), w AS (SELECT k, 0.5 - 0.5 * cos(2 * pi() * (k + 4) / 8) AS g FROM (SELECT unnest(range(-3, 4)) AS k)) SELECT a.vec_id, a.i, {r('sum(b.v * g) / sum(g)', 5)} AS smooth FROM e a CROSS JOIN w JOIN e b ON b.vec_id = a.vec_id AND b.i = least(greatest(a.i + k, 0), 63) GROUP BY ALL",
    "goertzel_dot": f"WITH e AS ({EMB}), t AS (SELECT unnest(range(1, 9)) AS bin), m AS (SELECT vec_id, bin, sqrt(pow(sum(v * cos(2 * pi() * bin * i / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * i / 64)), 2)) / 32 AS mag FROM e CROSS JOIN t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, bin) AS rank FROM m) SELECT vec_id, CAST(max(bin) FILTER (rank = 1) AS INTEGER) AS best, {r('max(mag) FILTER (rank = 1)', 5)} AS magnitude, {r('max(mag) FILTER (rank = 1) / max(mag) FILTER (rank = 2)', 3)} AS confidence FROM k GROUP BY vec_id",
    "lag_alignment": f"WITH e AS ({EMB}), g AS (SELECT unnest(range(-8, 9)) AS lag), s AS (SELECT a.vec_id, lag, sum(a.v * b.v) AS dot FROM e a CROSS JOIN g JOIN e b ON b.vec_id = a.vec_id + 1 AND b.i = a.i + lag GROUP BY ALL) SELECT vec_id, CAST(arg_max(lag, (floor(dot * 1e6 + 0.5), -lag)) AS INTEGER) AS lag, {r('max(dot)', 5)} AS dot FROM s GROUP BY vec_id",
    "limiter_required_gain": "WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 60000.0 AS pk, pow(10, -1.3 / 20) AS c, pow(10, -2.8 / 20) AS k FROM lineitem), s AS (SELECT *, least(greatest((pk - k) / (c - k), 0), 1) AS t FROM p) SELECT l_orderkey, l_linenumber, " + r("CASE WHEN pk <= k THEN 1 WHEN pk >= c THEN c / pk ELSE least(1, 1 - (1 - least(1, c / pk)) * (t * t * (3 - 2 * t))) END", 6) + " AS gain FROM s",
    "limiter_statistics": "WITH g AS (SELECT l_suppkey, least(1.0, 40000.0 / l_extendedprice) AS g FROM lineitem) SELECT l_suppkey, " + r("20 * log10(greatest(1e-9, min(g)))") + " AS peak_gr_db, " + r("20 * log10(greatest(1e-9, coalesce(avg(g) FILTER (g < 0.9999), 1)))") + " AS avg_gr_db, " + r("count(*) FILTER (g < 0.9999) / count(*)") + " AS active FROM g GROUP BY l_suppkey",
    "classify_source": f"WITH s AS ({STATS}) SELECT c_custkey, CASE WHEN {CLASS} = '' THEN 'balanced' ELSE {CLASS} END AS source_class FROM s",
    "spatial_laws": "WITH p AS (SELECT p_partkey, (p_partkey % 31) / 10.0 AS w, (p_partkey % 11) / 10.0 AS b, (p_partkey % 36) * 1.0 AS h, (p_partkey % 21) / 20.0 AS x FROM part), v AS (SELECT *, CASE WHEN w <= 1 THEN w ELSE 1 + 1.2 * (1 - exp(-0.8 * (w - 1))) END AS side, CASE WHEN b <= 0 THEN 1 ELSE pow(10, -3 * pow(b, 1.35) / 20) END AS mid, CASE WHEN h > 0 THEN 1 / (1 + least(h, 40) / 300) ELSE 1 END AS haas, least(greatest((x - 0.55) / 0.45, 0), 1) AS t FROM p) SELECT p_partkey, " + r("side", 6) + " AS side_gain, " + r("CASE WHEN side <= 1 THEN side ELSE least(side, 1.5) END", 6) + " AS low_gain, " + r("mid", 6) + " AS mid_gain, " + r("haas", 6) + " AS haas_scale, " + r("CASE WHEN x <= 0.55 THEN 0.45 * x ELSE 0.2475 + 0.0825 * t * t * (3 - 2 * t) END", 6) + " AS crossfeed, " + r("least(greatest(side * haas, 0), 2.2)", 6) + " AS side_width FROM v",
    "phase_risk": "WITH p AS (SELECT p_partkey, (p_partkey % 26) / 10.0 AS width, (p_partkey % 5) * 60 AS bm, (p_partkey % 36) * 1.0 AS haas, (p_partkey % 11) / 10.0 AS rot, (p_partkey % 21) / 10.0 - 1 AS ms, (p_partkey % 17) / 10.0 AS wl FROM part), v AS (SELECT p_partkey, CASE WHEN width > 2.2 THEN 2 WHEN width > 1.8 THEN 1 END AS a, CASE WHEN width > 1.3 AND bm <= 0 THEN 1 END AS b, CASE WHEN haas > 20 THEN 2 WHEN haas > 8 THEN 1 END AS c, CASE WHEN rot > 0.5 THEN 1 END AS d, CASE WHEN ms > 0.5 THEN 1 END AS e, CASE WHEN wl > 1.4 THEN 2 END AS f FROM p) SELECT p_partkey, CASE greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0), coalesce(e, 0), coalesce(f, 0)) WHEN 0 THEN 'ok' WHEN 1 THEN 'caution' ELSE 'danger' END AS level, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT AS INTEGER) AS n_messages FROM v",
    "memory_class": "WITH o AS (SELECT o_orderkey, (1 + o_orderkey % 24) * CAST(floor(o_totalprice * 100) AS BIGINT) * 8 AS b FROM orders) SELECT o_orderkey, b AS peak_bytes, CASE WHEN b > 1073741824 * 1.25 THEN 'LIKELY UNSAFE' WHEN b > 1073741824 * 0.75 THEN 'VERY HEAVY' WHEN b > 1073741824 * 0.35 THEN 'HEAVY' ELSE 'SAFE' END AS memory_class FROM o",
    "top_bottlenecks": "WITH s AS (SELECT l_returnflag, l_linestatus, " + r("sum(l_extendedprice)", 2) + " AS total FROM lineitem GROUP BY ALL) SELECT * FROM s ORDER BY total DESC, l_returnflag, l_linestatus LIMIT 3",
    "union_catalog": "SELECT 'nation' AS catalogue, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'brand', p_brand FROM (SELECT DISTINCT p_brand FROM part)",
    "missing_measurements": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "present_measurements": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "channel_weights": "WITH w(n, weight) AS (VALUES ('EUROPE', 1.41), ('ASIA', 0.0)) SELECT s_suppkey, coalesce(weight, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN w ON n = r_name",
    "pcm_compare": f"WITH e AS ({EMB}), q AS (SELECT vec_id, i, v, least(floor(least(greatest(v, -1), 1) * 32768 + 0.5), 32767) / 32768 AS d FROM e) SELECT vec_id, {r('max(abs(v - d))', 7)} AS max_error, max(abs(v - d)) <= 1 / 32768.0 + 1e-7 AS ok FROM q GROUP BY vec_id",
    "delivery_checksums": "SELECT doc_id, sha256(text) AS sha256, sha256(text) || '  document_' || doc_id || '.txt' AS line FROM documents",
    "sanitise_names": r"""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '[<>:"|?*]', '', 'g'), '\s+', ' ', 'g')), '[. ]+$', '') AS raw FROM pages""",
    "xml_escape": r"""WITH e AS (SELECT page_id, html, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS x FROM pages)
SELECT page_id, md5(x) AS digest, html = replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS round_trip FROM e""",
    "fuzzy_match": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*g', 's')",
    "unique_names": "WITH n AS (SELECT p_partkey, p_type AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM n",
    "timecodes": "WITH s AS (SELECT o_orderkey, o_totalprice AS s FROM orders) SELECT o_orderkey, lpad(CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(s / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor((s - floor(s)) * 1e9 + 0.5) AS BIGINT) AS VARCHAR), 9, '0') AS timecode FROM s",
    "waveform_energy_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, " + r("sqrt(avg(l_quantity * l_quantity))", 6) + " AS rms FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "finite_audit": "SELECT user_id, count(*) AS n, count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (isinf(value)) AS inf, bool_and(isfinite(value)) AS ok FROM events GROUP BY user_id",
    "normalisation_gain": f"WITH s AS ({STATS}) SELECT c_custkey, {r('least(greatest(-14 - integrated, -40), 40)')} AS gain_db FROM s",
    "refinement_score": f"WITH s AS ({STATS}), d AS (SELECT c_custkey, (c_custkey % 9) * 0.1 - 0.4 AS delta, 1.5 * greatest(0, lra - 1.5) + 1.25 * greatest(0, crest_db - 3) AS damage FROM s) SELECT c_custkey, {r('CASE WHEN abs(delta) <= 0.15 THEN damage ELSE damage * 4 + abs(delta) * 0.35 END')} AS score FROM d",
    "band_settings": "SELECT p_partkey, " + r("-0.24 * least(p_size * 2.0, 100)", 6) + " AS threshold, " + r("1 + 0.02 * least(p_size * 2.0, 100)", 6) + " AS ratio FROM part",
    "identification_tones": "SELECT s_suppkey, " + r("220 * pow(2, s_suppkey % 24 / 12.0)") + " AS hz FROM supplier",
    "as_of_latest_order": "WITH q AS (SELECT event_id, user_id, ts FROM events) SELECT event_id, o_orderkey FROM (SELECT q.event_id, o.o_orderkey, row_number() OVER (PARTITION BY q.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS k FROM q JOIN orders o ON o.o_custkey = q.user_id AND o.o_orderdate <= q.ts) WHERE k = 1",
    "layout_report": """
WITH sp AS (SELECT * FROM (VALUES {speakers}) t(speaker_id, az, el, mask, lfe)), la AS (SELECT * FROM (VALUES {layouts}) t(layout_id, pos, speaker_id))
SELECT layout_id, count(*) AS n_channels, count(*) FILTER (lfe = 1) AS n_lfe, count(*) FILTER (el > 0) AS n_height, count(*) FILTER (lfe = 0 AND az > 0) AS n_left, count(*) FILTER (lfe = 0 AND az < 0) AS n_right FROM la JOIN sp USING (speaker_id) GROUP BY layout_id""",
    "profile_conformance": """
WITH p AS (SELECT * FROM (VALUES ('stereo-distribution', 24, [44100, 48000], 'stereo', -1.0, -14.0), ('film-video', 24, [48000], 'stereo', -2.0, -23.0), ('high-res-archive', 32, [48000, 88200, 96000, 176400, 192000], 'stereo', NULL, NULL), ('bed-714', 24, [48000, 96000], '7.1.4', -1.0, NULL), ('venue-204', 24, [48000, 96000], 'venue', -1.0, NULL), ('adm-ingest', 24, [48000, 96000], '7.1.4', -1.0, NULL)) t(profile_id, depth, rates, lay, ceil, loud)),
r AS (SELECT p_partkey AS render_id, ['stereo-distribution', 'film-video', 'high-res-archive', 'bed-714', 'venue-204', 'adm-ingest'][1 + p_partkey % 6] AS profile_id, [44100, 48000, 96000][1 + p_partkey % 3] AS rate, [16, 24, 32][1 + p_partkey % 3] AS bits, ['stereo', '7.1.4', 'venue'][1 + CAST(floor(p_partkey / 3) AS BIGINT) % 3] AS layout, -3.0 + (p_partkey % 10) * 0.4 AS tp, -25.0 + p_partkey % 14 AS lufs FROM part),
d AS (SELECT render_id, profile_id, concat_ws(',', CASE WHEN NOT list_contains(rates, rate) THEN 'sample rate' END, CASE WHEN bits <> depth THEN 'bit depth' END, CASE WHEN layout <> lay THEN 'layout' END) AS deviations, concat_ws(',', CASE WHEN tp > ceil + 0.05 THEN 'true peak' END, CASE WHEN abs(lufs - loud) > 1 THEN 'loudness' END) AS advisories FROM r JOIN p USING (profile_id))
SELECT render_id, profile_id, deviations = '' AS conforms, deviations, advisories FROM d""",
    "compare_measurements": """
WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'creative' ELSE 'reference' END AS cls, c_custkey AS k FROM customer),
b AS (SELECT id, -14.0 + k % 5 AS i, 10.0 + k % 4 AS cr, -18.0 + k % 3 AS rm, 0.9 AS co FROM k), c AS (SELECT id, cls, k, -14.0 + k % 7 AS i, 10.0 - k % 6 AS cr, -18.0 + k % 5 AS rm, 0.9 - (k % 8) * 0.1 AS co FROM k WHERE k % 10 <> 3),
j AS (SELECT c.*, c.i - b.i AS di, c.cr - b.cr AS dcr, c.rm - b.rm AS drm, c.co - b.co AS dco, CASE WHEN cls = 'reference' THEN 'defect' ELSE 'info' END AS sev, cls = 'creative' AS cv FROM c JOIN b USING (id))
SELECT sev AS severity, 'loudness-change' AS kind, id, cls AS class FROM j WHERE abs(di) > CASE WHEN cv THEN 3 ELSE 1 END
UNION ALL SELECT sev, 'crest-collapse', id, cls FROM j WHERE -dcr > CASE WHEN cv THEN 8 ELSE 3 END
UNION ALL SELECT sev, 'rms-change', id, cls FROM j WHERE abs(drm) > CASE WHEN cv THEN 4 ELSE 1 END
UNION ALL SELECT sev, 'correlation-collapse', id, cls FROM j WHERE -dco > CASE WHEN cv THEN 0.55 ELSE 0.155 END
UNION ALL SELECT 'defect', 'dc', id, cls FROM j WHERE k % 11 = 0
UNION ALL SELECT 'defect', 'missing-measurement', id, cls FROM k WHERE k % 10 = 3""",
    "hf_budget": f"""
WITH p AS (SELECT p_partkey AS k, greatest((p_partkey % 13 - 3) / 2e0, 0) AS air, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 11) / 1e1 * 15e-1 ELSE 0 END AS spread, greatest((p_partkey % 9 - 2) / 2e0, 0) AS clarity, greatest((p_partkey % 5 - 1) / 2e0, 0) AS tilt,
  2e-1 * greatest((p_partkey + 4) % 7 - 3, 0) + 45e-2 * greatest((p_partkey + 5) % 7 - 3, 0) + 85e-2 * greatest((p_partkey + 6) % 7 - 3, 0) + 1e0 * greatest((p_partkey + 7) % 7 - 3, 0) AS matched, greatest(least((p_partkey % 21 - 4) / 8e0, 1), 0) AS bright FROM part),
t AS (SELECT *, air + spread + 45e-2 * clarity + 85e-2 * tilt + matched AS total, 4 - 125e-2 * bright AS allowed FROM p),
s AS (SELECT *, total - allowed AS surplus, total > allowed AND total > 0 AS hit FROM t),
u AS (SELECT *, CASE WHEN hit THEN least(7, {r("surplus * 65e-2 * (5e-1 + least(1, surplus / 15e-1) * 5e-1)", 1)}) ELSE 0 END AS cut FROM s)
SELECT k AS p_partkey, hit AS engaged, {r("total", 1)} AS estimate_db, {r("allowed", 1)} AS allowed_db, {r("surplus", 1)} AS surplus_db, cut AS cut_db, CASE WHEN hit THEN {r("greatest(65e-2, 1 - greatest(0, least(1, surplus / 8)) * 4e-1)", 1)} ELSE 1 END AS sat_scale,
  CASE WHEN hit THEN {r("greatest(0, air - cut * air / total) + greatest(0, spread - cut * spread / total)", 1)} END AS air_total, CASE WHEN hit AND clarity > 0 THEN {r("greatest(0, clarity - cut * clarity * 45e-2 / total)", 1)} END AS clarity, CASE WHEN hit AND tilt > 0 THEN {r("greatest(0, tilt - cut * tilt * 85e-2 / total)", 1)} END AS tilt FROM u""",
    "hf_stack": "WITH p AS (SELECT p_partkey, greatest((p_partkey % 13 - 3) / 2.0, 0) AS air, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 11) / 10.0 * 1.5 ELSE 0 END AS spread, greatest((p_partkey % 9 - 2) / 2.0, 0) AS clarity, greatest((p_partkey % 5 - 1) / 2.0, 0) AS tilt FROM part), t AS (SELECT *, air + spread + 0.45 * clarity + 0.85 * tilt AS total, greatest(least(((p_partkey % 21 - 24) + 20) / 8.0, 1), 0) AS b FROM p), s AS (SELECT *, total - (4 - 1.25 * b) AS surplus FROM t) SELECT p_partkey, surplus > 0 AND total > 0 AS engaged, " + r("total", 1) + " AS estimate_db, CASE WHEN surplus > 0 THEN least(7, " + r("surplus * 0.65 * (0.5 + 0.5 * least(1, surplus / 1.5))", 1) + ") ELSE 0 END AS cut_db FROM s",
    "match_curve": f"WITH e AS ({EMB}), l AS (SELECT vec_id, i // 8 AS i, avg(v) * 10 AS v FROM e GROUP BY ALL), p AS (SELECT a.vec_id, a.i, b.v - a.v AS d FROM l a JOIN l b ON b.vec_id = a.vec_id + 1 AND b.i = a.i), m AS (SELECT *, d - avg(d) OVER (PARTITION BY vec_id) AS u FROM p), s AS (SELECT *, u * 0.7 + (coalesce(lag(u) OVER w, u) + coalesce(lead(u) OVER w, u)) * 0.15 AS sm FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY i)), t AS (SELECT *, sm * CASE i WHEN 0 THEN 0.5 WHEN 6 THEN 6.0 / 7 WHEN 7 THEN 2.0 / 7 ELSE 1 END AS ta FROM s), z AS (SELECT *, ta - avg(ta) OVER (PARTITION BY vec_id) AS g FROM t) SELECT vec_id, i, {r('least(greatest(g, -5), 5)', 1)} AS gain_db, {r('greatest(0, least(1, 1 - sqrt(avg(u * u) OVER (PARTITION BY vec_id)) / 12))', 2)} AS confidence FROM z",
}


def _dimension_values() -> tuple[str, str]:
    from tidemark.operators import dims

    own = [(a, float(b), float(c), int(m, 16), int(f)) for a, b, c, _, m, f in dims._lines(dims.SPEAKERS)]
    own += [(f"V{k + 1}", *map(float, v.split(":")), 0, int(k >= 20)) for k, v in enumerate(dims.VENUE.split())]
    layouts = dims.LAYOUTS | {"venue": " ".join(f"V{k + 1}" for k in range(24))}
    return ", ".join(map(str, own)), ", ".join(str((name, k, sp)) for name, x in layouts.items() for k, sp in enumerate(x.split()))


def _parameter_values() -> tuple[str, str]:
    from tidemark.operators import dims

    own = [row for row in dims._lines(dims.PARAMETERS) if row[1] != "array"]
    number = lambda x: "NULL::DOUBLE" if x == "-" else f"{x}::DOUBLE"
    listed = lambda x: "NULL" if x == "-" else str(x.split(","))
    rows = ", ".join(f"('{k}', '{kind}', '{d}', {number(a)}, {number(b)}, {listed(ch)})" for k, kind, d, a, b, ch in own)
    return rows, str([k for k, *_ in own])


def _sidecars() -> dict[str, str]:
    from tidemark.operators import dims

    return dims.SIDECARS


_SIDECARS = _sidecars()
_PARAMETERS, _KEYS = _parameter_values()
_SPEAKERS, _LAYOUTS = _dimension_values()
ORACLES["layout_report"] = ORACLES["layout_report"].format(speakers=_SPEAKERS, layouts=_LAYOUTS)

ORACLES["adapt_params"] = f"""
WITH s AS ({STATS}),
f AS (SELECT *, integrated >= -11 AS loud, crest_db < 7 OR (lra < 3 AND crest_db < 10) AS dense, treble_db > 3 AS bright, bass_db > 4 AS bassy, correlation < 0.35 AS wide, CASE WHEN correlation < 0.15 THEN 0 ELSE 0.35 END AS k, CASE WHEN correlation < 0.15 THEN 0 ELSE 0.4 END AS kb FROM s),
g AS (SELECT *, loud OR dense AS a, NOT (loud OR dense) AND crest_db < 10 AS b FROM f),
h AS (SELECT *, NOT a AND NOT b AND NOT dense AND (crest_db > 14 OR lra > 9) AS d FROM g),
i AS (SELECT *, NOT a AND NOT b AND NOT d AND integrated >= -14 AS n FROM h),
j AS (SELECT *, CASE WHEN a AND dense THEN 0.3 WHEN a THEN 0.45 WHEN b THEN 0.6 WHEN d OR n THEN 0.7 END AS mb FROM i),
p1 AS (
  SELECT *, CASE WHEN a THEN 0.0 WHEN b OR n THEN 0.5 ELSE 2.0 END AS drive1, CASE WHEN a THEN 9.0 WHEN b OR n THEN 21.0 ELSE 35.0 END AS sat1,
    CASE WHEN mb IS NULL THEN 30.0 ELSE floor(30 * mb + 0.5) END AS low1, CASE WHEN mb IS NULL THEN 22.0 ELSE floor(22 * mb + 0.5) END AS mid1, CASE WHEN mb IS NULL THEN 18.0 ELSE floor(18 * mb + 0.5) END AS high1,
    CASE WHEN a THEN 8.0 WHEN b THEN 12.0 ELSE 20.0 END AS ta, CASE WHEN a THEN -4.0 ELSE -10.0 END AS tsus, CASE WHEN d THEN 70.0 ELSE 90.0 END AS mix,
    CASE WHEN loud THEN 0.5 ELSE 1.2 END AS air1, CASE WHEN loud THEN 0.5 ELSE 1.0 END AS cla1, CASE WHEN loud THEN 0.0 ELSE 0.5 END AS tilt1, CASE WHEN loud THEN 1 + 0.35 * 0.25 ELSE 1.35 END AS w1,
    CASE WHEN a THEN 7 WHEN b THEN 6 WHEN d THEN 4 WHEN n THEN 5 ELSE 0 END + CASE WHEN loud THEN 4 ELSE 0 END AS n1 FROM j),
p2 AS (
  SELECT *, CASE WHEN true_peak_db > -1.5 THEN 0.0 ELSE drive1 END AS drive2, CASE WHEN true_peak_db > -0.3 THEN floor(sat1 * 0.5 + 0.5) ELSE sat1 END AS sat2,
    CASE WHEN bright THEN 0.0 WHEN presence_db > 4 AND cla1 > 0.5 THEN 0.5 ELSE cla1 END AS cla2, CASE WHEN bright THEN least(air1, 0.5) ELSE air1 END AS air2, CASE WHEN bright THEN 0.0 ELSE tilt1 END AS tilt2, CASE WHEN bright THEN 0.0 ELSE 0.5 END AS harsh2,
    CASE WHEN bassy AND dense THEN greatest(low1, 18.0) ELSE low1 END AS low2, CASE WHEN bassy AND channels <> 1 THEN 90.0 ELSE 80.0 END AS bass2,
    n1 + (true_peak_db > -1.5 AND drive1 > 0)::INT + (true_peak_db > -0.3)::INT + CASE WHEN bright THEN 2 + (air1 > 0.5)::INT + (tilt1 > 0)::INT ELSE (presence_db > 4 AND cla1 > 0.5)::INT END
       + CASE WHEN bassy THEN 2 + (dense AND low1 < 18)::INT + (channels <> 1)::INT ELSE 0 END + CASE WHEN wide THEN 6 ELSE 0 END AS n2 FROM p1)
SELECT c_custkey, {CLASS_OR_BALANCED} AS source_class, CAST(n2 AS INTEGER) AS n_edits, drive2::DOUBLE AS drive, sat2::DOUBLE AS sat, low2::DOUBLE AS "mbLow", mid1::DOUBLE AS "mbMid", high1::DOUBLE AS "mbHigh", mix::DOUBLE AS "mbMix", ta::DOUBLE AS "transAttack", tsus::DOUBLE AS "transSustain",
  air2::DOUBLE AS air, cla2::DOUBLE AS clarity, tilt2::DOUBLE AS tilt, harsh2::DOUBLE AS harsh, CASE WHEN bassy THEN 0.8 ELSE 1.5 END::DOUBLE AS sub, CASE WHEN bassy THEN 1.0 ELSE 1.5 END::DOUBLE AS warm, {r('CASE WHEN wide THEN 1 + (w1 - 1) * k ELSE w1 END')} AS width, bass2::DOUBLE AS "bassMono",
  {r('CASE WHEN wide THEN 6 * k ELSE 6 END')} AS haas, {r('CASE WHEN wide THEN 0.2 * k ELSE 0.2 END')} AS spread, {r('CASE WHEN wide THEN 0.1 * k ELSE 0.1 END')} AS "phaseRot", 1.0::DOUBLE AS "widthLow", {r('CASE WHEN wide THEN 1 + 0.2 * kb ELSE 1.2 END')} AS "widthMid", {r('CASE WHEN wide THEN 1 + 0.4 * kb ELSE 1.4 END')} AS "widthHigh"
FROM p2"""
ORACLES["wav_channel_order"] = f"""
WITH sp AS (SELECT * FROM (VALUES {_SPEAKERS}) t(speaker_id, az, el, bit, lfe)), la AS (SELECT * FROM (VALUES {_LAYOUTS}) t(layout_id, pos, speaker_id)),
j AS (SELECT layout_id, pos, speaker_id, bit FROM la JOIN sp USING (speaker_id)),
u AS (SELECT layout_id, layout_id NOT IN ('9.1.6', 'venue') AND min(bit) > 0 AND count(DISTINCT bit) = count(*) AS standard, bit_or(bit) AS bits FROM j GROUP BY layout_id)
SELECT layout_id, CAST(row_number() OVER (PARTITION BY layout_id ORDER BY CASE WHEN standard THEN bit ELSE pos END) AS INTEGER) AS channel, speaker_id, CAST(CASE WHEN standard THEN bits ELSE 0 END AS INTEGER) AS mask, standard FROM j JOIN u USING (layout_id)"""
ORACLES["spectral_centroid"] = f"""
WITH e AS ({EMB}), k AS (SELECT unnest(range(1, 33)) AS bin), m AS (SELECT vec_id, bin, pow(sum(v * cos(2 * pi() * bin * i / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * i / 64)), 2) AS p FROM e CROSS JOIN k GROUP BY ALL)
SELECT vec_id, {r('sum(p * bin) / sum(p)', 5)} AS centroid_bin FROM m GROUP BY vec_id"""
ORACLES["filename_durations"] = "SELECT o_orderkey, CAST(CAST(floor(o_totalprice + 0.5) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(o_totalprice + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS short, CASE WHEN o_totalprice * 100 < 1048576 THEN CAST(CAST(floor(o_totalprice * 100 / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE CASE WHEN o_totalprice * 100 >= 10485760 THEN CAST(CAST(floor(o_totalprice * 100 / 1048576 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', o_totalprice * 100 / 1048576) END || ' MB' END AS size FROM orders"
ORACLES["conversation_turns"] = "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id"
ORACLES["requires_stereo"] = "SELECT p_partkey, (p_partkey % 3) <> 1 OR p_partkey % 5 > 2 OR p_partkey % 7 = 0 AS stereo FROM part"

ORACLES["param_coercion"] = f"""
WITH spec AS (SELECT * FROM (VALUES {_PARAMETERS}) t(key, kind, fallback, low, high, choices)),
r AS (SELECT o_custkey % 20 AS set_id, ({_KEYS})[1 + o_orderkey % {_KEYS.count(",") + 1}] AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE CAST(o_orderkey % 301 - 150 AS VARCHAR) END AS value FROM orders),
own AS (SELECT set_id, key, max(value) AS value FROM r GROUP BY ALL),
j AS (SELECT k.set_id, spec.*, own.value FROM (SELECT DISTINCT set_id FROM r) k CROSS JOIN spec LEFT JOIN own ON own.set_id = k.set_id AND own.key = spec.key)
SELECT set_id, key, CASE WHEN kind = 'number' THEN CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN fallback ELSE CAST(least(greatest(try_cast(value AS DOUBLE), low), high) AS VARCHAR) END WHEN list_contains(choices, value) THEN value ELSE fallback END AS value,
       value IS NULL OR (kind <> 'number' AND NOT coalesce(list_contains(choices, value), false)) AS defaulted
FROM j"""
ORACLES["compressor_makeup"] = f"""
WITH RECURSIVE p AS (SELECT p_partkey, least(p_size * 2.0, 100) AS a FROM part),
q AS (SELECT p_partkey, -0.24 * a AS t, 1 + 0.02 * a AS ratio, pow(10, -0.24 * a / 20) AS lo_x, pow(10, (-0.24 * a + 12) / 20) AS end_x FROM p),
it AS (
  SELECT p_partkey, t, ratio, lo_x, end_x, 0.1::DOUBLE AS lo, 10000::DOUBLE AS hi, 5::DOUBLE AS k, 0 AS n FROM q
  UNION ALL
  SELECT p_partkey, t, ratio, lo_x, end_x, lo2, hi2, sqrt(lo2 * hi2), n + 1 FROM (
    SELECT *, CASE WHEN slope < 1 / ratio THEN lo ELSE k END AS lo2, CASE WHEN slope < 1 / ratio THEN k ELSE hi END AS hi2 FROM (
      SELECT *, (20 * log10(lo_x + (1 - exp(-k * (end_x * 1.001 - lo_x))) / k) - 20 * log10(lo_x + (1 - exp(-k * (end_x - lo_x))) / k)) / (20 * log10(end_x * 1.001) - 20 * log10(end_x)) AS slope FROM it WHERE n < 15))),
w AS (SELECT *, CASE WHEN end_x > 1 THEN 20 * log10(CASE WHEN 1 < lo_x THEN 1 ELSE lo_x + (1 - exp(-k * (1 - lo_x))) / k END) ELSE 20 * log10(lo_x + (1 - exp(-k * (end_x - lo_x))) / k) - (t + 12) / ratio END AS whole FROM it WHERE n = 15)
SELECT p_partkey, CASE WHEN ratio <= 1 THEN 0 ELSE {r('greatest(0, -0.6 * whole)')} END AS makeup_db FROM w"""
ORACLES["delivery_sidecars"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{f.replace('{base}', 'programme')}')" for k, v in _SIDECARS.items() for f in v.split()) + ") t(profile_id, file)"
