import hashlib
import re

import duckdb
import numpy as np
import pytest
from tidemark.llm import ann, warc
from tidemark.llm.queries import OP10_SQL, op6_rotated_one_bit_codes, op10_revisit_payloads, op10_revisit_resolution


def brute(rows, k=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [16_384, 200, 30])
def test_neighbours_against_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).round(2).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, []), (None, rows[3][1]), rows[200]]
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, op6_rotated_one_bit_codes(spark, str(tmp_path)).collect()))
    want = brute(rows)
    assert len(got) == len(want)
    hit = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert hit >= 0.99
    exact = {(q, i): d for q, _, i, d in want}
    assert all(abs(exact[q, i] - d) < 1e-12 for q, _, i, d in got if (q, i) in exact)
    assert [(i, d) for q, _, i, d in got if q == 100][:10] == [(1000 + i, 0.0) for i in range(10)]


def test_few_and_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 5, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).collect() == []
    assert ann.search(df, df.limit(0)).collect() == []
    other = spark.createDataFrame([(7, [1.0]), (8, [2.0]), (9, [1.0, 2.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(df, other).collect()] == [(9, 1, 0, 0.5), (9, 2, 5, 5**0.5 / 2)]


def test_recall_and_work_on_a_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in ann.search(df, df.where("vec_id % 100 = 0")).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows)}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_far_cells_are_not_visited(spark, monkeypatch):
    """Queries in tight groups meet their own cells only, and find what brute force finds."""
    monkeypatch.setattr(ann, "CHUNK", 100)
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] * 50 + rng.standard_normal(8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, df.where("vec_id % 100 = 0")).collect()))
    want = brute(rows)
    assert len({r[:3] for r in got} & {r[:3] for r in want}) >= 0.99 * len(want)


def test_pages_against_sql(spark, tmp_path):
    import random

    rng = random.Random(3)
    urls = ["http://www.A.example/x/?utm_source=feed", "https://a.example/x#top", "a.example:80/x/", "http://a.example/x?ref=q&page=2", "https://b.example/y?page=1&utm_medium=z", "", None]
    rows = [(i, rng.choice(urls), rng.choice(["one", "two", "", None]), 1) for i in range(300)] + [(1000 + i, urls[0], "hot", 1) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = op10_revisit_resolution(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({OP10_SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_payloads_of_pages(spark, tmp_path):
    rows = [(1, "http://a.example/x", "one"), (2, "http://www.a.example/x/", "one"), (3, "http://a.example/x", "two"), (4, "http://b.example/", "one"), (5, "http://a.example/x", "two")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in op10_revisit_payloads(spark, str(tmp_path)).collect()}
    assert {k: (r.outcome, r.source_page_id, r.payload) for k, r in out.items()} == {
        1: ("unresolved", None, None), 2: ("resolved", 1, "one"), 3: ("changed", None, None), 4: ("unresolved", None, None), 5: ("resolved", 3, "two"),
    }
    assert out[2].headers == {"etag": out[1].headers["etag"], "date": "2", "content-type": "text/html"}


def test_payloads_of_a_whole_table(spark):
    """Every page of a given table against a replay of the crawl in order, in plain Python."""
    pages = sorted((r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())

    def canonical(url):
        url = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip().split("#")[0])
        host, rest = re.match("([^/?]*)(.*)", url, re.S).groups()
        rest = re.sub("([?&])((utm_[a-z]*|ref|fbclid|gclid)=[^&]*(&|$))+", r"\1", rest)
        return re.sub(":(80|443)$", "", re.sub("^www[.]", "", host.lower())) + re.sub("/$", "", re.sub("[?&]+$", "", rest))

    latest, want = {}, {}
    for k, url, html in pages:
        etag = '"' + hashlib.md5(html.encode()).hexdigest() + '"'
        own, before = {"etag": etag, "date": str(k), "content-length": "0"}, latest.get(canonical(url))
        if before and before[1] == etag:
            want[k] = ("resolved", before[0], {"etag": etag, "date": str(k), "content-type": "text/html"}, before[2])
        else:
            want[k] = ("changed" if before else "unresolved", None, own, None)
        latest[canonical(url)] = (k, etag, html)
    got = {r.page_id: (r.outcome, r.source_page_id, r.headers, r.payload) for r in op10_revisit_payloads(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len({w[0] for w in want.values()}) > 1


def test_null_and_wrong_times_leave_a_hot_url_spread(spark):
    times = [*range(400), *[warc.NO_TIME] * 2, -(10**14), 10**15]
    rows = [(i, "hot.example/", t, i % 3 == 0, str(i)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "record_id long, url string, captured long, full boolean, info string")
    assert max(r["count"] for r in warc.stretched(df, 16).groupBy("stretch").count().collect()) <= 30
    earlier = lambda t: max(((c, i) for i, _, c, full, _ in rows if full and c < t), default=None)
    got = {r.record_id: r.found and (r.found.captured, r.found.record_id) for r in warc.latest_earlier(df, 16).collect()}
    assert got == {i: earlier(t) for i, _, t, *_ in rows}
    assert warc.latest_earlier(df.limit(0)).collect() == []


def test_headers_validators_and_payloads(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://x.example/a", 10, 200, h(etag='"v1"', server="s", expires="old"), "body 1"),
        (2, "https://x.example/a/", 20, 304, h(etag='W/"v1"', expires="new", server="no", content_length="0"), None),
        (3, "http://x.example/a", 30, 304, h(etag='"v2"'), None),
        (4, "http://x.example/a", 10, 304, {}, None),
        (5, "http://x.example/a", 40, 304, None, None),
        (6, "http://x.example/a", 35, 404, {}, "gone"),
        (7, "http://y.example/a", None, 304, {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured long, status int, headers map<string,string>, payload string")
    out = {r.record_id: r for r in warc.resolve(df).collect()}
    assert out[2].payload == "body 1" and out[2].headers == h(etag='W/"v1"', expires="new", server="s") and out[2].source_id == 1
    assert (out[3].outcome, out[3].payload) == ("changed", None)
    assert [out[k].outcome for k in (1, 4, 5, 6, 7)] == ["full", "unresolved", "resolved", "full", "unresolved"]
    assert out[6].payload == "gone" and len(out) == 7
    assert warc.resolve(df.limit(0)).collect() == []
