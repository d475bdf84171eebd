import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import collocations as co
from tidemark.llm.queries import op12_phrase_collocations


def plain(rows, least=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p for p in f if len(p[1]) > 1 and f[p] >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = []
    for lang in n:
        own = []
        mine = [p for g, p in cand if g == lang]
        for p in mine:
            a = f[lang, p]
            if any(len(q) > len(p) and 100 * f[lang, q] >= 100 * a and inside(p, q) for q in mine):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            own.append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
        own.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(own[:top])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "É", "x\x00y", "un", "b", "\U0001f600", "Ünd", "q\x85r", *(f"rare{i}" for i in range(200))]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 2, 30, 200])):
            words += ["new", "york", "city", "hall"][: rng.randint(1, 4)] if rng.random() < 0.1 else [vocab[min(int(rng.expovariate(0.3)), len(vocab) - 1)]]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r\n"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([text, text, text, None, "a a a a a a a"])))
    return rows


def test_query_and_sql_against_plain_counts(spark, tmp_path):
    rows = corpus(1, 700) + [("xx", ""), ("xx", "One word. only")] + [("long", "to be or not " * 40_000)]
    df = spark.createDataFrame([(i % 9, t, g, 1.0) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n double")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows)
    got = sorted(tuple(r) for r in op12_phrase_collocations(spark, str(tmp_path)).collect())
    assert got == want and len(want) > 30
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.SQL})").fetchall()) == want


def test_any_shards_and_small_tops(spark):
    rows = corpus(2, 200)
    df = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    for size, least, longest, top in ((50, 5, 5, 7), (1, 3, 3, 2000), (10**9, 2, 4, 40)):
        assert sorted(tuple(r) for r in co.collocations(df.repartition(5), least, longest, top, size).collect()) == plain(rows, least, longest, top)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_large_products(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "a", 1, 4 * 10**14), ("en", "b", 1, 10**14), ("en", "a b", 2, 9 * 10**13)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    monkeypatch.setattr(co, "counted", lambda *_: (counts, totals))
    (row,) = co.collocations(counts).collect()
    assert row.score == 1000 * 9 * 10**13 * 9 * 10**14 // (4 * 10**14 * 10**14)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5))
def test_phrase_counts(seq, longest):
    seq = np.array(seq, np.int32)
    want = Counter(tuple(seq[i : i + k].tolist()) for k in range(1, longest + 1) for i in range(len(seq) - k + 1))
    want = {p: n for p, n in want.items() if 0 not in p}
    got = {tuple(seq[a : a + k].tolist()): c for k, at, n in co.phrase_counts(seq, 1, longest) for a, c in zip(at.tolist(), n.tolist(), strict=True)}
    assert got == want


@given(st.text("ab \n", max_size=40), st.integers(1, 9))
def test_cut(text, size):
    parts = list(co.cut(text.encode(), size))
    assert b"".join(parts) == text.encode() and all(p.endswith(b"\n") for p in parts[:-1])


def written(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_rare_phrases_of_frequent_pairs_take_few_bytes(spark):
    """All pairs of 60 words are frequent; the longer phrases are rare, but for those of four words that stay."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"word{rng.randrange(60)}" for _ in range(1000)) + " four words that stay") for _ in range(300)]
    df = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(3)
    time.sleep(1)
    before = written(spark)
    counts, _ = co.counted(df, least=40, size=50_000)
    got = {r.phrase: r.f for r in counts.where("size > 2").collect()}
    time.sleep(1)
    assert got["four words that stay"] == 300 and set(got) == {"four words that", "words that stay", "four words that stay"}
    assert written(spark) - before < 25 * 300_000


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 50)
    rows = corpus(3, 200)
    df = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(df.repartition(3), 4, 5, 50, 300).collect()) == plain(rows, 4, 5, 50)


@given(st.lists(st.tuples(*[st.integers(0, 2**62)] * 3), max_size=30))
def test_packed_columns(rows):
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    assert (co._unpack(co._pack(*columns), 3) == columns).all()
