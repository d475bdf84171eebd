import math
import random
import time

import pytest
from tidemark.llm import common
from tidemark.llm import components as cc
from tidemark.llm import lshforest as lf
from tidemark.llm.components import components
from tidemark.llm.queries import op2_ngram_jaccard_join


def material():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(40)]
    rows += [rows[3], rows[3], rows[50], "a b", "a b", "a  b", "", "", None]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return out + [out[5], out[6], (None, out[7][1]), (8, "other text under a repeated id")]


def brute(rows):
    def sh(t):
        w = tuple((t or "").split())
        return {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set()

    sets = [sh(t) for _, t in rows]
    ids = [-(2**63) if d is None else d for d, _ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(ids)
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    null = lambda x: None if x == -(2**63) else x
    return sorted(((rows[i][0], null(root[i]), len(near[i])) for i in range(n)), key=str)


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lf, "BLOCK", block)
    rows = material()
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, doc int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op2_ngram_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = material()
    df = spark.createDataFrame([(d, t, "keep", b"kept", 7, 8) for d, t in rows], "doc_id long, text string, doc string, tie binary, rows int, cnt int")
    out = lf.one_of_each(df).collect()
    groups = {c for _, c, _ in brute(rows)}
    assert {r.doc_id for r in out} == groups and {tuple(r)[2:] for r in out} == {("keep", b"kept", 7, 8)}


def test_recall_over_all_pairs(spark, monkeypatch):
    """Links found over whole documents, against every pair; small blocks make the forest descend and shorten."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (c, n) for d, c, n in brute(rows)}
    monkeypatch.setattr(lf, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.root_doc, r.n_links) for r in lf.near_duplicates(df).collect()}
    assert sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values()) > 0
    assert sum(got[d] == want[d] for d in want) >= 0.999 * len(want)


def test_long_text_and_rows_of_one_id(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (1, " ".join(words[:-10])), (1, "short"), (1, "short"), (None, " ".join(words[5:])), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc, r.root_doc, r.n_links) for r in lf.near_duplicates(df).collect()), key=str)
    null = lambda x: -(2**63) if x is None else x
    assert got == sorted(((null(d), null(c), n) for d, c, n in brute(rows)), key=str)


def test_prefixes_shorten_until_the_recall(spark, monkeypatch):
    """Crowded trees go deeper only as far as the recall of each text allows."""
    monkeypatch.setattr(lf, "BLOCK", 3)
    trees, short, deep = 32, lf.depth(), lf.DEEPEST
    rng = random.Random(2)
    rows = [(d, b"", t, rng.getrandbits(60)) for d in range(12) for t in range(trees)]
    entries = spark.createDataFrame(rows, "doc long, tie binary, key long, tail long")
    nodes = lf.trie_nodes(entries, len(rows), short, deep, 0.8, trees, lf.RECALL).collect()
    for d in range(12):
        wide = sum(r.asked for r in nodes if r.doc == d and r.cnt == 12)
        assert 0 < wide < trees  # every tree is crowded; some stay deep
        log = wide * lf.missed(short, 0.8) + (trees - wide) * lf.missed(short + 1, 0.8)
        assert log <= math.log(1 - lf.RECALL) + 1e-9


def test_empty_table(spark):
    assert lf.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_depth_reaches_the_recall():
    assert 1 - (1 - 0.8 ** lf.depth()) ** lf.TREES >= lf.RECALL > 1 - (1 - 0.8 ** (lf.depth() + 1)) ** lf.TREES


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr("tidemark.llm.components.partitions", lambda s: 10**6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_chain_and_hub(spark):
    """A chain of 10,000 nodes and a hub of 5,000 come to their end."""
    n = 10_000
    chain = spark.range(n - 1).selectExpr("id * 7919 % 10000 as u", "(id + 1) * 7919 % 10000 as v")
    hub = spark.range(1, 5001).selectExpr("20000L as u", "20000 + id as v")
    got = {r.root: r.n for r in components(chain.unionAll(hub)).groupBy("root").agg({"node": "count"}).withColumnRenamed("count(node)", "n").collect()}
    assert got == {0: n, 20_000: 5001}


def test_few_edges_leave_few_files(spark, monkeypatch):
    """Each task of a shuffle leaves three files: a few hundred edges need no task for each shuffle partition."""
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(16)
    for size in (1 << 16, 100):
        monkeypatch.setattr(cc, "EDGES", size)
        out = cc.components(edges)
        assert out.rdd.getNumPartitions() <= 2 * max(1, -(-len(pairs) // size))
        assert {r.node: r.root for r in out.collect()} == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}


def test_among(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_BITS", 1 << 17)
    rows = spark.range(5000).selectExpr("if(id % 7 = 0, null, id) as a", "id % 3 as bits", "cast(id as string) as t")
    keys = spark.createDataFrame([(i, i % 3) for i in range(0, 5000, 50)] + [(None, 0)], "a long, bits long")
    some, others = common.among(rows, keys, ["a", "bits"])
    got = [[tuple(r) for r in df.collect()] for df in (some, others)]
    assert some.columns == others.columns == rows.columns
    assert sorted(got[0] + got[1], key=str) == sorted((tuple(r) for r in rows.collect()), key=str)
    wanted = {(i, i % 3) for i in range(0, 5000, 50) if i % 7} | {(None, 0)}
    assert wanted <= {r[:2] for r in got[0]} and len(got[0]) < 1000
    some, others = common.among(rows, keys.where("false"), ["a", "bits"])
    assert some.count() == 0 and others.count() == 5000


def written(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_without_copies_are_not_shuffled(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.randrange(10**9):x}" for _ in range(3000))) for i in range(300)]
    rows += [(400, rows[0][1]), (7, rows[7][1]), (401, rows[1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    time.sleep(1)
    before = written(spark)
    lf.one_of_each(docs).write.parquet(f"{tmp_path}/out")
    time.sleep(1)
    assert written(spark) - before < 0.5 * sum(len(t) for _, t in rows)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(300))
