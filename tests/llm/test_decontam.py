import random

from tidemark.llm import decontam as dc


def material():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    vocab = [v for v in vocab for _ in range(1 + 30 // (1 + vocab.index(v)))]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randint(12, 40)).capitalize() + ". " + line(rng.randint(3, 9)) + ".") for i in range(150)]
    docs = []
    for i in range(300):
        t = line(rng.randint(0, 400))
        if i % 5 == 0:
            own = items[i % 150][1].split()
            if i % 10 == 0:
                own[rng.randrange(len(own))] = "changed"
            w = t.split()
            k = rng.randint(0, len(w))
            t = " ".join(w[:k] + own + w[k:])
        docs.append((i, t))
    return items, docs


def test_wand_returns_all_at_or_above_the_threshold():
    items, docs = material()
    for least in (0.1, 0.3, 0.5):
        index = dc.Index(items, dc.Params(score=least))
        for _, t in docs[:80]:
            terms = sorted({index.terms[w] for w in dc.words_of(t) if w in index.terms})
            want = {}
            for k in terms:
                for item, w in zip(index.lists[k][0], index.lists[k][1]):
                    want[item] = want.get(item, 0) + w
            want = {i: round(s, 9) for i, s in want.items() if s >= least - 1e-9}
            assert {i: round(s, 9) for i, s in index.search(terms)} == want


def test_against_scoring_every_window(spark):
    items, docs = material()
    index = dc.Index(items, dc.Params())
    weights = [{} for _ in items]
    for term, code in index.terms.items():
        for item, w in zip(*index.lists[code][:2]):
            weights[item][term] = w
    want = set()
    for d, t in docs:
        words = dc.words_of(t)
        for a in range(0, len(words) + 1, index.half):
            passage = words[a : a + 2 * index.half]
            got = set(passage)
            for k, (i, _) in enumerate(items):
                score = sum(w for term, w in weights[k].items() if term in got)
                if score >= 0.5 - 1e-9:
                    q, ans = index.verified(k, passage)
                    if q >= 0.5 and ans >= 0.5:
                        want.add((d, i))
    rows = [(d, t, "x") for d, t in docs] + [(900, None, "x"), (901, "", "x"), (None, items[3][1], "x")]
    df = dc.with_leaks(spark.createDataFrame(rows, "doc_id long, text string, leak string"), spark.createDataFrame([*items, (500, None), (501, ""), (502, "...")], "item_id long, text string"))
    got = {(r.doc_id, x.item_id) for r in df.collect() for x in r.leaks}
    assert (None, 3) in got
    assert got - {(None, 3)} == want
    assert {d for d, _ in want} >= {i for i in range(0, 300, 5)}


def test_many_shards_and_empty_tables(spark, monkeypatch):
    items, docs = material()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r.doc_id for r in dc.with_leaks(df, bench).where("size(leaks) > 0").collect()}
    monkeypatch.setattr(dc, "SHARD_ITEMS", 60)
    hit = {r.doc_id for r in dc.with_leaks(df, bench).where("size(leaks) > 0").collect()}
    assert hit == whole >= {i for i in range(0, 300, 5)}
    assert dc.keep_clean(df, bench).count() == 300 - len(hit)
    assert dc.keep_clean(df, bench.limit(0)).count() == 300
    assert dc.keep_clean(df.limit(0), bench).count() == 0


def test_shards_find_what_one_index_finds(spark, monkeypatch):
    items, docs = material()
    bench = spark.createDataFrame([*items, (700, "short one. ok."), (-1, items[3][1] + " minus"), (None, "no id here but words enough to be found. none of them.")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (950, "so no id here but words enough to be found. none of them. yes")], "doc_id long, text string")
    told = lambda: {r.doc_id: [(x.item_id, *(round(v, 9) for v in x[1:])) for x in r.leaks] for r in dc.with_leaks(df, bench).collect()}
    whole = told()
    assert [x[0] for x in whole[950]] == [None] and sum(map(len, whole.values())) >= 60
    for size in (40, 12):
        monkeypatch.setattr(dc, "SHARD_ITEMS", size)
        assert told() == whole


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    items, _ = material()
    long = "word " * 400_000 + items[7][1] + " word" * 1000
    rows = [(1, "nothing", "keep", 5), (1, "nothing", "keep", 5), (2, long, "keep", 5), (3, None, "keep", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.with_leaks(df, bench)
    assert out.columns == [*df.columns, "leaks_"]
    assert [x.item_id for r in out.where("doc_id = 2").collect() for x in r.leaks_] == [7]
    assert sorted(map(tuple, dc.keep_clean(df, bench).collect()), key=str) == sorted((r for r in rows if r[0] != 2), key=str)
