import random
import zlib

import numpy as np
from tidemark.llm import toxicity as tx
from tidemark.llm.queries import op4_toxicity


def material(n=700):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 160))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["Nastyword!", "vileword,", "nastyword"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = material()
    extra = [(5000, None), (5001, ""), (5002, "clean " * 4000 + "nastyword vileword nastyword " + "clean " * 50), (None, "no id")]
    spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows] + [(i, t, "en", "s") for i, t in extra], "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in op4_toxicity(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) + 4
    held = [(out[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.95 and len(held) > 100
    assert out[5002].predicted == 1 and out[5001].predicted == 0 and out[5001].score == out[5000].score
    assert all(0 <= r.score <= 1 for r in out.values()) and out[None].held_out is False


def test_gradients():
    rng = np.random.default_rng(0)
    p = tx.train(["a b"], [1]).p
    p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in p.items()}
    x = rng.standard_normal((5, 3, tx.D_WORD + tx.D_CHAR))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    d = rng.standard_normal(3)
    logit, kept = tx.forward(p, x, mask, keep=True)
    g, dx = tx.backward(p, kept, d)
    for name, grad in [*g.items(), ("x", dx)]:
        target = x if name == "x" else p[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in target.shape)
            was = target[at]
            target[at] = was + 1e-3
            up = tx.forward(p, x, mask) @ d
            target[at] = was - 1e-3
            down = tx.forward(p, x, mask) @ d
            target[at] = was
            assert abs((up - down) / 2e-3 - grad[at]) < 1e-2 * max(1, abs(grad[at])), name


def test_scoring_equals_forward_over_all_windows():
    rows = material(300)
    m = tx.train([t for _, t, _ in rows], [y for *_, y in rows], tx.Settings(epochs=1))
    texts = [t.split() for _, t, _ in rows[:40]] + [[]]
    got = tx.Scorer(m).logits(texts)
    for words, g in zip(texts, got):
        best = -np.inf
        for a in tx.windows_of(len(words)):
            w = words[a : a + tx.WINDOW] or ["pad"]
            rows_, tri, counts = tx.word_keys(w)
            x = np.concatenate([m.word[rows_], tx.char_means(m.char, tri, counts)], 1)[:, None]
            mask = np.ones((len(w), 1)) if words else np.zeros((1, 1))
            best = max(best, float(tx.forward(m.p, x, mask)[0]))
        assert abs(best - g) < 1e-3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = tx.fit(docs, labels)
    assert [r.score for r in tx.with_scores(docs, m).collect()] == [0.0, 0.0]
    assert tx.keep_clean(docs.limit(0), m).collect() == []


def test_the_sample_is_of_documents(spark):
    """Labels without a document, without a text or held out take no place in the sample; the task equals plain training."""
    rows = material(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7000, None), (7001, "")] + [(rows[1][0], rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 1) for i in range(7000, 9000)] + [(None, 1), (3, 7)], "doc_id long, toxic int")
    s = tx.Settings(sample=len(rows), epochs=1, least_steps=20)
    m = tx.fit(docs, labels, s)
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    want = tx.train([t for _, t, _ in own], [y for *_, y in own], s)
    assert m.info == want.info and m.info["sample"] == len(own)
    near = lambda a, b: np.allclose(a, b, rtol=1e-3, atol=1e-4)  # noqa: E731  # a worker's matrix products add up in another order
    assert near((m.scale, m.shift), (want.scale, want.shift)) and all(near(m.p[k], want.p[k]) for k in want.p) and near(m.word, want.word)


def test_long_texts_are_learned_from():
    """Texts over any length: windows beyond the strongest ones only score."""
    rng = random.Random(8)
    words = lambda n: [rng.choice(["ab", "cde", "fg", "hijk"]) for _ in range(n)]
    texts, y = [], []
    for i in range(80):
        w = words(3000)
        if i % 2:
            w[rng.randrange(3000)] = "nastyword"
        texts.append(" ".join(w))
        y.append(i % 2)
    m = tx.train(texts, y, tx.Settings(learn=8))
    assert m.constant is None
    got = tx.Scorer(m).scores(["ab cde " * 800, "ab cde " * 800 + "nastyword", "fg"])
    assert got[0] < 0.5 < got[1] and got[2] < 0.5


def test_clashing_columns(spark):
    rows = [(1, "a b", "one", "two"), (1, "a b", "one", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxicity string")
    m = tx.train([], [])
    assert tx.with_scores(docs, m).columns == [*docs.columns, "score_"]
    assert sorted(map(tuple, tx.keep_clean(docs, m).collect())) == rows
