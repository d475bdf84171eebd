import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import substring, suffixes
from tidemark.llm import superkmers as sk
from tidemark.llm.queries import op3_superkmer_substring_dedup, op7_suffix_array_dedup

SCHEMA = "doc_id long, text string, spans string, a int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            k = rng.randint(0, len(words))
            cut = rng.randint(0, 20)
            words[k:k] = passage[cut : cut + rng.randint(15, 50)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)]  # copies
    rows += [(7, rows[7][1]), (8, "another text of a repeated id " * 9), (200, "it " * 400), (201, ""), (202, None), (None, rows[3][1]), (None, None)]
    rows += [(300 + i, " ".join(passage) + f" end {i}") for i in range(40)]
    rng.shuffle(rows)
    return rows


def removed_words(rows, window=20):
    keyed = [(-(2**63) if d is None else d, t or "") for d, t in rows]
    first = {}
    for d, t in keyed:
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            place = (d, i)
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, place), place)
    out = []
    for (d, t), (doc, _) in zip(keyed, rows):
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = True
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(left).hexdigest()))
    return out


def removed_bytes(rows, window=200):
    from collections import Counter

    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        left = bytes(x for x, g in zip(r, gone) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((doc, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def written(spark, tmp_path, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_words_against_brute_force(spark, tmp_path):
    rows = [r for r in corpus() if r[0] != 8]
    same(op3_superkmer_substring_dedup(spark, written(spark, tmp_path, rows)).collect(), removed_words(rows))


def test_bytes_against_brute_force(spark, tmp_path):
    rows = corpus()
    same(op7_suffix_array_dedup(spark, written(spark, tmp_path, rows)).collect(), removed_bytes(rows))


def test_hot_minimisers_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sk, "HOT_LEAST", 9)
    rows = [r for r in corpus() if r[0] != 8]
    where = written(spark, tmp_path, rows)
    same(op3_superkmer_substring_dedup(spark, where).collect(), removed_words(rows))
    same(op7_suffix_array_dedup(spark, where).collect(), removed_bytes(rows))


def test_empty_table(spark, tmp_path):
    where = written(spark, tmp_path, [])
    assert op3_superkmer_substring_dedup(spark, where).collect() == []
    assert op7_suffix_array_dedup(spark, where).collect() == []


def test_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int64)
    at = np.array([0, 3, 6])
    assert substring.same_as_first(ids, at, np.zeros(3, np.uint64), 3).tolist() == [-1, -1, 0]


@pytest.mark.parametrize("piece", [5, 64, 1 << 17])
def test_transform_against_sorted_suffixes(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    places = [rng.randint(0, len(s)) for s in strings]
    index = suffixes.Index(strings, places, suffixes.Files(f"file://{tmp_path}"))
    # symbols before the place, then an end, then what follows the place
    rows = sorted(([*(c + 1 for c in s[i:p]), 0, *s[p:]], i == 0) for s, p in zip(strings, places) for i in range(p + 1))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    true = [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    true = [c - (0 in a[0][:c]) for c, a in zip(true, rows)]  # the end is no symbol
    assert index.lcp.tolist()[1:] == true
    assert sorted(index.bwt.tolist()) == sorted([0] * 60 + index.text.tolist())
    want = set()
    for k, (s, p) in enumerate(zip(strings, places)):
        for i in range(p + 1):
            same = [1 for t, q in zip(strings, places) if q >= p - i and s[i : i + 5] == t[q - p + i :][:5] and len(s[i : i + 5]) == 5]
            if i <= p < i + 5 and len(same) > 1:
                want.add((k, i))
    got = {(int(a), int(b)) for x, y in index.repeated(5) for a, b in zip(x, y)}
    assert want <= got and all(i + 5 <= p for k, i in got - want for p in [places[k]])


def test_long_texts_one_partition_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Texts over one step of symbols, in one partition, all under few ids."""
    monkeypatch.setattr(sk, "BUCKET", 500)
    rng = random.Random(11)
    base = [f"w{rng.randrange(20_000)}" for _ in range(70_000)]
    long = " ".join(base)
    rows = [(1, long), (1, " ".join(base[30_000:30_400]) + " end"), (2, "begin " + " ".join(base[-200:])), (None, long[:3000]), (None, long[:2999]), (2, "short"), (2, "short")]
    monkeypatch.setattr(sk, "CHUNK", 1 << 12)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same(op7_suffix_array_dedup(spark, str(tmp_path)).collect(), removed_bytes(rows))
    # equal ids come in the order of a hash of their texts, which the plain version doesn't know
    rows = [(10 * k, t) for k, (_, t) in enumerate(rows)] + [(0, long)]
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    same(op3_superkmer_substring_dedup(spark, f"{tmp_path}/b").collect(), removed_words(rows))


def test_text_of_more_than_a_step_of_symbols(spark):
    rng = random.Random(12)
    unit = "".join(rng.choice("abcdefghij ") for _ in range(300))
    text = "".join(rng.choice("abcdefghij ") for _ in range(sk.CHUNK + 5000)) + unit
    df = spark.createDataFrame([(1, text), (2, unit)], "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    assert out == {1: (len(text), 300, 1), 2: (300, 300, 1)}


def test_counts_are_never_too_small(spark, monkeypatch):
    """A minimiser that every slice holds a few times is found hot."""
    monkeypatch.setattr(sk, "HOT_LEAST", 60)
    rows = [(i, f"{i} " * 30 + "alpha beta gamma " * 7 + f"x{i} " * 30) for i in range(100)]
    own = sk.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
    total, bits = sk.hot_cells(own, sk.word_slices, 20, 3)
    plain = {}
    for _, t in rows:
        s = next(sk.word_slices(iter([pa.RecordBatch.from_pydict({"a": [1], "b": [0], "c": [t]})])))
        for _, _, marks, _ in sk.runs(s.codes, s.ends, 20, 3):
            for c in sk.cell(marks).tolist():
                plain[c] = plain.get(c, 0) + 1
    assert total == sum(plain.values())
    assert set(np.flatnonzero(np.unpackbits(bits)).tolist()) == {c for c, n in plain.items() if n >= 60} != set()
