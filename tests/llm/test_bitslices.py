import random
import re

import numpy as np
import pytest
import xxhash
from tidemark.llm import bitslices
from tidemark.llm.queries import op13_bit_sliced_simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << p for p in range(64) if 2 * sum(x >> p & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    key = lambda d: -(2**63) if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(d, least[r], key=key)
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


def texts(rng, n):
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "x").split(" ")
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab).title() for _ in range(rng.choice([0, 1, 2, 3, 5, 40, 120, 400]))]
        rows.append((i, rng.choice([" ", " ", "\x0b"]).join(words)))
    return rows


ODD = [(None, "null id"), (None, "NULL  id"), (3, "repeated id"), (3, None), (7001, ""), (7002, "\t\n"), (7003, "İ ſ K"), (7004, "word " * 70_000), (7005, "word " * 70_003), (7006, "a\x1fb\x85c d")]


def test_query_against_all_pairs(spark, tmp_path):
    rows = texts(random.Random(5), 500) + ODD
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_bit_sliced_simhash(spark, str(tmp_path)).collect()), key=str)
    want = plain_components(rows)
    assert got == sorted(want, key=str)
    assert sum(d != c for d, _, c in want) > 100


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, np.uint64)
    fps = base[rng.integers(0, 30, 900)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * rng.integers(0, 2, 900).astype(np.uint64)
    starts = np.array([0, 1, 3, 64, 65, 129, 700, 899])
    bucket = np.searchsorted(starts, np.arange(900), "right")
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    got = [(int(i), int(j)) for a, b in bitslices.close_pairs(fps, starts, radius) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_crowded_buckets_are_dealt_again(spark):
    rng = random.Random(3)
    start = rng.getrandbits(64)
    fps = {start}
    while len(fps) < 3000:
        f = rng.choice(sorted(fps)) if rng.random() < 0.1 else start
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def classes(crowd):
        label = {f: f for f in signed}

        def find(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for u, v in bitslices.links(df, len(signed), crowd=crowd).collect():
            label[find(u)] = find(v)
        groups = {}
        for f in signed:
            groups.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in groups.values()}

    assert classes(20) == classes(10**9)


def test_masks_cover():
    steps = bitslices.masks(2, 5)
    for _ in range(300):
        differ = sum(1 << random.randrange(64) for _ in range(2))
        for now in steps:
            assert any(not m & differ for m in now)
    assert max(64 - m.bit_count() for m in steps[-1]) <= 13


def test_one_of_each_and_clashing_columns(spark):
    rows = [(1, "one two three four five", "a", 1), (2, "one two three four five", "b", 2), (3, "quite other words stand here now", "c", 3), (3, None, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, lone int")
    out = bitslices.one_of_each(df)
    assert out.columns == df.columns and sorted(r.lone for r in out.collect()) == [1, 3, 4]
    assert bitslices.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
