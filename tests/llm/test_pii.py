import hashlib
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import pii
from tidemark.llm.queries import op9_pii_sanitisation


def by_regex(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text("019.@a-+ (é%\n", max_size=40))
def test_base_spans_as_the_patterns_say(text):
    assert pii.base_spans(text) == by_regex(text)


def test_examples():
    text = "Mail a.b@c.de, 10.0.0.255 but 1.2.3.256; 4111 1111 1111 1111 or +49 (30) 123-4567; 0001.2.3.4"
    assert pii.base_spans(text) == by_regex(text)
    assert pii.redacted(text, pii.base_spans(text)).startswith("Mail [EMAIL], [IP] but 1.2.3.256; [CARD] or [PHONE]")


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.base_spans(text)
    assert time.time() - began < 10


def test_revealing_terms(spark):
    rows = [(i, f"common words number{'x' * i} here the codename Nightjar writes to agent@secret.example about thing{'q' * i}", 1) for i in range(8)]
    rows += [(100 + i, f"common words here about other matters {i}", 1) for i in range(60)]
    rows += [(200 + i, "copies all the same Rareword for copy@secret.example", 1) for i in range(9)]  # one context
    rows += [(300, "", 1), (301, None, 1), (None, "null@id.example", 1), (302, "", 1), (302, "", 1)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    assert "Nightjar" not in out[0].pii.clean and "[EMAIL]" in out[0].pii.clean and "common" in out[0].pii.clean
    assert "term:" in out[3].pii.spans and out[3].pii.n_email == 1
    assert "Rareword" in out[200].pii.clean and out[200].pii.base.startswith("email:")
    assert out[100].pii.clean == rows[8][1] and out[100].pii.spans == ""
    assert out[None].pii.n_email == 1 and out[301].pii.base == "" and out[301].spans == 1


def test_rare_entities(spark):
    rows = [(i, f"plain words number {i} about other matters with agents and codenames") for i in range(3000)]
    rows += [(4000, "the codename Nightjar writes to agent@rare.example about matters")]
    rows += [(4002, " ".join(f"Heron wrote {'k' * (i + 4)} for long@rare.example again {'p' * (i + 4)} and {'filler words ' * 40}" for i in range(6)))]
    rows += [(5000, "also Heron alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.pii for r in pii.sanitise(df).collect()}
    assert "Nightjar" not in out[4000].clean and "matters" in out[4000].clean  # an entity met once
    assert "Heron" not in out[4002].clean  # six contexts in one document
    assert out[5000].clean == "also  alone" and out[5000].spans == "term:5:10"  # a text without the entity
    assert all(out[i].clean == rows[i][1] for i in range(3000))


def test_empty_table(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_terms(texts, alpha=0.8, z=1.96):
    """Disclosing (entity, term) by counting everything in lists."""
    n = len(texts)
    words = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for t in texts]
    own = []
    for t in texts:
        found = []
        for kind, a, b in by_regex(t):
            v = t[a:b].lower() if kind == "email" else re.sub("[^0-9]", "", t[a:b]) if kind != "ip" else t[a:b]
            left = re.findall(r"[^\W\d_]{4,}", t[max(0, a - 320) : a].lower())[-8:]
            right = re.findall(r"[^\W\d_]{4,}", t[b : b + 320].lower())[:8]
            found.append(((kind, v), tuple(left + right)))
        own.append(found)
    out = {}
    for e in {e for f in own for e, _ in f}:
        n_entity = sum(any(x == e for x, _ in f) for f in own)
        content = math.log2(n / n_entity)
        for term in {w for f in own for x, c in f if x == e for w in c}:
            both = sum(any(x == e and term in c for x, c in f) for f in own)
            ctx = len({c for f in own for x, c in f if x == e and term in c})
            share = min(1, both / sum(term in w for w in words))
            m = ctx / share
            low = (share + z * z / (2 * m) - z * math.sqrt(share * (1 - share) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if content > 0 and math.log2(n * low / n_entity) >= alpha * content:
                out.setdefault(term, set()).add(e)
    return out


def test_query_against_plain_counts(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(700)]
    rows = []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            k = rng.randrange(25)
            w.insert(rng.randint(0, len(w)), f"{vocab[k]}secret{'x' * (k % 5)} u{k}@mail.example" if k % 2 else f"10.0.{k}.7 code{vocab[k]}")
        rows.append((i, " ".join(w)))
    rows += [(None, "mail u1@mail.example"), (3, rows[3][1]), (4, "a text of a repeated id"), (1600, None), (1601, "")]
    texts = [t or "" for _, t in rows]
    spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op9_pii_sanitisation(spark, str(tmp_path)).collect()), key=str)
    terms = plain_terms(texts)
    assert len(terms) >= 5
    want = []
    for d, t in rows:
        base = by_regex(t or "")
        taken = [(a, b) for _, a, b in base]
        more = [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{4,}", t or "") if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b in taken)]
        told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        n = [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        want.append((d, *n, hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
    assert got == sorted(want, key=str) and any("term:" in r[-1] for r in got)


def test_clashing_columns(spark):
    rows = [(1, "write to a@b.example", "one", "two", "three", 4), (1, "write to a@b.example", "one", "two", "three", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, terms string, doc string, tie int")
    out = pii.sanitise(df)
    assert out.columns == [*df.columns, "pii_"] and [tuple(r)[:6] for r in out.collect()] == rows


def written(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_without_terms_are_not_shuffled(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(2000)) + " some plain words") for i in range(300)]
    rows += [(900 + i, f"the codename Nightjar{'x' * (i % 2)} writes to agent@secret.example about thing{'q' * i}") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    time.sleep(1)
    before = written(spark)
    op9_pii_sanitisation(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    time.sleep(1)
    assert written(spark) - before < 0.3 * sum(len(t) for _, t in rows)
    out = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(out) == len(rows) and "term:" in out[900].spans and out[0].spans == ""
