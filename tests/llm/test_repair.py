import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from tidemark.llm import repair
from tidemark.llm.queries import op11_conversation_repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain(rows):
    """One conversation by cheapest-first search over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        k = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else ""
        if not k and re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            k = "truncated"
        seen.add((role, text))
        kinds.append(k)
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and SHAPE.match(roles):
            break
        tail = (i, roles[-1:] if len(roles) > 1 or roles != "s" else "S")
        if tail in done:
            continue
        done.add(tail)
        more = [(cost + 2, audit + "I", i, roles + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more.append((cost + 3, audit + "D", i + 1, roles, lines))
            if kinds[i] not in ("blank", "duplicate"):
                extra = kinds[i] == "truncated"
                more.append((cost + extra, audit + "K", i + 1, roles + (role[0] if role else "?"), (*lines, f"{role}:{text}")))
                more += [(cost + 2 + extra, audit + "R", i + 1, roles + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for m in more:
            if re.match(r"(s?(ua)*u?)\Z", m[3]):
                heapq.heappush(heap, m)
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rng, n, longest=9):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Fine!", "", " \t", None, "So ", "Why?  \n", f"text {t}.", f"other {t}", "a:b\nc."])
            rows.append((rng.choice([c, c, c, None]) if c % 20 == 0 else c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("long", [repair.LONG, 3])
def test_query_and_sql_against_search(spark, tmp_path, monkeypatch, long):
    monkeypatch.setattr(repair, "CHUNK", 2)
    rng = random.Random(8)
    rows = conversations(rng, 120)
    rows += [(900, t % 40, "user", rng.choice(["Same.", "Same.", f"n {t}"])) for t in range(300)]  # many equal turns, long
    rows += [(901, 7, "assistant", "copies")] * 50
    rows += [(902, None, None, None), (-5, 2**40, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cnt int")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    made = {}
    for conv, *row in plain_damage(rows):
        made.setdefault(conv, []).append(tuple(row))
    want = {(c, *(plain(made[c]) if c in made else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))) for c in {r[0] for r in rows}}
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "partitions", lambda s, least=8: 60 if long == 3 else 8)
    monkeypatch.setattr(repair.repair, "__defaults__", (long,))
    got = {tuple(r) for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum("I" in w[7] for w in want) > 5 and sum("R" in w[7] for w in want) > 5
    if long != 3:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert set(con.execute(repair.SQL).fetchall()) == want


def test_every_short_conversation():
    kinds = [("system", "x."), ("user", "x."), ("user", "y"), ("assistant", "z."), ("tool", "v"), ("user", "")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            rows = [(i, *r) for i, r in enumerate(rows)]
            assert repair.repaired(rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, cnt int, is_large int"
    assert repair.repaired_table(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 1, "user", "Hello.", "a", 1, 2), (1, 2, "assistant", "Yes.", "b", 1, 2)]
    (row,) = repair.repair(spark.createDataFrame(rows, schema)).collect()
    assert row.audit == "KK" and row.cost == 0
