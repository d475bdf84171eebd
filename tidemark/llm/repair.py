"""Repair of conversations by the cheapest edits, found in a graph of tight arcs.

A node is a place between two rows of a conversation and what the repaired roles are
so far (nothing, a system turn, a question, an answer). Arcs delete, keep or rerole
the next row, or insert a turn. Forward and backward minimum costs tell which arcs lie
on a cheapest path; walking those, the least letter that the frontier's nodes offer is
taken at each step, so the audit is the least of all cheapest ones.

A conversation is repaired whole in one task up to ``LONG`` rows or a quarter of a
partition's share. The fewer than four for each partition that are longer are dealt by
ranges of their order to chunks: a chunk's costs are a matrix over the four states, the
matrices give every chunk its forward and backward costs, a chunk is walked from each
state that a cheapest path can enter it in, and one pass over the walks in order picks
those that meet. Only that pass, which holds no texts (SHA-256 runs on), is one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, joined, partitions, stored

#: Rows of a conversation that is repaired in one piece at any rate; rows and characters of a chunk of a longer one.
LONG, CHUNK, CHUNK_CHARS = 4096, 4096, 4 << 20
#: Costs of the edits, and of keeping or reroling a truncated row.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

START, SYSTEM, QUESTION, ANSWER = range(4)
#: State and role after a turn that is inserted or given another role.
NEXT = (QUESTION, QUESTION, ANSWER, QUESTION)
TURN = ("user", "user", "assistant", "user")
#: State that keeping a role of this initial leads to, where it may be kept.
KEEP = {("s", START): SYSTEM, ("u", START): QUESTION, ("u", SYSTEM): QUESTION, ("u", ANSWER): QUESTION, ("a", QUESTION): ANSWER}
#: Cost of what has to be inserted at the end.
END = [0, 2 * INSERT, INSERT, 0]
FINISH = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
WHITE = " \t\n\v\f\r"

OUT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: A row as the graph sees it: initial of its role, whether it is truncated, how many rows of it have to be deleted (0: it may stay).
Step = tuple[str, bool, int]


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


def inserted(costs: list[int]) -> list[int]:
    """Costs of the states of one place, once turns may have been inserted there."""
    c = list(costs)
    c[QUESTION] = min(c[QUESTION], INSERT + min(c[START], c[SYSTEM], c[ANSWER]))
    c[ANSWER] = min(c[ANSWER], c[QUESTION] + INSERT)
    return c


def arcs(step: Step, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of each edit of a row, least letter first."""
    role, short, gone = step
    if gone:
        return [("D" * gone, DELETE * gone, state)]
    out = [("D", DELETE, state)]
    if (role, state) in KEEP:
        out.append(("K", TRUNCATED * short, KEEP[role, state]))
    return [*out, ("R", REROLE + TRUNCATED * short, NEXT[state])]


def forward(steps: list[Step], start: list[int]) -> list[list[int]]:
    """Minimum costs of the states before each step, and after the last."""
    out = [inserted(start)]
    for step in steps:
        now = [FAR] * 4
        for state, cost in enumerate(out[-1]):
            for _, more, then in arcs(step, state) if cost < FAR else ():
                now[then] = min(now[then], cost + more)
        out.append(inserted(now))
    return out


def backward(steps: list[Step], end: list[int]) -> list[list[int]]:
    """Minimum costs from the states before each step, and after the last, to the end."""

    def before(costs: list[int]) -> list[int]:
        c = list(costs)
        for state in (QUESTION, ANSWER, QUESTION, START, SYSTEM):
            c[state] = min(c[state], c[NEXT[state]] + INSERT)
        return c

    out = [before(end)]
    for step in reversed(steps):
        out.append(before([min(cost + out[-1][then] for _, cost, then in arcs(step, s)) for s in range(4)]))
    return out[::-1]


def walk(steps: list[Step], ahead: list[list[int]], behind: list[list[int]], best: int, state: int) -> tuple[list[tuple[str, int]], int]:
    """Letters, each with the state it was taken in, of the least cheapest path through all steps, and the state after it.

    A place's insertions come before its row's edit, so those after the last step are left to what follows.
    """
    out = []
    for i, step in enumerate(steps):
        frontier, done = {state}, False
        while not done:
            tight = []
            for s in frontier:
                so_far = ahead[i][s]
                tight += [(letters, i + 1, t, s) for letters, cost, t in arcs(step, s) if so_far + cost + behind[i + 1][t] == best]
                if so_far + INSERT + behind[i][NEXT[s]] == best:
                    tight.append(("I", i, NEXT[s], s))
            least = min(t[0] for t in tight)
            chosen = [t for t in tight if t[0] == least]
            out.append((least, chosen[0][3]))
            frontier, done = {t[2] for t in chosen}, chosen[0][1] > i
        (state,) = frontier  # a letter leads from a state to one other
    return out, state


def applied(letters: list[tuple[str, int]], rows: Iterable[tuple[str, str]]) -> list[str]:
    """``role:text`` of what the edits leave; ``rows`` has a row for each letter but insertions (runs of D stand for one row)."""
    out, rows = [], iter(rows)
    for letter, state in letters:
        if letter == "I":
            out.append(f"{TURN[state]}:")
            continue
        role, text = next(rows)
        if letter in "KR":
            out.append(f"{role if letter == 'K' else TURN[state]}:{text}")
    return out


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows (turn, role, text) in order."""
    seen: set = set()
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    steps: list[Step] = []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if kind:
            count[kind] += 1
        steps.append((initial(role), kind == "truncated", int(kind in ("blank", "duplicate"))))
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(steps, steps[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    ahead, behind = forward(steps, [0, FAR, FAR, FAR]), backward(steps, END)
    best = behind[0][START]
    letters, state = walk(steps, ahead, behind, best, START)
    lines = applied(letters, [r[1:] for r in rows]) + finished(state)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    audit = "".join(x for x, _ in letters) + FINISH[state]
    return gaps, *count.values(), illegal, best, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def finished(state: int) -> list[str]:
    return [f"{r}:" for r in ("user", "assistant")[2 - len(FINISH[state]) :]]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded length, each in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        of = None
        for batch in batches:
            done = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != of and held:
                    done.append((of, *repaired(held)))
                    held = []
                of = conv
                held.append(tuple(row))
            if done:
                yield _rows(done, OUT)
        if held:
            yield _rows([(of, *repaired(held))], OUT)

    order = ["conv", "turn", "role", "text"]
    return rows.select(*order).repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions(*order).mapInArrow(work, OUT)


HEAD = "conv long, part int, seq int, initials string, faults string, turns array<long>, gone array<long>, roles array<string>, texts array<string>"
COSTS = "conv long, part int, seq int, ahead array<long>, behind array<long>, best long"
WALKED = "conv long, part int, seq int, head string, tail string, turns array<long>, counts array<long>, best long, entry array<long>, leave array<long>, audits array<string>, pieces array<string>"


def chunk_steps(initials: str, faults: str, gone: list[int]) -> list[Step]:
    """Two steps for each row of a chunk: itself, where it may stay, and its copies that have to go."""
    out: list[Step] = []
    for i, f, n in zip(initials, faults, gone, strict=True):
        if f != "D":
            out.append((i, f == "T", 0))
        if n:
            out.append((i, False, n))
    return out


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in order, in chunks; equal rows are one with a number of copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, of, held, chars = TaskContext.get().partitionId(), 0, None, [], 0

        def told() -> pa.RecordBatch:
            faults, gone = "", []
            for _, _, text, n, first in held:
                last = text.rstrip(WHITE)[-1:]
                faults += "D" if not last or not first else "T" if last not in ".!?" else "-"
                gone.append(n - (faults[-1] != "D"))
            cols = list(zip(*held))
            return _rows([(of, part, seq, "".join(map(initial, cols[1])), faults, list(cols[0]), gone, list(cols[1]), list(cols[2]))], HEAD)

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv != of or len(held) >= CHUNK or chars > CHUNK_CHARS):
                    yield told()
                    seq, held, chars = seq + 1, [], 0
                of = conv
                held.append(tuple(row))
                chars += len(row[2])
        if held:
            yield told()

    each = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    said = F.md5(F.to_json(F.struct("conv", "role", F.md5(F.encode("text", "UTF-8")).alias("t"))))
    order = F.struct(F.col("turn").isNotNull().alias("x"), "turn")
    each = stored(each.withColumn("said", said))
    facts = each.groupBy("said").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("cnt"))
    each = joined(each, facts, "said", each.count()).withColumn("first", order.eqNullSafe(F.col("first")))
    keys = ["conv", "turn", "role", "text"]
    dealt = each.select(*keys, "n", "first").repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(work, HEAD))


def _long(rows: DataFrame) -> DataFrame:
    chunks = _chunks(rows)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, seq, initials, faults, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                steps = chunk_steps(initials, faults, gone)
                yield _rows([(conv, part, seq, [x for s in range(4) for x in forward(steps, [0 if t == s else FAR for t in range(4)])[-1]])], "conv long, part int, seq int, m array<long>")

    def costs(group: pd.DataFrame) -> pd.DataFrame:
        """Forward costs before and backward costs after each chunk of one conversation, from its matrices."""
        group = group.sort_values(["part", "seq"])
        ms = [[list(m[4 * s : 4 * s + 4]) for s in range(4)] for m in group["m"]]
        ahead, behind = [inserted([0, FAR, FAR, FAR])], [backward([], END)[0]]
        for m in ms[:-1]:
            ahead.append([min(ahead[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
        for m in ms[:0:-1]:
            behind.append([min(m[s][t] + behind[-1][t] for t in range(4)) for s in range(4)])
        best = min(min(ms[0][START][t] + behind[-1][t] for t in range(4)), FAR)
        clip = lambda v: [int(min(x, FAR)) for x in v]
        return pd.DataFrame({"conv": group["conv"], "part": group["part"], "seq": group["seq"], "ahead": [clip(v) for v in ahead], "behind": [clip(v) for v in behind[::-1]], "best": int(best)})

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps = chunk_steps(row["initials"], row["faults"], row["gone"])
                ahead, behind = forward(steps, row["ahead"]), backward(steps, row["behind"])
                edited = [(r, t) for r, t, f, n in zip(row["roles"], row["texts"], row["faults"], row["gone"], strict=True) for _ in range((f != "D") + (n > 0))]
                entry, leave, audits, pieces = [], [], [], []
                for s in range(4):
                    if ahead[0][s] + behind[0][s] == row["best"]:
                        letters, end = walk(steps, ahead, behind, row["best"], s)
                        entry.append(s)
                        leave.append(end)
                        audits.append("".join(x for x, _ in letters))
                        pieces.append("".join(x + "\n" for x in applied(letters, edited)))
                blank = [not t.rstrip(WHITE) for t in row["texts"]]
                every = [n + (f != "D") for f, n in zip(row["faults"], row["gone"], strict=True)]
                i = row["initials"]
                counts = [
                    sum(n for n, b in zip(every, blank, strict=True) if b), sum(n for n, b in zip(row["gone"], blank, strict=True) if not b), row["faults"].count("T"),
                    sum(a + b not in LEGAL for a, b in zip(i, i[1:])) + sum(n - 1 for n in every),
                ]
                turns = sorted({t for t in row["turns"] if t is not None})
                yield _rows([(row["conv"], row["part"], row["seq"], i[0], i[-1], [turns[0], turns[-1], len(turns)] if turns else [], counts, row["best"], entry, leave, audits, pieces)], WALKED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks in order: each chunk's from the state in which the one before ended."""
        of = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != of:
                    if of is not None:
                        yield ended(of, held)
                    of, held = row["conv"], {"state": START, "audit": [], "sha": hashlib.sha256(), "any": False, "counts": [0] * 4, "tail": "", "turns": [None, None, 0], "best": row["best"]}
                k = row["entry"].index(held["state"])
                held["state"] = row["leave"][k]
                held["audit"].append(row["audits"][k])
                feed(held, row["pieces"][k][:-1] if row["pieces"][k] else None)
                held["counts"] = [a + b for a, b in zip(held["counts"], row["counts"], strict=True)]
                held["counts"][3] += bool(held["tail"]) and held["tail"] + row["head"] not in LEGAL
                held["tail"] = row["tail"]
                if row["turns"]:
                    low, high, n = row["turns"]
                    was = held["turns"]
                    held["turns"] = [low if was[0] is None else was[0], high, was[2] + n - (was[1] == low)]
        if of is not None:
            yield ended(of, held)

    def feed(held: dict, piece: str | None) -> None:
        if piece is not None:
            held["sha"].update((("\n" if held["any"] else "") + piece).encode())
            held["any"] = True

    def ended(conv: int, held: dict) -> pa.RecordBatch:
        for line in finished(held["state"]):
            feed(held, line)
        low, high, n = held["turns"]
        return _rows([(conv, high - low + 1 - n if n else 0, *held["counts"], held["best"], "".join(held["audit"]) + FINISH[held["state"]], held["sha"].hexdigest())], OUT)

    parts = partitions(rows.sparkSession)
    ms = chunks.select("conv", "part", "seq", "initials", "faults", "gone").mapInArrow(matrix, "conv long, part int, seq int, m array<long>")
    told = ms.groupBy("conv").applyInPandas(costs, COSTS)
    walked = chunks.join(told, ["conv", "part", "seq"]).mapInArrow(walks, WALKED)
    return walked.repartition(parts, "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(meet, OUT)


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """conv (``NULL_ID`` for null) and ``OUT`` for each conversation of ``rows`` (conv_id, turn, role, text).

    Rows go by turn, nulls first, then by role and text, so that equal turns have an
    order and repeated rows are duplicates of one. Null role or text is one space:
    such a role has no initial that may stay, such a text is blank. An empty role is
    no role either. Other columns aren't looked at; an empty table has no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("cnt"))
    total = rows.count()
    most = max(long, total // (4 * partitions(rows.sparkSession)))
    large = sizes.where(F.col("cnt") > most).select("conv", F.lit(True).alias("is_large"))
    if not large.take(1):
        return _whole(rows)
    told = rows.join(F.broadcast(large), "conv", "left")
    return _whole(told.where("is_large is null")).unionByName(_long(told.where("is_large").drop("is_large")))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault that the checksum of ``conv_id:turn`` picks: 0 drops a row, 1 empties it, 2 takes its
    sentence ends, 3 repeats it, 4 makes its role user. A null id or turn counts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def repaired_table(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of ``OUT`` for every conv_id of ``rows``, after damage; one without a row left has zeros and empty strings."""
    every = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv")).distinct()
    out = every.join(repair(damaged(rows)), "conv", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return out.select(F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), sha)


#: The same rows in DuckDB: the checksum by its table of 256, the least cheapest path to each state row by row.
SQL = """
WITH RECURSIVE
bits AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
         FROM (SELECT range AS b FROM range(256))),
keys AS (
  SELECT *, list_transform(string_split(key, ''), lambda s: CAST(ascii(s) AS BIGINT)) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
picked AS (
  SELECT keys.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM keys, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM picked),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS initial
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS kind,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM ordered),
measured AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
         count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
         count(*) AS n
  FROM faulty GROUP BY conv_id),
puts(s, t, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', 'user:\n'), (0, 3, 4, 'II', 'user:\nassistant:\n'),
         (1, 1, 0, '', ''), (1, 2, 2, 'I', 'user:\n'), (1, 3, 4, 'II', 'user:\nassistant:\n'),
         (2, 2, 0, '', ''), (2, 3, 2, 'I', 'assistant:\n'), (3, 3, 0, '', ''), (3, 2, 2, 'I', 'user:\n')),
moves(t, v, cost, letter, initial, role) AS (
  VALUES (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL),
         (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL),
         (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (3, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant')),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM measured
  UNION ALL
  SELECT conv_id, i, s, cost, audit, lines FROM (
    SELECT p.conv_id, f.i, m.v AS s, p.cost + x.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.kind = 'truncated' THEN 1 ELSE 0 END AS cost,
           p.audit || x.letters || m.letter AS audit,
           p.lines || x.lines || CASE m.letter WHEN 'D' THEN '' ELSE coalesce(m.role, f.role) || ':' || f.text || '\n' END AS lines,
           row_number() OVER (PARTITION BY p.conv_id, m.v ORDER BY p.cost + x.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.kind = 'truncated' THEN 1 ELSE 0 END,
                              p.audit || x.letters || m.letter) AS place
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    JOIN puts x ON x.s = p.s JOIN moves m ON m.t = x.t
    WHERE (m.letter = 'D' OR f.kind NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.initial = f.initial)) WHERE place = 1),
ends AS (
  SELECT p.conv_id, p.cost + x.cost AS cost, p.audit || x.letters AS audit, p.lines || x.lines AS lines
  FROM paths p JOIN measured m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.i JOIN puts x ON x.s = p.s AND x.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + x.cost, p.audit || x.letters) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN measured m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
