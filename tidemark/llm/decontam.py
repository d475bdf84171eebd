"""Benchmark decontamination by BM25 retrieval over an index of test items.

Items are the documents of an inverted index whose postings are cut into blocks
with their largest impact. Every passage of every training text is a query:
passages are windows of twice the longest item, overlapping by half, so each
planted item lies whole in one. Impacts are divided by the score of an item
against itself, so one threshold holds for all items. A vectorised pass over the
lists of rare terms adds up what each window could reach for each item; windows
that could reach the threshold run block-max WAND, which returns every item at
or above it. A hit counts if the item's question (all but its last sentence)
and its answer (the last sentence) both overlap the passage.

Only the items travel to the workers, in shards of at most ``SHARD_CHARS``
characters; more items mean more shards, never a larger broadcast. Number, mean
length, document frequencies and window are those of all items in every shard, so
the shards find what one index would.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh

SHARD_CHARS, SHARD_ITEMS = 8 << 20, 4096
BLOCK = 16
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Words of a shingle, for questions from ``LONG`` words on and for shorter ones.
SHINGLE, SHORT, LONG = 5, 3, 20


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's own score that a passage has to reach.
    score: float = 0.5
    #: Shares of the question's words that shared shingles cover, and of the answer's words.
    question: float = 0.5
    answer: float = 0.5


def norm(word: str) -> str:
    return word.lower().strip(EDGE)


def words_of(text: str) -> list[str]:
    return [w for w in map(norm, text.split()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """All sentences but the last, and the last; a single sentence is cut after three quarters."""
    parts = [words_of(p) for p in re.split(r"(?<=[.?!])\s+|\n", text.strip())]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    own = parts[0] if parts else []
    at = max(1, len(own) * 3 // 4)
    return own[:at], own[at:]


def shingle_size(words: list[str]) -> int:
    return min(len(words), SHINGLE if len(words) >= LONG else SHORT)


@dataclass(frozen=True)
class Stats:
    """Items with words, their words, the most words of one, and in how many items each term stands."""

    n: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """Inverted index of one shard of items; ``stats`` are those of all items, if there are others."""

    def __init__(self, items: list[tuple[int, str]], params: Params, stats: Stats | None = None):
        self.params = params
        kept = [(i, t) for i, t in items if words_of(t)]
        self.ids = [i for i, _ in kept]  # a null id stays null
        bags = [Counter(words_of(t)) for _, t in kept]
        self.qa = [question_answer(t) for _, t in kept]
        if stats is None:
            sizes = [sum(b.values()) for b in bags]
            stats = Stats(len(bags), sum(sizes), max(sizes, default=32), Counter(t for b in bags for t in b))
        self.window = 2 * stats.longest
        self.half = self.window // 2
        mean, total_n = stats.words / max(1, stats.n), stats.n
        n, k1, b = len(bags), params.k1, params.b
        df = {t: stats.df[t] for b_ in bags for t in b_}
        idf = {t: math.log(1 + (total_n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.terms = {t: k + 1 for k, t in enumerate(df)}  # 0: not in any item
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        spare: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        self.rest = np.zeros(n)
        for k, bag in enumerate(bags):
            size = sum(bag.values())
            raw = {t: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean)) for t, f in bag.items()}
            total = sum(raw.values())
            for t, w in raw.items():
                postings[self.terms[t]].append((k, w / total))
            for t in sorted(raw, key=lambda t: (-df[t], t)):  # common terms first: up to 0.4 of the threshold they are left out of the first pass
                w = raw[t] / total
                if self.rest[k] + w <= 0.4 * params.score:
                    self.rest[k] += w
                else:
                    spare[self.terms[t]].append((k, w))
        self.lists = [([i for i, _ in p], [w for _, w in p], max((w for _, w in p), default=0.0), [max(w for _, w in p[a : a + BLOCK]) for a in range(0, len(p), BLOCK)]) for p in postings]
        count = np.array([len(p) for p in spare], np.int64)
        self.count, self.begin = count, np.cumsum(count) - count
        self.item = np.array([i for p in spare for i, _ in p], np.int64)
        self.weight = np.array([w for p in spare for _, w in p])

    def may_hit(self, codes: np.ndarray) -> np.ndarray:
        """Windows (by number of their first half) whose bound reaches the threshold for some item."""
        n, blocks = len(self.ids), -(-len(codes) // self.half)
        at = np.flatnonzero(self.count[codes])
        if not len(at):
            return np.zeros(0, np.int64)
        reps = self.count[codes[at]]
        where = np.repeat(self.begin[codes[at]], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        key = np.repeat(at // self.half, reps) * n + self.item[where]
        if blocks * n <= 4 * len(key) + 1_000_000:
            used, sums = None, np.bincount(key, self.weight[where], (blocks + 1) * n).reshape(blocks + 1, n)
            reach = sums[:-1] + sums[1:] + self.rest
            return np.flatnonzero((reach >= self.params.score - 1e-9).any(1))
        used, back = np.unique(key, return_inverse=True)
        sums = np.bincount(back, self.weight[where])
        own = np.concatenate([used, used[used >= n] - n])  # a half counts for its window and the one before
        total, back = np.unique(own, return_inverse=True)
        reach = np.bincount(back, np.concatenate([sums, sums[used >= n]])) + self.rest[total % n]
        return np.unique(total[reach >= self.params.score - 1e-9] // n)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score for a set of terms reaches the threshold."""
        least = self.params.score - 1e-9
        cursors = [[0, *self.lists[t]] for t in terms if self.lists[t][0]]  # place, items, impacts, largest, of blocks
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == doc:
                pivot += 1
            upper, until = 0.0, None
            for c in cursors[: pivot + 1]:  # the block that holds doc, without moving the cursor
                items, k = c[1], c[0] // BLOCK
                while k < len(c[4]) and items[min(len(items), (k + 1) * BLOCK) - 1] < doc:
                    k += 1
                if k < len(c[4]):
                    upper += c[4][k]
                    end = items[min(len(items), (k + 1) * BLOCK) - 1]
                    until = end if until is None else min(until, end)
            if upper >= least:
                if cursors[0][1][cursors[0][0]] == doc:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += c[2][c[0]]
                        c[0] += 1
                    if score >= least:
                        out.append((doc, score))
                else:
                    for c in cursors[:pivot]:
                        self._skip(c, doc)
            else:
                beyond = (until if until is not None else doc) + 1
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][1][cursors[pivot + 1][0]])
                beyond = max(beyond, doc + 1)
                for c in cursors[: pivot + 1]:
                    self._skip(c, beyond)
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out

    @staticmethod
    def _skip(c: list, doc: int) -> None:
        """Move a cursor to the first item from ``doc`` on, block by block."""
        items, at = c[1], c[0]
        while at + BLOCK <= len(items) and items[at + BLOCK - 1] < doc:
            at += BLOCK
        while at < len(items) and items[at] < doc:
            at += 1
        c[0] = at

    def verified(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the item's question and answer that a passage holds."""
        question, answer = self.qa[item]
        n = shingle_size(question)
        there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        shared = {k for i in range(len(question) - n + 1) if tuple(question[i : i + n]) in there for k in range(i, i + n)}
        held = set(words)
        return len(shared) / len(question), sum(w in held for w in answer) / len(answer) if answer else 1.0


class Codes(dict):
    """Term of a raw word, and its normal form."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        w = norm(word)
        got = self[word] = self.terms.get(w, 0) if w else -1
        return got


def leaks(index: Index, codes: Codes, texts: list[str]) -> list[list[tuple]]:
    """(item_id, score, question, answer) of the items found in each text, by item_id."""
    if not index.ids:
        return [[] for _ in texts]
    out: list[list[tuple]] = [[] for _ in texts]
    half = index.half
    parts, starts, at = [], [], 0
    for t in texts:  # every text begins a half window of its own, and ends in an empty one
        raw = t.split()
        c = np.fromiter(map(codes.__getitem__, raw), np.int64, len(raw))
        c = c[c >= 0]
        pad = -len(c) % half + half
        starts.append(at // half)
        parts += [c, np.zeros(pad, np.int64)]
        at += len(c) + pad
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    hits = index.may_hit(flat)
    owner = np.searchsorted(starts, hits, "right") - 1
    best: dict[tuple[int, int], tuple] = {}
    split: dict[int, list[str]] = {}
    p = index.params
    for w, o in zip(hits.tolist(), owner.tolist(), strict=True):
        a = w * half
        terms = np.unique(flat[a : a + 2 * half])
        found = index.search(terms[terms > 0].tolist())
        if not found:
            continue
        if o not in split:
            split = {o: words_of(texts[o])}
        b = (w - starts[o]) * half
        passage = split[o][b : b + 2 * half]
        for item, score in found:
            q, ans = index.verified(item, passage)
            if q >= p.question and ans >= p.answer:
                best[o, item] = max(best.get((o, item), (0,)), (score, q, ans))
    for (o, item), got in best.items():
        out[o].append((index.ids[item], *got))
    return [sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])) for x in out]


def shards(benchmark: DataFrame) -> int:
    n, chars = benchmark.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))


LEAK = "array<struct<item_id: long, score: double, question: double, answer: double>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, params: Params | None = None, out: str = "leaks") -> DataFrame:
    """``docs`` with a last column, an array of the test items found in each row's whole text.

    The column is called ``out``, with underscores appended if ``docs`` has that
    name. Null and empty texts hold none; so do items without words. Repeated rows
    get the same answer; an item without an id is found under a null one.
    """
    (out,) = fresh(docs, out)
    params = params or Params()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = shards(items)
    found = F.array().cast(LEAK)
    own_stats = _stats(items, n) if n > 1 else lambda k: None
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # one shard: about SHARD_ITEMS rows
        held = docs.sparkSession.sparkContext.broadcast((sorted(map(tuple, own), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), own_stats(k)))
        found = F.concat(found, _lookup(held, params)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    if n > 1:
        found = F.array_sort(found, lambda a, b: F.when(a["item_id"].eqNullSafe(b["item_id"]), F.when(a < b, -1).when(a > b, 1).otherwise(0)).when(a["item_id"].isNull() | (a["item_id"] < b["item_id"]), -1).otherwise(1))
    return docs.withColumn(out, found)


def _stats(items: DataFrame, n: int) -> Callable[[int], Stats]:
    """Stats of all items for a shard, with the frequencies of its own terms."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for t in {*words, ""} if words else ():  # "" stands for the item
                    for col, v in zip(cols, (shard, t, 0 if t else len(words)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["shard", "term", "size"])

    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long").alias("shard")
    met = items.select(shard, "text").mapInArrow(terms, "shard long, term string, size long")
    counted = checkpointed(met.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")))
    count, words, longest = counted.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("longest"), F.lit(32))).first()
    df = counted.groupBy("term").agg(F.sum("n").alias("df"))
    return lambda k: Stats(count, words, longest, dict(map(tuple, counted.where((F.col("shard") == k) & (F.col("term") != "")).join(df, "term").select("term", "df").collect())))


def _lookup(held, params: Params):
    @F.pandas_udf(LEAK)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(held.value[0], params, held.value[1])
        codes = Codes(index.terms)
        for batch in batches:
            texts = list(batch)
            got: list = []
            a = 0
            while a < len(texts):  # about 2 MB at a time
                b, size = a, 0
                while b < len(texts) and (b == a or size < 2 << 20):
                    size += len(texts[b])
                    b += 1
                got += leaks(index, codes, texts[a:b])
                a = b
            yield pd.Series([[dict(zip(("item_id", "score", "question", "answer"), x, strict=True)) for x in own] for own in got], dtype=object)

    return look


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """Rows that hold no test item."""
    (name,) = fresh(docs, "leaks")
    return with_leaks(docs, benchmark, params, name).where(F.size(name) == 0).drop(name)
