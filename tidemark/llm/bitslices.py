"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most two bits agree on one of three parts of
their bits, so they share a bucket of that part. A bucket of more than ``CROWD``
different fingerprints is dealt again: what two of them may still differ in is
once more split into three, so buckets are bounded after five steps whatever the
data. Inside a bucket the bits stand in vertical planes of 64 fingerprints a
word; carry-save counters add the differing bits of 64 pairs at once, and a word
is abandoned as soon as all its pairs differ in too many.

A bucket returns a spanning star of each of its linked groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, checkpointed, fresh, joined, partitions, text_slices
from tidemark.llm.components import components

#: Differing bits of a link, words of a shingle, seed of the hash.
RADIUS, SHINGLE, SEED = 2, 3, 42
#: Different fingerprints of a bucket from which it is dealt again; steps after which fewer bits are free than that takes.
CROWD, STEPS = 8192, 5
#: Pairs of a fingerprint and a word of 64 others that are compared at once; rows of a task held before comparing.
PAIRS, HELD = 1 << 19, 1 << 18
#: Planes added between two looks at which words may go.
LOOK = 8
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined_ = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    wide = min(SHINGLE, len(words))
    start, stop = start[: len(words) - wide + 1].tolist(), stop[wide - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, len(start), 1 << 15):
        spans = zip(start[a : a + (1 << 15)], stop[a : a + (1 << 15)], strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined_[p:q], SEED) for p, q in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc, fp (long, the fingerprint's bits) of every row; null text has no words, a null doc_id is ``NULL_ID``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint((t.as_py() or "").encode()) for t in batch.column(1)], U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit p of fingerprint i at bit i % 64 of word i // 64 of plane p."""
    padded = np.zeros(-(-len(fps) // 64) * 64, U)
    padded[: len(fps)] = fps
    out = [np.packbits((padded >> U(p)).astype(np.uint8) & 1, bitorder="little").view("<u8") for p in range(64)]
    return np.array(out, U).reshape(64, -1)


def too_far(ones: np.ndarray, twos: np.ndarray, more: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (bits ``ones`` and ``twos``, ``more`` from four on) is over the radius."""
    return (more | twos | ones, more | twos, more | (twos & ones), more)[radius]


def close_pairs(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one bucket that differ in at most ``radius`` (0 to 3) bits.

    Buckets lie side by side in ``fps``, each from one of ``starts`` to the next.
    """
    n = len(fps)
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    at = np.arange(n)
    first, last = (at + 1) // 64, (ends - 1) // 64
    count = np.where(ends > at + 1, last - first + 1, 0)
    bits = planes(fps)
    total = np.cumsum(count)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        q = np.repeat(at[a:b], count[a:b])
        word = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        # lanes of a word that lie after the fingerprint itself and in its bucket
        low, high = np.maximum(q + 1 - word * 64, 0), np.minimum(ends[q] - word * 64, 64)
        live = (ALL << low.astype(U)) & (ALL >> (64 - high).astype(U))
        ones, twos, more = (np.zeros(len(q), U) for _ in range(3))
        for p in range(64):
            differs = bits[p][word] ^ (U(0) - ((fps[q] >> U(p)) & U(1)))
            carry = ones & differs
            ones ^= differs
            more |= twos & carry
            twos ^= carry
            if p % LOOK == LOOK - 1:
                live &= ~too_far(ones, twos, more, radius)
                kept = np.flatnonzero(live)
                q, word, live, ones, twos, more = (x[kept] for x in (q, word, live, ones, twos, more))
        if len(q):
            lanes = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            yield q[row], word[row] * 64 + lane
        a = b


def linked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the classes in ``label`` (item to a smaller or the same item) once each pair is one class."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def stars(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that join the linked fingerprints of each bucket, from rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    label = np.arange(len(fps))
    for i, j in close_pairs(fps.view(U), starts, radius):
        label = linked(label, i, j)
    out = np.flatnonzero(label != np.arange(len(fps)))
    return fps[out], fps[label[out]]


def masks(radius: int, steps: int) -> list[list[int]]:
    """For each step the masks of bits that agree in a bucket; mask i of a step has the next step's masks (radius + 1) i and following."""
    out = [[0]]
    for _ in range(steps):
        now = []
        for m in out[-1]:
            free = [p for p in range(64) if not m >> p & 1]
            now += [m | sum(1 << p for p in free[k :: radius + 1]) for k in range(radius + 1)]
        out.append(now)
    return out[1:]


def _edges(rows: DataFrame, radius: int) -> DataFrame:
    """u, v for fingerprints ``fp`` that share a ``key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
            n += batch.num_rows
            if n >= HELD:
                both = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(both[0], both[0, -1], "left"))
                yield told(both[:, :cut])
                held, n = [both[:, cut:]], both.shape[1] - cut
        if n:
            yield told(np.concatenate(held, axis=1))

    def told(both: np.ndarray) -> pa.RecordBatch:
        u, v = stars(both[0], np.ascontiguousarray(both[1]), radius) if both.shape[1] else (both[1], both[1])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    parts = partitions(rows.sparkSession)
    return rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(work, "u long, v long")


def links(fps: DataFrame, total: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the ``total`` different fingerprints ``fp``."""
    left, out = fps.select("fp", F.lit(0).alias("g")), None
    for step, now in enumerate(masks(radius, STEPS)):
        signed = F.lit(list(np.array(now, U).view(np.int64).tolist()))
        child = lambda k: ((radius + 1) * F.col("g") + k).cast("int")
        each = left.select("fp", F.explode(F.array(*(child(k) for k in range(radius + 1)))).alias("g"))
        each = each.withColumn("key", F.xxhash64("g", F.col("fp").bitwiseAND(F.element_at(signed, F.col("g") + 1))))
        met = checkpointed(joined(each, each.groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"), "key", (radius + 1) * total))
        last = step == STEPS - 1
        found = _edges(met if last else met.where(F.col("cnt") <= crowd), radius)
        out = found if out is None else out.unionAll(found)
        left = met.where(F.col("cnt") > crowd).select("fp", "g")
        if last or not left.take(1):
            return out
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc (``NULL_ID`` for null), fp (long), component: the smallest doc reachable over links, for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` (0 to 3) bits link, those
    of texts without words (0) like any other. Rows that repeat an id are rows of
    their own; a null doc_id sorts before all others. Other columns aren't carried.
    """
    rows = checkpointed(with_fingerprints(docs))
    per = checkpointed(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("cnt")))
    n = per.count()
    if not n:
        return rows.withColumn("component", F.col("doc"))
    roots = checkpointed(components(links(per, n, radius, crowd)).distinct())
    inside = per.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    least = inside.groupBy("root").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("cnt"))
    inside = joined(inside, least, "root", n).select(F.col("fp").alias("of"), "lowest")
    facts = per.join(inside, F.col("fp") == F.col("of"), "left").select("fp", "cnt", F.coalesce("lowest", "least").alias("component"))
    return joined(rows, checkpointed(facts), "fp", rows.count()).select("doc", "fp", "component")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a long's bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component; other rows go. All columns stay."""
    doc, lone = fresh(docs, "doc", "lone")
    keep = near_duplicates(docs).where("doc = component").select(F.col("doc").alias(doc)).distinct().withColumn(lone, F.lit(True))
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return rows.join(keep, doc, "left_semi").select(*docs.columns)
