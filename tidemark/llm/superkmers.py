"""Routing of equal windows to one bucket by minimisers.

A window is a fixed number of consecutive symbols (words or bytes) of one text.
Its minimiser is the gram of the smallest hash inside it, the leftmost of equal
ones, so equal windows have equal minimisers at equal offsets. Consecutive
windows that share a minimiser travel as one packed string to the bucket of
that minimiser, which therefore sees all equal windows together.

What keeps a bucket bounded:

* Equal packed strings are one, wherever they meet: in a worker's flush, and
  again as a bucket's strings come in. Their rows are told at once.
* The number of buckets follows the number of strings (``BUCKET`` for each).
* Minimisers met ``HOT_LEAST`` times or more in the whole table ("hot") send their
  windows one by one to buckets of the windows' own. A pass over all rows counts
  every string in one of ``CELLS`` cells, so that a count is never too small; the
  hot cells are a bitmap of a fixed size. Both bounds are constants, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, partitions, text_slices

U = np.uint64
#: Symbols handled by one numpy step, and bytes of packed strings held before a flush.
CHUNK, FLUSH = 1 << 19, 24 << 20
#: A minimiser counts as hot from this many packed strings on; strings of a bucket, as planned.
HOT_LEAST, BUCKET = 4096, 80_000
#: Cells in which minimisers are counted, and how many of them a row of counts spans.
CELLS, SPAN = 1 << 26, 1 << 18
TOTAL = -1
#: Place of the minimiser of a window that travels by itself: it is of no use there.
ALONE = -1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive codes; equal runs have equal hashes."""
    base = 0x9E3779B97F4A7C15
    n = len(codes)
    if n < k:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(codes * powers(n, base), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(n - k + 1, pow(base, -1, 2**64)))


def minimisers(grams: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest gram of each w consecutive ones."""
    key = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=U)
    span = 1
    while 2 * span <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    return (key & U(0xFFFFFF)).astype(np.int64)


def runs(codes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First window, last window, minimiser and its place (from the first window) of each super-k-mer of concatenated texts.

    ``ends`` are the texts' ends in ``codes``. Windows that cross texts take no part.
    """
    for a in range(0, max(0, len(codes) - window + 1), CHUNK):
        part = codes[a : a + CHUNK + window - 1]
        grams = rolling(part, gram)
        pos = minimisers(grams, window - gram + 1)
        n = len(pos)
        ok = np.ones(n, bool)
        for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + n + window, "left")]:
            ok[max(0, e - a - window + 1) : max(0, e - a)] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        new = np.r_[True, (pos[at[1:]] != pos[at[:-1]]) | (at[1:] != at[:-1] + 1)]
        first = at[new]
        last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
        yield first + a, last + a, grams[pos[first]], pos[first] - first


class Slice:
    """Texts of one batch as one row of symbols; symbol i is bytes starts[i] to stops[i] of ``joined``."""

    def __init__(self, docs, ties, codes: np.ndarray, ends: np.ndarray, joined: bytes, starts: np.ndarray, stops: np.ndarray):
        self.docs, self.ties, self.codes, self.ends = np.array(docs, np.int64), np.array(ties, np.int64), codes, ends
        self.joined, self.starts, self.stops = joined, starts, stops
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Packed strings of symbols a to b."""
        return [self.joined[p:q] for p, q in zip(self.starts[a].tolist(), self.stops[b - 1].tolist(), strict=True)]


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Words as ASCII white space separates them; a run of them is joined by one space."""
    codes = WordCodes()
    for batch in text_slices(batches, 3 << 20):
        docs, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        words: list[bytes] = []
        ends = []
        for text in batch.column(2):
            words += (text.as_py() or "").encode().split()
            ends.append(len(words))
        code = np.fromiter(map(codes.__getitem__, words), U, len(words))
        joined = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], stop[:-1] + 1])
        yield Slice(docs, ties, code, np.array(ends, np.int64), joined, start, stop)


def byte_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in text_slices(batches, 3 << 20):
        docs, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [(t.as_py() or "").encode() for t in batch.column(2)]
        joined = b"".join(texts)
        at = np.arange(len(joined) + 1)
        yield Slice(docs, ties, np.frombuffer(joined, np.uint8).astype(U) + U(1), np.cumsum([len(t) for t in texts]).astype(np.int64), joined, at[:-1], at[1:])


def packed(docs, ties, starts, places, strings: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, strings), "<i4", len(strings))
    parts = [np.array([len(strings)], "<i8"), *(np.asarray(x).astype(k) for x, k in ((docs, "<i8"), (ties, "<i8"), (starts, "<i4"), (places, "<i4"))), lens]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(p.tobytes() for p in parts), *strings]))


def unpacked(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8, []
    for kind, size in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += size * n
    stop = at + np.cumsum(out[4].astype(np.int64))
    start = stop - out[4]
    return out[0], out[1], out[2], out[3], [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def joined_spans(docs, ties, first, last) -> list[tuple]:
    """Runs of windows, those that touch made one. Rows must be sorted."""
    if not len(docs):
        return []
    d, t, a, b = (np.asarray(x) for x in (docs, ties, first, last))
    new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] > b[:-1] + 1)]
    at = np.flatnonzero(new)
    return list(zip(d[at].tolist(), t[at].tolist(), a[at].tolist(), np.maximum.reduceat(b, at).tolist(), strict=True))


def hot_cells(docs: DataFrame, slices: Callable, window: int, gram: int) -> tuple[int, np.ndarray]:
    """Number of packed strings, and a bitmap of the cells in which ``HOT_LEAST`` or more fall."""
    parts = partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in slices(batches):
            for _, _, marks, _ in runs(s.codes, s.ends, window, gram):
                held.append(cell(marks))
                n += len(marks)
            if n > 2_000_000:
                yield from counted(held)
                held, n = [], 0
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Counts of cells, a row for each span of them."""
        if not held:
            return
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        span = cells // SPAN
        at = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
        zip_ = zstandard.ZstdCompressor(level=3).compress
        blobs = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(cells)], strict=True):
            steps = np.diff(cells[a:b] - span[a] * SPAN, prepend=0)
            blobs.append(zip_(steps.astype("<u4").reshape(-1).view("u1").reshape(-1, 4).T.tobytes() + n[a:b].astype("<u4").view("u1").reshape(-1, 4).T.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(span[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["span", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of each span and the bits of its hot cells, from rows sorted by span."""
        open_, total = None, np.zeros(SPAN, np.int64)
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != open_ and open_ is not None:
                    yield told(open_, total)
                    total[:] = 0
                open_ = k
                steps, n = np.frombuffer(unzip(blob), "u1").reshape(2, 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].astype(np.int64)
                total[np.cumsum(steps)] += n
        if open_ is not None:
            yield told(open_, total)

    def told(k: int, total: np.ndarray) -> pa.RecordBatch:
        hot = total >= HOT_LEAST
        bits = zstandard.ZstdCompressor().compress(np.packbits(hot).tobytes()) if hot.any() else None
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(total.sum())]), pa.array([bits], pa.binary())], names=["span", "n", "bits"])

    spans = docs.mapInArrow(count, "span int, counts binary").repartition(min(parts, CELLS // SPAN), "span").sortWithinPartitions("span").mapInArrow(add, "span int, n long, bits binary")
    total, out = 0, np.zeros(CELLS // 8, np.uint8)
    for k, n, bits in spans.collect():  # CELLS / SPAN rows at most, CELLS / 8 bytes in all
        total += n
        if bits:
            out[k * SPAN // 8 : (k + 1) * SPAN // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(bits)), np.uint8)
    return total, out


def cell(marks: np.ndarray) -> np.ndarray:
    return (marks >> U(20)).astype(np.int64) & (CELLS - 1)


def windows_repeated(
    docs: DataFrame, slices: Callable, count: Callable, window: int, gram: int, resolve: Callable, first_stays: bool
) -> DataFrame:
    """Runs of repeated windows: doc, tie, a, b (first and last window, by its first symbol).

    docs: doc, tie (longs), text. ``count`` says how many windows a packed string has; ``resolve`` gets all packed strings of a
    bucket, each once (docs, ties, starts, minimisers' places, strings) and returns runs.
    ``first_stays``: the first of equal windows isn't a repeat of the others.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    total, bits = hot_cells(docs, slices, window, gram)
    buckets = max(4 * parts, -(-total // BUCKET))
    held_bits = spark.sparkContext.broadcast(bits if bits.any() else None)  # CELLS / 8 bytes at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hot = Rows(count, first_stays), held_bits.value
        for s in slices(batches):
            for first, last, marks, places in runs(s.codes, s.ends, window, gram):
                places = s.starts[first + places] - s.starts[first]  # in bytes from the string's begin
                c = cell(marks)
                single = (hot[c >> 3] >> (7 - (c & 7)) & 1).astype(bool) if hot is not None else np.zeros(len(marks), bool)
                if single.any():  # each window of a hot minimiser by itself
                    alone = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[single].tolist(), last[single].tolist(), strict=True)])
                    rows.add(s, alone, alone, window, None, np.full(len(alone), ALONE))
                    first, last, marks, places = first[~single], last[~single], marks[~single], places[~single]
                rows.add(s, first, last, window, marks, places)
                if rows.held > FLUSH:
                    yield from rows.blobs(buckets)
                    rows = Rows(count, first_stays)
        yield from rows.blobs(buckets)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, Rows(count, first_stays)
        for batch in batches:
            for b, known, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                d, t, a, place, strings = unpacked(blob)
                if known:
                    yield span_rows(d, t, a, place)
                    continue
                if b != bucket:
                    yield from opened(rows)
                    rows = Rows(count, first_stays)
                bucket = b
                rows.take(strings, (d, t, a, np.zeros(len(d), U), place))
                if len(rows.known) > 500_000:
                    yield span_rows(*zip(*sorted(rows.known), strict=True))
                    rows.known.clear()
        yield from opened(rows)

    def opened(rows: Rows) -> Iterator[pa.RecordBatch]:
        if rows.seen:
            strings, (d, t, a, _, place) = rows.distinct()
            found = resolve(d, t, a, place, strings)
            if len(found[0]):
                yield span_rows(*found)
        if rows.known:
            yield span_rows(*zip(*joined_spans(*zip(*sorted(set(rows.known)), strict=True)), strict=True))

    return (
        docs.mapInArrow(send, "bucket int, known boolean, blob binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(receive, "doc long, tie long, a int, b int")
    )


class Rows:
    """Packed strings, each distinct one once, and the runs of windows that others of them repeat."""

    def __init__(self, count: Callable, first_stays: bool):
        self.count, self.first_stays, self.held = count, first_stays, 0
        self.seen: dict[bytes, int] = {}
        self.known: list[tuple] = []
        self.cols: tuple[list, ...] = tuple([] for _ in range(5))  # doc, tie, first window, minimiser, its place

    def add(self, s: Slice, first: np.ndarray, last: np.ndarray, window: int, marks: np.ndarray | None, places: np.ndarray) -> None:
        """Take runs of windows of a slice."""
        strings = s.cut(first, last + window)
        if marks is None:
            marks = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), U, len(strings))
        owner = np.searchsorted(s.ends, first, "right")
        begin = s.begins[owner]
        self.take(strings, (s.docs[owner], s.ties[owner], first - begin, marks, places))

    def take(self, strings: list[bytes], cols: tuple[np.ndarray, ...]) -> None:
        """Strings and the five columns of their rows."""
        seen, n = self.seen, len(self.cols[0])
        at = np.fromiter((seen.setdefault(x, n + k) for k, x in enumerate(strings)), np.int64, len(strings))
        new = at == np.arange(n, n + len(at))
        again = np.flatnonzero(~new)
        if len(again):  # rows are kept for first ones only, so that copies take no memory
            place = np.cumsum(new) - 1 + n
            at = np.where(at >= n, place[np.maximum(at - n, 0)], at)
            for k in np.flatnonzero(new & (place != np.arange(n, n + len(at)))).tolist():
                seen[strings[k]] = int(place[k])
        for col, v in zip(self.cols, cols, strict=True):
            col += v[new].tolist()
        if len(again):
            for k, row, d, t, a in zip(at[again].tolist(), again.tolist(), *(c[again].tolist() for c in cols[:3]), strict=True):
                self.repeat(k, (d, t, a), self.count(strings[row]) - 1)
        self.held += sum(map(len, strings)) + 200 * int(new.sum()) + 100 * len(again)

    def repeat(self, k: int, mine: tuple[int, int, int], more: int) -> None:
        """The string of row k, of ``more`` windows beside the first, at another place."""
        doc, tie, first = self.cols[:3]
        theirs = doc[k], tie[k], first[k]
        if not self.first_stays:
            self.known += [(*mine, mine[2] + more), (*theirs, theirs[2] + more)]
        elif mine > theirs:
            self.known.append((*mine, mine[2] + more))
        elif mine < theirs:
            self.known.append((*theirs, theirs[2] + more))
            doc[k], tie[k], first[k] = mine

    def distinct(self) -> tuple[list[bytes], list[np.ndarray]]:
        kinds = (np.int64, np.int64, np.int64, U, np.int64)
        return list(self.seen), [np.array(c, k) for c, k in zip(self.cols, kinds, strict=True)]

    def blobs(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.seen:
            return
        strings, (doc, tie, start, mark, place) = self.distinct()
        bucket = (mark % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
        out = []
        for x, y in zip(cuts, cuts[1:]):
            k = order[x:y]
            out.append((int(bucket[k[0]]), False, packed(doc[k], tie[k], start[k], place[k], [strings[i] for i in k.tolist()])))
        if self.known:
            d, t, a, b = zip(*joined_spans(*zip(*sorted(set(self.known)), strict=True)), strict=True)
            out.append((out[0][0], True, packed(d, t, a, b, [b""] * len(d))))
        for x in range(0, len(out), 256):
            b, known, blob = zip(*out[x : x + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known, pa.bool_()), pa.array(blob, pa.binary())], names=["bucket", "known", "blob"])


def span_rows(d, t, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(d, np.int64)), pa.array(np.asarray(t, np.int64)), pa.array(np.asarray(a, np.int32)), pa.array(np.asarray(b, np.int32))], names=["doc", "tie", "a", "b"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie, text of documents: what tells rows apart, nulls made values.

    The tie is a 64-bit hash of the text where some id repeats in the table, else 0:
    it only ever tells rows of one id apart.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repeats = docs.select(doc).groupBy("doc").count().where("count > 1").limit(1).count()
    return docs.select(doc, (F.xxhash64(text) if repeats else F.lit(0).cast("long")).alias("tie"), text.alias("text"))


def with_spans(own: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, spans (array of first and last window) of every row of keyed documents."""
    by_doc = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return own.join(by_doc, ["doc", "tie"], "left").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "spans")


def covered(spans: list | None, n: int, window: int) -> np.ndarray:
    """Which of n symbols a span's windows cover."""
    steps = np.zeros(n + 1, np.int32)
    for s in spans or ():
        steps[s["a"]] += 1
        steps[s["b"] + window] -= 1
    return np.cumsum(steps[:n]) > 0
