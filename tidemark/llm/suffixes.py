"""Repeated byte strings, found with a collection Burrows-Wheeler transform.

Windows of ``WINDOW`` bytes reach the bucket of their minimiser in packed
strings (see ``superkmers``). Strings that share no side of their minimiser with
another can't repeat and go at once. The rest of a bucket is indexed column by
column. As equal windows hold their minimiser at the same place, a string is read
from there: what follows the minimiser's begin is its first suffix, and each
round inserts one more symbol of every string, leftwards, into the transform of
the collection and updates the common prefixes of the rows around each insertion.
Rows of the finished index whose common prefix with a neighbour reaches
``WINDOW`` are repeated windows.

The transform and the prefixes are sequential files in the folder that all
executors share: a round reads them front to back to place the symbols, and once
more to write them anew with the insertions, ``PIECE`` rows at a time. A batch has
about ``BATCH`` symbols, or one minimiser's strings, whose number is bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from tidemark.llm import superkmers as sk
from tidemark.llm.common import shared_folder

WINDOW, GRAM = 200, 24
BATCH, PIECE = 400_000, 1 << 18
#: Longer than any common prefix.
FAR = np.int16(2**15 - 1)


class Files:
    """Sequential files of one task, in a folder of their own that goes with it."""

    def __init__(self, where: str):
        self.fs, path = pafs.FileSystem.from_uri(where)
        self.path = f"{path}/transform-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def read(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete_file(f"{self.path}/{name}")

    def close(self) -> None:
        self.fs.delete_dir(self.path)


class Index:
    """Burrows-Wheeler transform and common prefixes of the suffixes that begin up to ``places`` of strings.

    Suffixes compare by their symbols before the string's place, then by what
    follows it; one that comes to its place earlier is the smaller.
    """

    def __init__(self, strings: list[bytes], places: list[int], files: Files):
        self.files = files
        self.places = np.array(places, np.int64)
        ends = [s[p:] for s, p in zip(strings, places, strict=True)]
        self.first = np.array(sorted(range(len(ends)), key=ends.__getitem__), np.int64)  # strings by what follows their places
        raw = np.frombuffer(b"".join(s[:p] for s, p in zip(strings, places, strict=True)), np.uint8)
        self.stop = np.cumsum(self.places)
        used = np.unique(raw)
        code = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        code[used] = np.arange(1, len(used) + 1)
        self.symbols, self.text = len(used) + 1, code[raw]
        common = [0, *(shared(ends[a], ends[b]) for a, b in zip(self.first.tolist(), self.first[1:].tolist()))]
        self._build(np.minimum(common[: len(ends)], FAR - 1).astype(np.int16))

    def _before(self, who: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix that has j symbols before its place; 0 where the string is used up."""
        more = self.places[who] > j
        return np.where(more, self.text[np.where(more, self.stop[who] - j - 1, 0)], 0).astype(self.text.dtype) if len(self.text) else np.zeros(len(who), self.text.dtype)

    def _build(self, common: np.ndarray) -> None:
        m = self.size = len(self.places)
        who, at = self.first, np.arange(m)  # rows of the suffixes that grow, ascending
        symbols = self._before(who, 0)
        self.round = 0
        self._write(iter([(symbols, common)]))
        total = np.bincount(symbols, minlength=self.symbols)
        rounds = int(self.places.max(initial=0))
        for j in range(1, rounds + 1):
            grow = self.places[who] >= j
            who, at = who[grow], at[grow]
            sym, rank, up, down = self._scanned(at)
            row = m + (np.cumsum(total) - total)[sym] + rank - total[0]
            order = np.argsort(row, kind="stable")
            who, at = who[order], row[order]
            new = self._before(who, j)
            self._write(self._merged(at, new, up[order], down[order]))
            self.size += len(at)
            total += np.bincount(new, minlength=self.symbols)
        self.bwt, self.lcp = (np.concatenate(x) for x in zip(*self._read(), strict=True)) if m else (symbols, common)
        self.files.drop(*self._names())

    def _names(self) -> tuple[str, str]:
        return f"symbols-{self.round}", f"prefixes-{self.round}"

    def _write(self, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """The sequences of the next round; those of the last one go."""
        old, first = self._names(), self.round == 0
        named = [f"{n.split('-')[0]}-{self.round + 1}" for n in old]
        with self.files.write(named[0]) as b, self.files.write(named[1]) as p:
            for x, y in pieces:
                b.write(x.tobytes())
                p.write(y.tobytes())
        self.round += 1
        if not first:
            self.files.drop(*old)

    def _read(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k = self.text.dtype.itemsize
        names = self._names()
        with self.files.read(names[0]) as b, self.files.read(names[1]) as p:
            for a in range(0, self.size, PIECE):
                n = min(PIECE, self.size - a)
                yield np.frombuffer(b.read(k * n), self.text.dtype), np.frombuffer(p.read(2 * n), np.int16)

    def _scanned(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows ``at``: symbol, equal symbols before, and common prefixes with the last and next row of the same symbol, grown by it.

        The former is 0 and the latter -1 where there is no such row.
        """
        sym, rank = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        up, down = np.zeros(len(at), np.int16), np.full(len(at), -1, np.int16)
        k = self.symbols
        base, since = np.zeros(k, np.int64), np.full(k, FAR)  # of each symbol: rows so far, least prefix since the last of them
        waits, ahead = np.full(k, -1), np.full(k, FAR)  # which of ``at`` waits for the next such row, least prefix since
        lo = x0 = 0
        for p, lcp in self._read():
            x1 = x0 + int(np.searchsorted(at[x0:], lo + len(p)))
            x = at[x0:x1] - lo
            order = np.argsort(p, kind="stable")
            count = np.bincount(p, minlength=k)
            start = np.cumsum(count) - count
            place = np.empty(len(p), np.int32)
            place[order] = np.arange(len(p), dtype=np.int32)
            mine, s = place[x], p[x].astype(np.int64)
            sym[x0:x1], rank[x0:x1] = s, base[s] + mine - start[s]
            guarded = np.append(lcp, FAR)
            has, follows = mine > start[s], mine + 1 < (start + count)[s]
            u, d = np.zeros(len(x), np.int16), np.full(len(x), -1, np.int16)
            u[has] = 1 + least(guarded, order[mine[has] - 1] + 1, x[has] + 1)
            d[follows] = 1 + least(guarded, x[follows] + 1, order[mine[follows] + 1] + 1)
            if len(p) < self.size:  # rows of the same symbol may stand in other pieces
                low = np.minimum.accumulate(lcp)  # least up to each row, and from each row on
                high = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
                met = np.flatnonzero((waits >= 0) & (count > 0))
                down[waits[met]] = 1 + np.minimum(ahead[met], low[order[start[met]]])
                waits[met] = -1
                ahead = np.minimum(ahead, low[-1])
                far = ~has & (base[s] > 0)
                u[far] = 1 + np.minimum(since[s[far]], low[x[far]])
                last = np.flatnonzero(~follows)
                waits[s[last]], ahead[s[last]] = x0 + last, high[x[last] + 1]
                some = np.flatnonzero(count)
                since = np.minimum(since, low[-1])
                since[some] = high[order[(start + count)[some] - 1] + 1]
            up[x0:x1], down[x0:x1] = u, d
            base += count
            lo, x0 = lo + len(p), x1
        return sym, rank, up, down

    def _merged(self, row: np.ndarray, new: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The two sequences with insertions at ``row`` (ascending), and the prefixes after them."""
        old, after = self._read(), row + 1
        b, lcp = next(old)
        total = self.size + len(row)
        for a in range(0, total, PIECE):
            n = min(PIECE, total - a)
            i, k = np.searchsorted(row, (a, a + n))
            mine = row[i:k] - a
            stays = np.ones(n, bool)
            stays[mine] = False
            parts, need = [], n - len(mine)
            while need:
                if not len(b):
                    b, lcp = next(old)
                parts.append((b[:need], lcp[:need]))
                need, b, lcp = need - len(parts[-1][0]), b[need:], lcp[need:]
            out, out_lcp = np.empty(n, self.text.dtype), np.empty(n, np.int16)
            for target, own in zip((out, out_lcp), zip(*parts, strict=True), strict=False):
                target[stays] = own[0] if len(own) == 1 else np.concatenate(own)
            f = np.arange(*np.searchsorted(after, (a, a + n)))
            f = f[down[f] >= 0]
            out_lcp[after[f] - a] = down[f]
            out[mine], out_lcp[mine] = new[i:k], up[i:k]
            yield out, out_lcp

    def repeated(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Strings and places in them of suffixes that share ``length`` symbols with another."""
        hit = self.lcp >= length
        hit[:-1] |= hit[1:].copy()
        order = np.argsort(self.bwt, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        done = int(np.count_nonzero(self.bwt == 0))
        m = len(self.places)
        who, at = self.first, np.arange(m)
        for j in range(int(self.places.max(initial=0)) + 1):
            if j:
                grow = self.places[who] >= j
                who, at = who[grow], m + place[at[grow]] - done
            found = who[hit[at]]
            if len(found):
                yield found, self.places[found] - j


def least(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of a[lo:hi] for each pair; hi > lo."""
    if not len(lo):
        return np.zeros(0, a.dtype)
    order = np.argsort(-lo, kind="stable")  # falling starts: nothing is read between two pairs
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[::2], pairs[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), a.dtype)
    out[order] = np.minimum.reduceat(a, pairs)[::2]
    return out


def candidates(strings: list[bytes], places: np.ndarray, window: int, gram: int) -> tuple[list[int], np.ndarray]:
    """Strings that may hold a window of another, and the number of each one's minimiser.

    Equal windows agree around their minimiser: on half of the rest of a window
    to its left, or to its right. A string none of whose halves another string
    of its minimiser has can't repeat.
    """
    half = (window - gram) // 2
    numbers: dict[bytes, int] = {}
    group = np.empty(len(strings), np.int64)
    sides: list[tuple] = []
    count: dict[tuple, int] = {}
    for i, (s, p) in enumerate(zip(strings, places.tolist(), strict=True)):
        alone = p == sk.ALONE
        g = group[i] = numbers.setdefault(s if alone else s[p : p + gram], len(numbers))
        left = (g, 0, s if alone else s[max(0, p - half) : p])
        right = (g, 1, s if alone else s[p + gram : p + gram + half])
        sides.append((left, right))
        count[left] = count.get(left, 0) + 1
        count[right] = count.get(right, 0) + 1
    return [i for i, (a, b) in enumerate(sides) if (count[a] > 1 and len(a[2]) >= half) or (count[b] > 1 and len(b[2]) >= half)], group


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def _resolver(window: int, gram: int, where: str):
    def resolve(docs, ties, starts, places, strings):
        may, group = candidates(strings, places, window, gram)
        by_group: dict[int, list[int]] = {}
        for i in may:
            by_group.setdefault(int(group[i]), []).append(i)
        groups = [g for g in by_group.values() if len(g) > 1]
        if not groups:
            return [], [], [], []
        files = Files(where)
        try:
            found = list(indexed(docs, ties, starts, places, strings, groups, files))
        finally:
            files.close()
        return list(zip(*found, strict=True)) if found else ([], [], [], [])

    def indexed(docs, ties, starts, places, strings, groups: list[list[int]], files: Files) -> Iterator[tuple]:
        """Runs of repeated windows of groups of strings, a batch of groups at a time."""
        batch: list[int] = []
        held = 0
        for own in [*groups, []]:
            size = sum(int(places[i]) for i in own)
            if batch and (not own or held + size > BATCH):
                which = np.array(batch)
                hits = list(Index([strings[i] for i in batch], [int(places[i]) for i in batch], files).repeated(window))
                if hits:
                    k, place = (np.concatenate(x) for x in zip(*hits, strict=True))
                    order = np.lexsort((place, k))
                    k, place = which[k[order]], place[order]
                    new = np.r_[True, (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)]
                    first = np.flatnonzero(new)
                    last = np.r_[first[1:] - 1, len(k) - 1]
                    yield from zip(docs[k[first]], ties[k[first]], starts[k[first]] + place[first], starts[k[first]] + place[last], strict=True)
                batch, held = [], 0
            batch += own
            held += size

    return resolve


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans of every row of ``docs``.

    A byte goes if a window that covers it also starts at any other place, in
    another row or its own; all copies go. Repeated rows are rows of their own.
    Null text is empty; other columns aren't carried. Cutting through a
    character can leave bytes that aren't UTF-8, so what is kept is binary.
    """
    own = sk.keyed(docs)
    spans = sk.windows_repeated(own, sk.byte_slices, lambda s: len(s) + 1 - window, window, gram, _resolver(window, gram, shared_folder(docs.sparkSession)), first_stays=False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                out = sk.covered(spans_.as_py(), len(raw), window)
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes() if out.any() else raw)
                sizes.append(len(raw))
                gone.append(int(out.sum()))
                runs.append(int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return sk.with_spans(own, spans).mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
