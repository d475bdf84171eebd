"""Repeated word passages, found by super-k-mer partitioning.

Every window of ``WINDOW`` words reaches the bucket of its minimiser inside a
packed string of words; there, sorting the windows of all strings brings equal
ones together and leaves the first of each (smallest doc_id, then start).
Hashes only order the sort: equal neighbours are compared word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import superkmers as sk

WINDOW, GRAM = 20, 3


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def candidates(strings: list[bytes], places: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Strings that may hold a window of another.

    Equal windows agree on their minimiser and on half of the rest of a window
    to its left or to its right; a string that shares neither can't repeat.
    """
    half = (window - gram) // 2
    heads = [s if p == sk.ALONE else tuple(s[p:].split(b" ", gram)[:gram]) for s, p in zip(strings, places.tolist(), strict=True)]
    seen = Counter(heads)
    count: Counter = Counter()
    sides: list[tuple] = []
    for i, h in enumerate(heads):
        if seen[h] > 1:
            p = int(places[i])
            if p == sk.ALONE:
                left = right = (h, 2)
            else:
                before, after = strings[i][:p].rsplit(b" ", half + 1)[-half - 1 : -1], strings[i][p:].split(b" ", gram + half)[gram : gram + half]
                left, right = (h, 0, *before) if len(before) == half else None, (h, 1, *after) if len(after) == half else None
            sides.append((i, left, right))
            count.update(x for x in (left, right) if x)
    return np.array([i for i, a, b in sides if (a and count[a] > 1) or (b and count[b] > 1)], np.int64)


def _resolver(window: int, gram: int):
    def resolve(docs, ties, starts, places, strings):
        may = candidates(strings, places, window, gram)
        if not len(may):
            return [], [], [], []
        order = may[np.lexsort((starts[may], ties[may], docs[may]))]
        docs, ties, starts = docs[order], ties[order], starts[order].astype(np.int64)
        strings = [strings[i] for i in order.tolist()]
        size = np.fromiter((s.count(b" ") for s in strings), np.int64, len(strings)) + 1
        ids = np.fromiter(map(_Numbers().__getitem__, b" ".join(strings).split(b" ")), np.int64, int(size.sum()))
        base = np.cumsum(size) - size
        count = size - window + 1
        owner = np.repeat(np.arange(len(strings)), count)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = base[owner] + inner
        first = same_as_first(ids, at, sk.rolling(ids.astype(np.uint64), window)[at], window)
        start = starts[owner] + inner
        again = first >= 0
        f = np.where(again, first, 0)
        # a repeated row is no earlier place of its own windows
        again &= ~((docs[owner[f]] == docs[owner]) & (ties[owner[f]] == ties[owner]) & (start[f] == start))
        hit = np.flatnonzero(again)
        if not len(hit):
            return [], [], [], []
        own = owner[hit]
        new = np.r_[True, (own[1:] != own[:-1]) | (hit[1:] != hit[:-1] + 1)]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:] - 1, len(hit) - 1]
        return docs[own[begin]], ties[own[begin]], start[hit[begin]], start[hit[end]]

    return resolve


def same_as_first(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window (its place in ``ids``) the index of the first equal one, -1 for the first itself."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.r_[True, h[1:] != h[:-1]]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    out = np.full(len(at), -1, np.int64)
    later = np.flatnonzero(~new)
    for a in range(0, len(later), 1 << 16):
        k = later[a : a + (1 << 16)]
        mine, theirs = order[k], lead[k]
        span = np.arange(window)
        if not (ids[at[mine][:, None] + span] == ids[at[theirs][:, None] + span]).all():
            return _by_words(ids, at, window)
        out[mine] = theirs
    return out


def _by_words(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """As ``same_as_first``, without hashes; for buckets where two windows share one."""
    rows = ids[at[:, None] + np.arange(window)]
    _, lead, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    out = lead[group.ravel()]
    out[out == np.arange(len(at))] = -1
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of every row of ``docs``.

    A word goes if a window that covers it also starts earlier: in a smaller
    doc_id (null before all, then by a hash of the text where a doc_id repeats)
    or earlier in its text. Identical rows (same id and text) are the same
    place, so neither removes the other's words. Null text has no words. Other
    columns aren't carried.
    """
    own = sk.keyed(docs)
    spans = sk.windows_repeated(own, sk.word_slices, lambda s: s.count(b" ") + 2 - window, window, gram, _resolver(window, gram), first_stays=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                spans_ = spans_.as_py()
                if spans_:
                    out = sk.covered(spans_, len(words), window)
                    left = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                else:
                    left = words
                kept.append(b" ".join(left).decode())
                total.append(len(words))
                gone.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return sk.with_spans(own, spans).mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")
