"""Phrase collocations from suffix arrays of word ids.

Texts of a language become shards of about ``SHARD`` words, each with a word list of
its own. A shard's suffix array is built by prefix doubling, the intervals of its
common prefixes give the shard's count of every phrase, and counts of all shards are
merged by key. A phrase can only be frequent if its parts are, so each round breaks
the shards further: at words that are rare in the whole table, then between words
whose pair is rare; what is left is named by its pairs, so that neighbours are
phrases of three words whose two pairs are both frequent, and so on. Shards send
their pairs packed, in blocks by pair, and get back the frequent ones.
Nothing is dropped by a shard's own counts, so all counts that come out are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stored, text_slices

#: Occurrences of a candidate, words of the longest one, rows for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a shard, bytes of text tokenised at once (cut between pieces), rows of a batch that is sent on.
SHARD, PART, ROWS = 1 << 21, 4 << 20, 1 << 16
#: Bytes of packed numbers whose pairs make a block, about.
BLOCK = 2 << 20
#: Parts in which the best of a language are found before they are ranked.
SALTS = 64
#: Bits of a word id for the place in a shard's word list (a text of 2**31 bytes has fewer different words), and for a task's shards.
PLACE, SERIAL = 29, 12
UNKNOWN = "und"

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PLAIN = bytes.maketrans(_UPPER + PIECE_ENDS + b"\t", _UPPER.lower() + b"\n" * len(PIECE_ENDS) + b" ")


class _Ids(dict):
    """Word to number, from 0 for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes of a text whose pieces end in a line feed; no piece is parted."""
    a = 0
    while len(text) - a > size:
        b = text.rfind(b"\n", a, a + size) + 1 or text.find(b"\n", a + size) + 1 or len(text)
        yield text[a:b]
        a = b
    if a < len(text) or not text:
        yield text[a:]


class _Shard:
    def __init__(self):
        self.ids, self.parts, self.n = _Ids({b"\n": 0}), [], 0

    def add(self, text: bytes) -> None:
        words = [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]
        words.append(b"\n")
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.n += len(words)


def _zip(a: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of each significance together."""
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unzip(blob) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<i4")[:, 0]


def sharded(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, words (its word list), n (occurrences of each), ids (a number for each word, 0 between pieces)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = defaultdict(_Shard)
        serial = TaskContext.get().partitionId() << SERIAL

        def told(lang: str) -> pa.RecordBatch:
            nonlocal serial
            s = shards.pop(lang)
            ids = np.concatenate(s.parts)
            words = pa.array([[w.decode() for w in s.ids][1:]], pa.list_(pa.string()))
            n = pa.array([np.bincount(ids, minlength=len(s.ids))[1:]], pa.list_(pa.int64()))
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array([serial - 1]), pa.array([lang]), words, n, pa.array([_zip(ids)], pa.binary())], names=["shard", "lang", "words", "n", "ids"])

        for batch in text_slices(batches, PART):
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts[lang].append((text.as_py() or "").encode())
            for lang, each in texts.items():
                for part in cut(b"\n".join(each).translate(_PLAIN), PART):
                    shards[lang].add(part)
                    if shards[lang].n >= size:
                        yield told(lang)
        for lang in list(shards):
            yield told(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "shard long, lang string, words array<string>, n array<long>, ids binary")


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` in the order of the ``depth`` numbers from there on, by prefix doubling."""
    rank, known = seq.astype(np.int32), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        both = rank.astype(np.int64)
        both *= int(rank.max(initial=0)) + 1
        both[: len(rank) - step] += rank[step:]
        order = np.argsort(both, kind="stable")
        both = both[order]
        rank[order] = np.cumsum(np.r_[False, both[1:] != both[:-1]], dtype=np.int32) + 1
        known += step
    return order


def runs(seq: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """The runs of two numbers and more that ``joins`` (for each neighbours) holds together, a 0 after each."""
    left, right = np.r_[False, joins], np.r_[joins, False]
    at = np.flatnonzero(left | right)
    ends = ~right[at]
    out = np.zeros(len(at) + int(ends.sum()), np.int32)
    out[np.arange(len(at)) + np.cumsum(ends) - ends] = seq[at]
    return out


def phrase_counts(seq: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, a place of each different phrase of non-zero numbers, its occurrences."""
    order = suffix_array(seq, longest)
    padded = np.concatenate([seq, np.zeros(longest, seq.dtype)])
    common = np.zeros(len(order), np.int8)  # words shared with the suffix before, up to the end of a piece
    room = np.zeros(len(order), np.int8)  # words up to the end of a piece
    same, inside = np.ones(len(order), bool), np.ones(len(order), bool)
    same[:1] = False
    for j in range(longest):
        word = padded[order + j]
        inside &= word > 0
        same[1:] &= inside[1:] & (word[1:] == word[:-1])
        room += inside
        common += same
    for k in range(shortest, longest + 1):
        begin = np.flatnonzero(common < k)
        count = np.diff(np.r_[begin, len(order)])
        full = room[begin] >= k
        yield k, order[begin[full]], count[full]


def without_rare_words(shards: DataFrame, known: DataFrame) -> DataFrame:
    """shard, lang, ids, seq: the shards' runs of two ``known`` words and more, a piece's end (0) after each.

    known: shard, found (list of place in the shard's list, id). Ids are those found, in order; seq numbers them from 1.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, words, ids, found = (batch.column(k)[i] for k in range(5))
                words = words.as_py()
                at, id_ = (found.values.field(k).to_numpy() for k in (0, 1))
                at, id_ = at[(o := np.argsort(id_))], id_[o]
                new = np.zeros(words + 1, np.int32)
                new[at + 1] = np.arange(1, len(at) + 1)
                seq = new[_unzip(ids.as_py())]
                seq = runs(seq, (seq[1:] > 0) & (seq[:-1] > 0))
                row = [pa.array([shard.as_py()]), pa.array([lang.as_py()]), pa.array([id_], pa.list_(pa.int64())), pa.array([_zip(seq)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["shard", "lang", "ids", "seq"])

    rows = shards.join(known, "shard").select("shard", "lang", F.size("words").alias("words"), "ids", "found")
    return rows.mapInArrow(work, "shard long, lang string, ids array<long>, seq binary")


def neighbours(coded: DataFrame, blocks: int) -> DataFrame:
    """block, shard, lang, pairs (left, right, n as packed columns): each shard's different pairs of neighbours, dealt by pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, ids, seq = (batch.column(k)[i] for k in range(4))
                seq, id_ = _unzip(seq.as_py()), np.array(ids.values)
                ((_, at, n),) = phrase_counts(seq, 2, 2)
                left, right = id_[seq[at] - 1], id_[seq[at + 1] - 1]
                mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                block = (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)
                order = np.lexsort((right, left, block))
                left, right, n, block = left[order], right[order], n[order], block[order]
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
                packed = [_pack(left[x:y], right[x:y], n[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                row = [pa.array(block[cuts[:-1]].astype(np.int64)), pa.array([shard.as_py()] * len(packed), pa.int64()), pa.array([lang.as_py()] * len(packed), pa.string()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "shard", "lang", "pairs"])

    return coded.select("shard", "lang", "ids", "seq").mapInArrow(work, "block long, shard long, lang string, pairs binary")


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, each as differences, the bytes of each significance together."""
    both = np.stack([np.diff(c.astype("<i8"), prepend=0) for c in columns])
    return zstandard.ZstdCompressor(level=3).compress(both.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes())


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return np.cumsum(raw.transpose(0, 2, 1).copy().view("<i8")[..., 0], axis=1)


def frequent_pairs(dealt: DataFrame, least: int, parts: int) -> DataFrame:
    """id, lang, left, right, f of each pair met ``least`` times in all shards, and shard, pairs: which of them a shard holds (left, right, id).

    A frequent pair is one row, however many shards hold it. Rows of a block lie together; a pair has one block.
    """

    def told(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        each = [_unpack(p, 3) for _, _, p in rows]
        left, right, n = np.concatenate(each, axis=1)
        # ids of words and phrases differ by language, so that a pair has one language
        (_, a), (other, b) = (np.unique(c, return_inverse=True) for c in (left, right))
        _, first, which = np.unique(a * len(other) + b, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, which, n)
        often = total >= least
        new = np.cumsum(often) - 1 + (block << 32)
        shard = np.repeat(np.arange(len(rows)), [e.shape[1] for e in each])
        at = first[often]
        langs = pa.array([r[1] for r in rows], pa.string()).take(pa.array(shard[at]))
        none = lambda k, kind: pa.nulls(k, kind)
        for x in range(0, len(at), ROWS):
            k = at[x : x + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(new[often][x : x + ROWS]), langs.slice(x, len(k)), pa.array(left[k]), pa.array(right[k]), pa.array(total[often][x : x + ROWS]), none(len(k), pa.int64()), none(len(k), pa.binary())], names=NAMES)
        a = 0  # of the block's pairs
        for (own, _, _), e in zip(rows, each, strict=True):
            mine = which[a : a + e.shape[1]]
            keep = often[mine]
            a += e.shape[1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([*(none(1, k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())), pa.array([own]), pa.array([_pack(e[0][keep], e[1][keep], new[mine[keep]])], pa.binary())], names=NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for block, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and block != last:
                    yield from told(last, held)
                    held = []
                held.append(tuple(row))
                last = block
        if held:
            yield from told(last, held)

    return dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(work, "id long, lang string, left long, right long, f long, shard long, pairs binary")


NAMES = ["id", "lang", "left", "right", "f", "shard", "pairs"]


def named(coded: DataFrame, found: DataFrame) -> DataFrame:
    """shard, lang, ids, seq: runs of two frequent pairs and more, each place named by the pair that begins there (0 after each run).

    found: shard, found (list of packed left, right, id).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, ids, seq, found = (batch.column(k)[i] for k in range(5))
                seq, id_ = _unzip(seq.as_py()), np.array(ids.values)
                left, right, new = np.concatenate([_unpack(x, 3) for x in found.as_py()], axis=1)
                wide = len(id_) + 1
                pair = (np.searchsorted(id_, left) + 1) * wide + np.searchsorted(id_, right) + 1
                order = np.argsort(new)
                number = np.empty(len(new), np.int32)
                number[order] = np.arange(1, len(new) + 1)
                by = np.argsort(pair)
                pair, number = pair[by], number[by]
                here = seq[:-1].astype(np.int64) * wide + seq[1:]
                at = np.minimum(np.searchsorted(pair, here), len(pair) - 1)
                seq = np.where(pair[at] == here, number[at], 0).astype(np.int32)
                seq = runs(seq, (seq[1:] > 0) & (seq[:-1] > 0))
                row = [pa.array([shard.as_py()]), pa.array([lang.as_py()]), pa.array([new[order]], pa.list_(pa.int64())), pa.array([_zip(seq)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["shard", "lang", "ids", "seq"])

    rows = coded.join(found, "shard").select("shard", "lang", "ids", "seq", "found")
    return rows.mapInArrow(work, "shard long, lang string, ids array<long>, seq binary")


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences (lang, phrase, size, f), and each language's words (lang, n).

    A word is one row for each shard at most, however often it occurs, a frequent phrase one row in all.
    """
    shards = stored(sharded(docs, size))
    every = shards.select("lang", "shard", F.posexplode(F.arrays_zip("words", "n")).alias("at", "w")).select("lang", "shard", "at", F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n"))
    own, same = F.shiftleft("shard", PLACE).bitwiseOR(F.col("at").cast("long")), Window.partitionBy("lang", "word")
    words = stored(every.withColumns({"f": F.sum("n").over(same), "id": F.min(own).over(same)}).where(F.col("f") >= least).drop("n"))
    coded = stored(without_rare_words(shards, words.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("found"))))
    parts = partitions(docs.sparkSession)
    # phrases of k words: id, lang, phrase, last (its last word), f
    level = words.where(F.col("id") == own).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    done = level.select("lang", "phrase", F.lit(1).alias("size"), "f")
    for k in range(2, longest + 1):
        blocks = max(1, (coded.agg(F.sum(F.length("seq"))).first()[0] or 0) // BLOCK)
        found = stored(frequent_pairs(neighbours(coded, blocks), least, parts))
        pairs = found.where("shard is null").select("id", "lang", "left", "right", "f")
        begin, end = level.select(F.col("id").alias("left"), "phrase"), level.select(F.col("id").alias("right"), "last")
        level = stored(pairs.join(begin, "left").join(end, "right").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"))
        done = done.unionByName(level.select("lang", "phrase", F.lit(k).alias("size"), "f"))
        if k < longest:
            coded = stored(named(coded, found.where("shard is not null").groupBy("shard").agg(F.collect_list("pairs").alias("found"))))
    return done, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Null text is empty and a null lang is ``und``; rows that repeat an id, copies
    included, all count; other columns aren't looked at. A language without a
    candidate has no row. Counts up to 10**15 stay exact: products are decimals
    of 38 digits.
    """
    counts, totals = counted(docs, least, longest, size)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    long_ = counts.where("size > 1")
    # a longer phrase of equal count holds one of one word more that has it too
    within = long_.where("size > 2").select("lang", F.explode(F.array(part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase"), F.col("f").alias("over"))
    within = within.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = long_.join(within, ["lang", "phrase"], "left").where("over is null or 100 * over < 100 * f").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r", "n")}
    over = F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]
    cuts = cuts.withColumns({"over": over, "under": exact["l"] * exact["r"]}).withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB: words with their places, n-grams from the words that follow.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
words AS (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
spans AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM runs WHERE w5 IS NOT NULL),
counts AS (SELECT lang, phrase, size, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
whole AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
within AS (
  SELECT lang, phrase, max(over) AS over
  FROM (SELECT lang, array_to_string(w[1 : size - 1], ' ') AS phrase, f AS over FROM whole
        UNION ALL SELECT lang, array_to_string(w[2 :], ' '), f FROM whole)
  GROUP BY ALL),
cand AS (
  SELECT c.* FROM whole c LEFT JOIN within s ON s.lang = c.lang AND s.phrase = c.phrase
  WHERE s.over IS NULL OR 100 * s.over < 100 * c.f),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, c.k,
         CAST((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
