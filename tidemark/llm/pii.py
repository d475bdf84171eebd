"""Personal data, and the terms that reveal it.

Base spans (email, ip, card, phone) are found in whole texts. Each distinct
value is a protected entity. Over all documents we count in how many an entity
occurs, in how many a term occurs, in how many a term stands within ``CONTEXT``
words of the entity, and in how many different contexts it does (each occurrence
of the entity has its own; equal surroundings, as in copies, are one). Contexts
are the observations behind the share of a term's documents that name the entity;
a term discloses the entity if the pointwise mutual information at the lower
confidence bound of that share (Wilson, ``z``) reaches ``alpha`` of the entity's
information content. So a rare entity has terms as soon as its content is large
beside the doubt that few contexts leave. Such terms are removed from every text.

Counts are aggregated on both sides of the shuffle; document frequencies are those
of all terms, so that what is gathered grows with the texts alone. Texts only ask for
terms that hit a fixed-size bitmap (``BITS`` bits) of the disclosing terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, among, checkpointed, fresh

KINDS = ("email", "ip", "card", "phone")
CONTEXT, BITS = 8, 1 << 22
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots, leftmost first; those with a part over 255 are dropped."""
    chain: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        a, b = m.span()
        if not (chain and a == chain[-1][1] + 1 and text[a - 1] == "."):
            chain = []
        chain.append((a, b))
        if len(chain) == 4:
            if all(y - x <= 3 or not text[x:y].lstrip("0")[3:] for x, y in chain) and all(int(text[x:y][-4:]) <= 255 for x, y in chain):
                yield chain[0][0], b
            chain = []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> int:
    """A protected value's number; cards and phones are their digits."""
    norm = value.lower() if kind == "email" else re.sub("[^0-9]", "", value) if kind != "ip" else value
    return xxhash.xxh3_64_intdigest(f"{kind}:{norm}") - 2**63


def contexts(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Entity, hash of its surroundings and the terms in them, for each base span."""
    for kind, a, b in base_spans(text):
        left = TERM.findall(text[max(0, a - 40 * CONTEXT) : a].lower())[-CONTEXT:]
        right = TERM.findall(text[b : b + 40 * CONTEXT].lower())[:CONTEXT]
        yield entity(kind, text[a:b]), xxhash.xxh3_64_intdigest(" ".join(left + right)) - 2**63, {*left, *right}


def bit(term: str) -> int:
    """As Spark's xxhash64 of the string, by which the bitmap is filled."""
    return xxhash.xxh64_intdigest(term, seed=42) & (BITS - 1)


def _long(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(_long("doc_id").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def suspects(text: F.Column) -> F.Column:
    """Only texts with a digit or an @ can hold base spans."""
    return text.rlike("[0-9@]")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """BITS bits, of which those of the terms are set; put together on the executors."""
    b = F.xxhash64("term").bitwiseAND(F.lit(BITS - 1)) + 1
    own = terms.select(F.bitmap_bucket_number(b).alias("k"), F.bitmap_bit_position(b).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for k, bits in own.collect():  # BITS / 32768 rows at most
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


class Hits(dict):
    """Whether a term's bit is set."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        k = bit(term)
        got = self[term] = bool(self.bits[k >> 3] >> (k & 7) & 1)
        return got


def terms_of(text: str) -> set[str]:
    return {t.lower() for t in TERM.findall(text)}


def disclosing(docs: DataFrame, alpha: float = 0.8, z: float = 1.96) -> DataFrame:
    """(entity, term) that exceed the threshold."""
    rows = _keyed(docs)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for text in batch.column(0).to_pylist():
                seen: set[tuple[int, str]] = set()
                for e, ctx, own in set((e, ctx, frozenset(own)) for e, ctx, own in contexts(text)):
                    for t in ("", *own):
                        first = (e, t) not in seen
                        seen.add((e, t))
                        for col, v in zip(cols, (e, t, ctx, int(first)), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["entity", "term", "ctx", "first"])

    met = rows.where(suspects(F.col("text"))).select("text").mapInArrow(pairs, "entity long, term string, ctx long, first long")
    both = checkpointed(met.groupBy("entity", "term", "ctx").agg(F.sum("first").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_ctx")))
    n_all = F.lit(float(docs.count()))
    content = F.log2(n_all / F.col("n_entity"))
    n_entity = both.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    # the bound of a share of one is the most that a pair can reach, however rare its term
    at_best = F.col("n_ctx") / (F.col("n_ctx") + z * z)
    wanted = both.where("term <> ''").join(n_entity, "entity").where((content > 0) & (F.log2(n_all * at_best / F.col("n_entity")) >= alpha * content - 1e-9))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents of a stretch each term stands."""
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(terms_of(text.as_py()))
                if len(seen) > 100_000:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    n_term = rows.select("text").mapInArrow(counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    m = F.col("n_ctx") / share  # observations of the term, as n_ctx of them are with the entity
    low = (share + z * z / (2 * m) - z * F.sqrt(share * (1 - share) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    pmi = F.log2(n_all * low / F.col("n_entity"))
    return wanted.join(n_term, "term").where(pmi >= alpha * content).select("entity", "term", pmi.alias("pmi"), content.alias("content"))


def _asked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc, tie and the disclosing terms that stand in the text, for all texts that hold some."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(found))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(held.value)
        some = bool(held.value.any())
        for batch in batches:
            cols: list[list] = [[], [], []]
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if some else ():
                for t in terms_of(text):
                    if hits[t]:
                        for col, v in zip(cols, (doc, tie, t), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "tie", "term"])

    met = _keyed(docs).mapInArrow(words, "doc long, tie long, term string").join(found.select("term").distinct(), "term")
    return met.groupBy("doc", "tie").agg(F.collect_set("term").alias("terms"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, clean string"


def find(text: str, terms: set[str], with_text: bool = True) -> tuple:
    """The fields of ``RESULT`` for one text."""
    base = base_spans(text)
    spans = list(base)
    if terms:
        taken = sorted((a, b) for _, a, b in base)
        k = 0
        for m in TERM.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if m.group().lower() in terms and not any(x < b and a < y for x, y in taken[k : k + 4]):
                spans.append(("term", a, b))
    n = Counter(k for k, _, _ in base)
    told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    return (*(n[k] for k in KINDS), told(base), told(spans), redacted(text, spans) if with_text else None)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans generalised to their kind, revealing terms removed; of overlapping spans the first is named."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def sanitise(docs: DataFrame, alpha: float = 0.8, z: float = 1.96, with_text: bool = True) -> DataFrame:
    """Every row and column of ``docs``, and last a struct ``pii`` (``RESULT``).

    It is called so with underscores appended if ``docs`` has that name. Counts are longs; ``base`` and ``spans`` list kind:start:end in code points;
    ``clean`` is the text without them (null text stays null, null without
    ``with_text``). Repeated rows get the same result; rows whose doc_id repeats
    are told apart by their texts.
    """
    terms = checkpointed(_asked(docs, checkpointed(disclosing(docs, alpha, z))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.pandas_udf(RESULT)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = [find(t, set(() if own is None else own), with_text) for t, own in zip(texts, lists, strict=True)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])

    doc, tie, own, out = fresh(docs, "doc", "tie", "terms", "pii")
    terms = terms.withColumnsRenamed({"doc": doc, "tie": tie, "terms": own})
    some, others = among(docs.withColumns({doc: _long("doc_id"), tie: F.xxhash64(text)}), terms, [doc, tie])  # few texts hold terms: only these are shuffled
    rows = some.join(terms, [doc, tie], "left").unionByName(others.withColumn(own, F.lit(None).cast("array<string>")))
    return rows.withColumn(out, apply(text, own)).select(*docs.columns, out)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
