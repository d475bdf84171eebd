"""Toxicity scores from a bidirectional gated recurrent network.

Every word of a text enters as a word embedding beside the mean of its
character-trigram embeddings. Windows of ``WINDOW`` words, overlapping by
``WINDOW - STRIDE``, run through a forward and a backward gated recurrent layer;
attention pools the states of a window into one logit and a text takes the
largest logit of all its windows, calibrated to a probability.

Training is plain numpy in one task over a bounded sample of labelled rows
(``Settings.sample`` rows, whole texts): every window of a text is run, and the
``Settings.learn`` strongest of a text carry its gradient. The task takes one batch of
texts at a time and keeps their word numbers; no text comes to the driver, and a lost
executor only means that the task runs again, with the same result. Scoring is one map
over whole texts: no shuffle, and the model that is shipped has a fixed size of about 2 MB.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

WINDOW, STRIDE = 48, 40
#: Width of a word's two embeddings, of a recurrent state, of the attention layer.
D_WORD, D_CHAR, HIDDEN, ATT = 4, 4, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 14
#: Entries of a worker's word cache (about 80 MB), and windows of one matrix step.
CACHE, STEP = 300_000, 2048
#: Windows of one step of training, a task that shares its executor's memory.
FEW = 256
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Settings:
    sample: int = 4000
    epochs: int = 2
    #: Small samples are gone through more often, until this many steps are made.
    least_steps: int = 400
    batch_docs: int = 32
    #: Windows of a text that carry its gradient: those of the largest logits.
    learn: int = 16
    rate: float = 0.01
    seed: int = 11


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    #: Says what every text scores, if there was nothing to learn from.
    constant: float | None = None
    info: dict = field(default_factory=dict)


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the word table of each word; rows of the trigram table, and where each word's begin."""
    low = [w.lower() for w in words]
    rows = np.fromiter(map(zlib.crc32, map(str.encode, [w.strip(EDGE) or w for w in low])), np.int64, len(words)) % WORD_ROWS
    marked = "\x02" + "\x03\x02".join(low) + "\x03" if low else ""
    code = np.frombuffer(marked.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    tri = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    tri = (tri % np.uint64(CHAR_ROWS)).astype(np.int64)
    inside = (code[1:-1] != 3) & (code[1:-1] != 2)  # a trigram's middle is a character of the word
    ends = np.flatnonzero(code == 2)
    counts = np.add.reduceat(np.concatenate([[0], inside, [0]]).astype(np.int64), ends) if len(ends) else np.zeros(0, np.int64)
    return rows, tri[inside], counts


def char_means(table: np.ndarray, tri: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        at = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        out[some] = np.add.reduceat(table[tri], at, axis=0) / counts[some, None]
    return out


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last reaches its end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """x: (time, windows, inputs); mask: (time, windows). Logits, and with ``keep`` what backward needs."""
    steps, n, _ = x.shape
    h2 = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    tape = []
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        proj = x @ p["W" + side] + p["B" + side]
        u, h = p["U" + side], np.zeros((n, HIDDEN), np.float32)
        part = h2[:, :, :HIDDEN] if side == "f" else h2[:, :, HIDDEN:]
        for t in order:
            hu = h @ u
            zr = sigmoid(proj[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(proj[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                tape.append((side, t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = new
            part[t] = h
    a = np.tanh(h2 @ p["Wa"] + p["Ba"])
    e = np.where(mask > 0, a @ p["va"], -1e9)
    e = np.exp(e - e.max(0)) * (mask > 0)
    w = e / np.maximum(e.sum(0), 1e-9)
    ctx = (w[:, :, None] * h2).sum(0)
    logit = ctx @ p["wo"] + p["bo"][0]
    return (logit, (x, h2, a, w, ctx, tape)) if keep else logit


def backward(p: dict, kept, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the inputs for gradients ``d`` of the logits."""
    x, h2, a, w, ctx, tape = kept
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"] = ctx.T @ d
    g["bo"] = np.array([d.sum()], np.float32)
    dctx = d[:, None] * p["wo"]
    dh2 = w[:, :, None] * dctx[None]
    dw = (h2 * dctx[None]).sum(2)
    de = w * (dw - (w * dw).sum(0))
    g["va"] = np.einsum("tn,tna->a", de, a)
    da = de[:, :, None] * p["va"] * (1 - a * a)
    flat = da.reshape(-1, ATT)
    g["Wa"] = h2.reshape(-1, 2 * HIDDEN).T @ flat
    g["Ba"] = flat.sum(0)
    dh2 = dh2 + da @ p["Wa"].T
    dx = np.zeros_like(x)
    carry = {"f": 0.0, "b": 0.0}
    for side, t, h, z, r, c, hc, m in reversed(tape):
        u = p["U" + side]
        dh = carry[side] + (dh2[t, :, :HIDDEN] if side == "f" else dh2[t, :, HIDDEN:])
        dc = dh * m * (1 - z)
        dz = -dh * m * (c - h)
        dprev = dh - dc
        dpc = dc * (1 - c * c)
        dr = dpc * hc
        dzr = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], 1)
        dproj = np.concatenate([dzr, dpc], 1)
        dhu = np.concatenate([dzr, dpc * r], 1)
        g["U" + side] += h.T @ dhu
        g["W" + side] += x[t].T @ dproj
        g["B" + side] += dproj.sum(0)
        dx[t] += dproj @ p["W" + side].T
        carry[side] = dprev + dhu @ u.T
    return g, dx


def log_odds(keys: list[np.ndarray], labels: np.ndarray, rows: int) -> np.ndarray:
    """Shrunken log odds of label 1 for texts that hold a key."""
    hit = np.zeros((2, rows))
    for k, y in zip(keys, labels, strict=True):
        hit[int(y), np.unique(k)] += 1
    pos, neg = max(1, labels.sum()), max(1, (1 - labels).sum())
    seen = hit.sum(0)
    odds = np.log((hit[1] + 0.5) / (pos + 1)) - np.log((hit[0] + 0.5) / (neg + 1))
    return (np.clip(odds, -4, 4) * seen / (seen + 6)).astype(np.float32)


def train(texts: Iterable[str], labels: list[int], settings: Settings | None = None) -> Model:
    """Fit on a sample: a part for the first embeddings, a part for the network, a part to calibrate.

    An empty sample or one label alone gives a model that scores every text with
    the share of label 1 (0.0 if empty). ``texts`` are read once, in order, and not kept;
    ``labels`` may grow as they are read.
    """
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t.split()], np.int32) for t in texts]  # each word is kept once
    y = np.asarray(labels, np.float32)
    usable = len(y) >= 20 and 0 < y.sum() < len(y)
    words = list(vocab)
    parts = [word_keys(words[a : a + 10_000]) for a in range(0, len(words), 10_000)]
    rows, tri, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(counts)
    word = (rng.standard_normal((WORD_ROWS, D_WORD)) * 0.02).astype(np.float32)
    char = (rng.standard_normal((CHAR_ROWS, D_CHAR)) * 0.02).astype(np.float32)
    d_in = D_WORD + D_CHAR
    p = {"Wa": rng.standard_normal((2 * HIDDEN, ATT)) * 0.3, "Ba": np.zeros(ATT), "va": rng.standard_normal(ATT) * 0.3, "wo": rng.standard_normal(2 * HIDDEN) * 0.3, "bo": np.zeros(1)}
    for side in "fb":
        p |= {"W" + side: rng.standard_normal((d_in, 3 * HIDDEN)) * 0.4, "U" + side: rng.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.2, "B" + side: np.zeros(3 * HIDDEN)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(word, char, p)
    if not usable:
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    part = rng.permutation(len(y)) % 10  # 0-3: first embeddings, 4-7: network, 8-9: calibration
    first = [i for i in range(len(y)) if part[i] < 4]
    word[:, 0] += log_odds([rows[ids[i]] for i in first], y[first], WORD_ROWS)
    of_words = lambda i: np.concatenate([tri[ends[k] - counts[k] : ends[k]] for k in np.unique(ids[i])] or [np.zeros(0, np.int64)])
    char[:, 0] += log_odds([of_words(i) for i in first], y[first], CHAR_ROWS)

    def batch(docs: list[int]):
        starts = [windows_of(len(ids[i])) for i in docs]
        flat = np.concatenate([ids[i] for i in docs])
        base = np.concatenate([[0], np.cumsum([len(ids[i]) for i in docs])])
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
        at = np.concatenate(starts) + base[owner]
        grid = at[None, :] + np.arange(WINDOW)[:, None]
        mask = (grid < base[owner + 1][None, :]).astype(np.float32)
        return flat[np.minimum(grid, len(flat) - 1)], mask, owner

    def inputs(grid: np.ndarray):
        used, back = np.unique(grid, return_inverse=True)
        where = np.concatenate([np.arange(ends[k] - counts[k], ends[k]) for k in used])
        mean = char_means(char, tri[where], counts[used])
        return np.concatenate([word[rows[used]], mean], 1)[back.reshape(grid.shape)], used, back.ravel(), where

    def scored(grid: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([forward(p, inputs(grid[:, a : a + FEW])[0].astype(np.float32), mask[:, a : a + FEW]) for a in range(0, grid.shape[1], FEW)])

    def strongest(grid: np.ndarray, mask: np.ndarray, owner: np.ndarray):
        """The windows of each text that learn; of texts with more of them, all windows are scored first."""
        if np.bincount(owner).max() <= s.learn:
            return grid, mask, owner
        logit = scored(grid, mask)
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)  # owners ascend
        keep = np.sort(order[rank < s.learn])
        return grid[:, keep], mask[:, keep], owner[keep]

    fit = np.array([i for i in range(len(y)) if 4 <= part[i] < 8 and len(ids[i])])
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    slow_w, slow_c = np.full(word.shape, 1e-3, np.float32), np.full(char.shape, 1e-3, np.float32)
    step = 0
    epochs = max(s.epochs, -(-s.least_steps * s.batch_docs // max(1, len(fit))))
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), s.batch_docs):
            docs = list(order[a : a + s.batch_docs])
            grid, mask, owner = strongest(*batch(docs))
            x, used, back, where = inputs(grid)
            logit, kept = forward(p, x.astype(np.float32), mask, keep=True)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            top = np.maximum.reduceat(logit, begin)[owner]
            weight = np.exp(2 * (logit - top))
            weight /= np.add.reduceat(weight, begin)[owner]
            pooled = np.add.reduceat(weight * logit, begin)
            err = (sigmoid(pooled) - y[docs]) / len(docs)
            g, dx = backward(p, kept, (err[owner] * weight).astype(np.float32))
            step += 1
            rate = s.rate * (1 - epoch / epochs * 0.7)
            for k, v in p.items():
                m1, m2 = adam[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            flat = dx.reshape(-1, d_in)
            by_word = np.stack([np.bincount(back, flat[:, j], len(used)) for j in range(d_in)], 1)
            _nudge(word, slow_w, rows[used], by_word[:, :D_WORD])
            n = counts[used]
            _nudge(char, slow_c, tri[where], np.repeat(by_word[:, D_WORD:] / np.maximum(n, 1)[:, None], n, axis=0))
    model.word, model.char = word, char
    cal = [i for i in range(len(y)) if part[i] >= 8]
    raw = np.full(len(cal), p["bo"][0], np.float64)  # as texts without words score
    told = [k for k, i in enumerate(cal) if len(ids[i])]
    for a in range(0, len(told), 16):
        grid, mask, owner = batch([cal[k] for k in told[a : a + 16]])
        raw[told[a : a + 16]] = np.maximum.reduceat(scored(grid, mask), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
    model.scale, model.shift = _calibrate(raw, y[cal])
    model.info = {"sample": len(y), "label_1": int(y.sum())}
    return model


def _nudge(table: np.ndarray, slow: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    used, back = np.unique(rows, return_inverse=True)
    g = np.stack([np.bincount(back, grad[:, j], len(used)) for j in range(grad.shape[1])], 1).astype(np.float32)
    slow[used] += g * g
    table[used] -= 0.02 * g / np.sqrt(slow[used])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the logit, by Newton steps."""
    a, b = 1.0, 0.0
    if not 0 < y.sum() < len(y):
        return a, b
    for _ in range(30):
        q = sigmoid(a * x + b)
        r, v = q - y, np.maximum(q * (1 - q), 1e-6)
        ga, gb = (r * x).sum() + 1e-2 * (a - 1), r.sum()
        haa, hab, hbb = (v * x * x).sum() + 1e-2, (v * x).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-9:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    return float(max(a, 0.05)), float(b)


class Seen(dict):
    """Numbers words as they come; ``fresh`` lists those that have no row yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Logits of texts; remembers the input projections of the words it has met."""

    def __init__(self, model: Model):
        self.model, p = model, model.p
        self.w = np.concatenate([p["Wf"], p["Wb"]], 1)
        self.b = np.concatenate([p["Bf"], p["Bb"]])
        self.forget()

    def forget(self) -> None:
        self.seen = Seen()
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.forget()
        at = len(self.seen)
        got = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        new, self.seen.fresh = self.seen.fresh, []
        if new:
            rows, tri, counts = word_keys(new)
            x = np.concatenate([self.model.word[rows], char_means(self.model.char, tri, counts)], 1)
            if at + len(new) > len(self.table):
                more = np.zeros((max(2 * len(self.table), at + len(new)), 6 * HIDDEN), np.float32)
                more[:at] = self.table[:at]
                self.table = more
            self.table[at : at + len(new)] = x @ self.w + self.b
        return got

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The largest window logit of each text, given as its words."""
        flat = self.rows([w for t in texts for w in t])
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        per = np.maximum(1, -(-np.maximum(0, sizes - (WINDOW - STRIDE)) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), per)
        begin = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
        at = base[owner] + (np.arange(len(owner)) - begin[owner]) * STRIDE
        out = np.empty(len(owner), np.float32)
        if not len(flat):
            flat = np.zeros(1, np.int64)  # masked everywhere
        for a in range(0, len(owner), STEP):
            grid = at[a : a + STEP][None, :] + np.arange(WINDOW)[:, None]
            mask = (grid < base[owner[a : a + STEP] + 1][None, :]).astype(np.float32)
            out[a : a + STEP] = self.pooled(self.table[flat[np.minimum(grid, len(flat) - 1)]], mask)
        return np.maximum.reduceat(out, begin) if len(out) else out

    def pooled(self, proj: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """As ``forward``, from the projections of the inputs."""
        p, (steps, n, _) = self.model.p, proj.shape
        h2 = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        whole = bool(mask.all())
        for side in (0, 1):
            u, h = p["Ub" if side else "Uf"], np.zeros((n, HIDDEN), np.float32)
            lo = side * 3 * HIDDEN
            for t in range(steps - 1, -1, -1) if side else range(steps):
                hu = h @ u
                zr = sigmoid(proj[t, :, lo : lo + 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                c = np.tanh(proj[t, :, lo + 2 * HIDDEN : lo + 3 * HIDDEN] + zr[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
                gate = 1 - zr[:, :HIDDEN]
                h = h + (gate if whole else mask[t][:, None] * gate) * (c - h)
                h2[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        a = np.tanh(h2 @ p["Wa"] + p["Ba"])
        e = np.where(mask > 0, a @ p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(0)) * mask
        w = e / np.maximum(e.sum(0), np.float32(1e-9))
        return np.einsum("tn,tnh,h->n", w, h2, p["wo"], optimize=True) + p["bo"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        out, part, held = [], [], 0
        for t in texts:  # 200,000 words or one text at a time
            words = t.split()
            if part and held + len(words) > 200_000:
                out.append(self.logits(part))
                part, held = [], 0
            part.append(words)
            held += len(words)
        if part:
            out.append(self.logits(part))
        raw = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return sigmoid(m.scale * raw + m.shift)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Train on labelled rows of ``docs``, never on those held out (crc32 of doc_id mod 5 is 0).

    The sample is the ``settings.sample`` labelled documents of the smallest hashed
    doc_id; labels other than 0 and 1, labels without a document, null ids and null or
    empty texts aren't used. Of rows that repeat an id the least text is taken.
    """
    s = settings or Settings()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )
    sample = (
        texts.join(F.broadcast(known), "doc_id")  # at most s.sample rows of two numbers
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .repartition(1).sortWithinPartitions("doc_id").select("toxic", "text")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[int] = []

        def read() -> Iterator[str]:
            for batch in batches:
                seen.extend(batch.column(0).to_pylist())
                yield from (t.as_py() for t in batch.column(1))

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(read(), seen, s))], pa.binary())], ["model"])

    models = sample.mapInArrow(learn, "model binary").collect()  # one, or none if the sample is empty
    return pickle.loads(models[0].model) if models else train([], [], s)


def with_scores(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a last column of scores (0 to 1). Null and empty texts score as no words do.

    The column is called ``out``, with underscores appended if ``docs`` has that name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    (out,) = fresh(docs, out)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield pd.Series(scorer.scores([t or "" for t in batch]))

    return docs.withColumn(out, score(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows that score under the threshold, columns as they came."""
    (name,) = fresh(docs, "toxicity")
    return with_scores(docs, model, name).where(F.col(name) < threshold).drop(name)
