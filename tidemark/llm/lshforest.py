"""Near-duplicate join on word shingles: MinHash LSH forest, then exact verification.

1. Rows with the same set of five-word shingles make one class; its smallest
   (doc_id, digest of the text) stands for it. From here on only representatives
   move, so copies cost nothing but their first aggregation.
2. A forest of ``TREES`` prefix tries holds signatures of ``DEEPEST`` values for
   each tree, as a sort key: a hash of the first ``depth()`` values (the shortest
   prefix that may be needed) and the further values in order. Each text starts
   in every tree at the deepest node that is crowded, i.e. at the first depth at
   which at most ``BLOCK`` texts share its prefix. Its prefixes are then shortened,
   least crowded trees first, until the text meets another of the least similarity
   in some tree with probability ``recall`` or more.
3. Within a node, packed signatures are compared; pairs that may be similar tie
   their texts into clusters (connected components). A text whose prefix was
   shortened is compared with all that share the shorter one.
4. A cluster's texts come with their shingles, once each, and every pair is
   verified exactly. Nodes and clusters of more than ``BLOCK`` texts, and clusters
   of more than ``SHINGLES`` shingles, are cut into blocks, and pairs of blocks go
   to tasks of their own. Tasks return counts and spanning edges, never lists of pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, among, checkpointed, fresh, joined, partitions
from tidemark.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
TREES, DEEPEST, RECALL = 32, 8, 0.99999
BLOCK, SHINGLES = 2048, 4 << 20
#: Bits of each value beyond the shortest prefix.
BITS = 20
ID = "doc long, tie binary"
U = np.uint64


def depth(similar: float = SIMILAR, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix by which the forest still reaches the target recall if all trees use it: no text needs a shorter one."""
    for d in range(deepest, 0, -1):
        if 1 - (1 - similar**d) ** trees >= recall:
            return d
    raise ValueError("this many trees can't reach the recall")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, no words are none."""
    split = text.split()
    n = len(split)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(words.__getitem__, split), U, n)
    k = min(size, n)
    out = np.full(n - k + 1, n if n < size else size, U)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return np.unique(out)


class Signer:
    """MinHash signatures for ``trees`` tries, whose shortest prefix has ``shortest`` values and whose longest ``deepest``."""

    def __init__(self, trees: int, shortest: int, deepest: int):
        rng = np.random.default_rng(20)
        self.trees, self.shortest, self.deepest = trees, shortest, deepest
        n = trees * deepest
        self.mul = rng.integers(0, 2**32, (n, 1), np.uint32) | np.uint32(1)
        self.xor = rng.integers(0, 2**32, (n, 1), np.uint32)

    def __call__(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each tree a key of the shortest prefix and the further values, highest bits first; one byte of each value of the shortest prefixes."""
        x = (sh >> U(17)).astype(np.uint32)
        low = np.full(len(self.mul), 2**32 - 1, np.uint32)
        for a in range(0, len(x), 2048):
            np.minimum(low, ((x[a : a + 2048][None, :] ^ self.xor) * self.mul).min(1), out=low)
        values = low.reshape(self.deepest, self.trees).astype(U)
        key = np.arange(1, self.trees + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)
        tail = np.zeros(self.trees, U)
        for k, v in enumerate(values):
            if k < self.shortest:
                key = (key ^ v) * U(0x9E3779B97F4A7C15)
                key ^= key >> U(31)
            else:
                tail = (tail << U(BITS)) | ((v * U(2654435761) & U(0xFFFFFFFF)) >> U(32 - BITS))
        sig = ((low[: self.trees * self.shortest] * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        return key.view(np.int64), tail.view(np.int64), sig


def _rows(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def tie_of(text: Column) -> Column:
    """128 bits of a text, which tell rows of one doc_id apart."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), tie_of(text).alias("tie"), text.alias("text"))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree on the first ``keys`` columns, from rows sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def blocked(rows: DataFrame, blocks: Column) -> DataFrame:
    """Adds bi, bj, own: each row once for every pair of blocks of its group that its block is in."""
    n, other = fresh(rows, "blocks", "other")
    return (
        rows.withColumn(n, blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("doc", "tie", F.lit(7)), F.col(n)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        .withColumns({"bi": F.least("own", other), "bj": F.greatest("own", other)}).drop(n, other)
    )


def missed(d: int, similar: float) -> float:
    """Log of the probability that two texts of that similarity part before depth d of a tree."""
    return math.log(1 - similar**d)


def trie_nodes(entries: DataFrame, total: int, shortest: int, deepest: int, similar: float, trees: int, recall: float) -> DataFrame:
    """node, cnt, asked, doc, tie: who meets in which node of the forest.

    entries: ``total`` rows of doc, tie, key (tree and shortest prefix), tail (further values).
    Pairs of a node count if one of the two is asked. Nodes of one text don't come.
    """
    counts = checkpointed(entries.groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"))
    crowded = counts.where(F.col("cnt") > BLOCK)
    whole = lambda rows: rows.select(F.col("key").alias("node"), "cnt", F.lit(True).alias("asked"), "doc", "tie")
    if deepest == shortest or not crowded.take(1):
        return whole(joined(entries, counts, "key", total))
    cold = whole(joined(entries, counts.where(F.col("cnt") <= BLOCK), "key", total))
    hot = checkpointed(joined(among(entries, crowded, ["key"])[0], crowded, "key", total))  # crowded nodes only: the trie is descended until they aren't
    found, left = [], hot.select("doc", "tie", "key", "tail")
    for d in range(shortest + 1, deepest + 1):
        prefix = F.shiftrightunsigned("tail", BITS * (deepest - d))
        at = left.withColumn("node", F.xxhash64("key", F.lit(d), prefix))
        at = checkpointed(joined(at, at.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", total, "n"))
        fits = F.col("n") <= BLOCK if d < deepest else F.lit(True)
        found.append(at.where(fits).select("doc", "tie", "key", "node", "n", F.lit(d).alias("depth")))
        left = at.where(~fits).select("doc", "tie", "key", "tail")
    deep = reduce(DataFrame.unionByName, found)
    lost = F.element_at(F.array(*(F.lit(missed(d, similar) - missed(shortest, similar)) for d in range(shortest + 1, deepest + 1))), F.col("depth") - shortest)
    may_lose = math.log(1 - recall) - trees * missed(shortest, similar)
    # at most one element a tree; the most crowded trees keep their long prefixes as far as the recall allows
    own = deep.join(hot.select("doc", "tie", "key", "cnt"), ["doc", "tie", "key"]).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("crowd"), "key", lost.alias("lost")))).alias("trees"))
    total = F.transform("trees", lambda t, i: F.aggregate(F.slice("trees", 1, i + 1), F.lit(0.0), lambda s, x: s + x["lost"]))
    short = own.select("doc", "tie", F.explode(F.arrays_zip("trees", total.alias("total"))).alias("t")).where(F.col("t.total") > may_lose).select("doc", "tie", F.col("t.trees.key").alias("key"), F.lit(True).alias("asked"))
    asked = checkpointed(short)
    wide = hot.join(asked.select("key").distinct(), "key", "left_semi").join(asked, ["doc", "tie", "key"], "left")
    wide = wide.select(F.col("key").alias("node"), "cnt", F.coalesce("asked", F.lit(False)).alias("asked"), "doc", "tie")
    narrow = deep.where("n > 1").select("node", F.col("n").alias("cnt"), F.lit(True).alias("asked"), "doc", "tie")
    return cold.unionByName(narrow).unionByName(wide)


def forest(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items by a square matrix of links."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, n, 1024):
            part = links[a : a + 1024]
            new[a : a + 1024] = np.minimum(new[a : a + 1024], np.where(part, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc, tie, root_doc, root_tie, n_links of every row of ``docs`` (doc_id, text).

    The root is the smallest row of the group that chains of links of at least
    ``similar`` make; n_links counts the other rows at least that similar, copies
    among them. Texts without words have no shingles: they link to nothing. Null
    ids come as NULL_ID, the smallest. ``tie`` (128 bits of the text) tells rows with
    the same id apart. Other columns aren't carried.
    """
    shortest = depth(similar, trees, recall)
    deepest = max(DEEPEST, shortest)
    values = trees * shortest
    parts = partitions(docs.sparkSession)
    least_equal = int(np.floor(values * (similar + (1 - similar) / 256) - 5.5 * np.sqrt(values * similar * (1 - similar))))
    rows = keyed(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sign = WordHashes(), Signer(trees, shortest, deepest)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                cols: list[list] = [[] for _ in range(5)]
                seen: dict[bytes, tuple] = {}
                for text in part.column(2):
                    sh = shingles(text.as_py(), words)
                    fp = hashlib.blake2b(sh.tobytes(), digest_size=16).digest()
                    if fp not in seen:
                        seen[fp] = tuple(x.tobytes() for x in sign(sh))
                    for col, v in zip(cols, (fp, len(sh), *seen[fp]), strict=True):
                        col.append(v)
                arrays = [pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield _rows([part.column(0), part.column(1), *arrays], ["doc", "tie", "fp", "n", "keys", "tails", "sig"])

    sketched = checkpointed(rows.mapInArrow(sketch, f"{ID}, fp binary, n long, keys binary, tails binary, sig binary"))
    classes = checkpointed(
        sketched.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc", "tie")).alias("rep"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("n", "keys", "tails", "sig")))
        .select("fp", "rep.doc", "rep.tie", "rows", "n", "keys", "tails", "sig")
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree of each class."""
        for batch in batches:
            if batch.num_rows:
                at = pa.array(np.repeat(np.arange(batch.num_rows), trees))
                key, tail = (pa.array(np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64)) for i in (2, 3))
                yield _rows([batch.column(0).take(at), batch.column(1).take(at), key, tail], ["doc", "tie", "key", "tail"])

    entries = classes.select("doc", "tie", "keys", "tails").mapInArrow(unpack, f"{ID}, key long, tail long")
    n_classes, n_rows = classes.select(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    nodes = trie_nodes(entries, trees * n_classes, shortest, deepest, similar, trees, recall).join(classes.select("doc", "tie", "sig"), ["doc", "tie"])

    def edge_rows(t: pa.Table, at: np.ndarray, to: np.ndarray) -> list[pa.Array]:
        """Columns of edges from some rows of a group to others."""
        one = lambda name, k: t.column(name).combine_chunks().take(pa.array(k))
        return [one("doc", at), one("tie", at), one("doc", to), one("tie", to)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning edges of the texts of a trie node whose signatures may be similar."""
        for t in grouped(batches, 3):
            m = t.num_rows
            own, asked = (t.column(c).to_numpy() for c in ("own", "asked"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(m, values)
            near = np.zeros((m, m), bool)
            who = np.flatnonzero(asked)
            step = max(1, (4 << 20) // max(1, m * values))
            for a in range(0, len(who), step):
                near[who[a : a + step]] = (sig[who[a : a + step], None, :] == sig[None]).sum(2) >= least_equal
            near |= near.T
            if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
                near &= own[:, None] != own[None]
            label = forest(near)
            k = np.flatnonzero(label != np.arange(m))
            if len(k):
                yield _rows(edge_rows(t, k, label[k]), ["ud", "ut", "vd", "vt"])

    edges = (
        blocked(nodes, F.ceil(F.col("cnt") / BLOCK)).select("node", "bi", "bj", "own", "asked", "doc", "tie", "sig")
        .repartition(parts, "node", "bi", "bj").sortWithinPartitions("node", "bi", "bj")
        .mapInArrow(compare, "ud long, ut binary, vd long, vt binary")
    )
    pair = lambda: (F.struct(F.col("ud").alias("doc"), F.col("ut").alias("tie")).alias("u"), F.struct(F.col("vd").alias("doc"), F.col("vt").alias("tie")).alias("v"))
    found = components(edges.select(*pair())).select("node.doc", "node.tie", F.xxhash64("root.doc", "root.tie").alias("cluster"))
    clusters = checkpointed(found.join(classes.select("doc", "tie", "rows", "n"), ["doc", "tie"]))
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")
    members = joined(clusters, clusters.groupBy("cluster").agg(n_blocks, F.count(F.lit(1)).alias("cnt")), "cluster", n_classes).join(among(rows, clusters, ["doc", "tie"])[0], ["doc", "tie"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sh = [shingles(t.as_py(), words).tobytes() for t in part.column(part.num_columns - 1)]
                yield _rows([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(sh, pa.binary())], ["doc", "tie", "cluster", "blocks", "rows", "sh"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of links and spanning edges of one cluster, or of two of its blocks."""
        for t in grouped(batches, 3):
            ids = list(zip(t.column("doc").to_pylist(), t.column("tie").to_pylist(), strict=True))
            t = t.take(list({x: k for k, x in enumerate(ids)}.values()))  # a repeated row of a representative comes twice
            own, weight = (t.column(c).to_numpy() for c in ("own", "rows"))
            link = linked([np.frombuffer(x, U) for x in t.column("sh").to_pylist()], similar)
            if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
                link &= own[:, None] != own[None]
            n = link.astype(np.int64) @ weight
            label = forest(link)
            k = np.flatnonzero(n)
            if len(k):
                yield _rows([*edge_rows(t, k, label[k]), pa.array(n[k])], ["ud", "ut", "vd", "vt", "n"])

    links = checkpointed(
        blocked(members.select("doc", "tie", "cluster", "blocks", "rows", "text").mapInArrow(shingled, f"{ID}, cluster long, blocks long, rows long, sh binary"), F.col("blocks"))
        .select("cluster", "bi", "bj", "own", "doc", "tie", "rows", "sh")
        .repartition(parts, "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
        .mapInArrow(verify, "ud long, ut binary, vd long, vt binary, n long")
    )
    counts = links.groupBy(F.col("ud").alias("doc"), F.col("ut").alias("tie")).agg(F.sum("n").alias("others"))
    roots = components(links.select(*pair())).select("node.doc", "node.tie", F.col("root.doc").alias("rd"), F.col("root.tie").alias("rt"))
    by_class = classes.select("fp", "doc", "tie", "rows").join(counts, ["doc", "tie"], "left").join(roots, ["doc", "tie"], "left")
    by_class = by_class.select("fp", F.coalesce("rd", "doc").alias("root_doc"), F.coalesce("rt", "tie").alias("root_tie"), (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "rows")
    full = joined(sketched.where("n > 0").select("doc", "tie", "fp"), by_class, "fp", n_rows, "rows").drop("fp", "rows")
    return full.unionByName(sketched.where("n = 0").select("doc", "tie", F.col("doc").alias("root_doc"), F.col("tie").alias("root_tie"), F.lit(0).cast("long").alias("n_links")))


def linked(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``similar``; exact."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    f, o = flat[order], owner[order]
    new = np.r_[True, f[1:] != f[:-1]]
    col = np.cumsum(new) - 1
    count = np.bincount(col)
    keep = count[col] > 1  # a shingle of one text is in no intersection
    both = np.zeros((m, m), np.float32)
    if keep.any():
        o, col = o[keep], np.unique(col[keep], return_inverse=True)[1]
        width = max(1, min(4096, (16 << 20) // m))
        cuts = np.searchsorted(col, np.arange(0, col[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = np.zeros((m, width), np.float32)
            part[o[a:b], col[a:b] - k * width] = 1
            both += part @ part.T
    union = size[:, None] + size[None] - both
    out = both >= similar * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Rows that are the smallest of their group, columns as they came; of rows that repeat id and text one stays."""
    doc, tie, n, keep = fresh(docs, "doc", "tie", "n", "keep")
    kept = F.expr("doc = root_doc and tie = root_tie")
    found = near_duplicates(docs, similar).groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.first(kept).alias(keep), F.count(F.lit(1)).alias(n))
    odd = checkpointed(found.where(~F.col(keep) | (F.col(n) > 1)).select(doc, tie, keep))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), tie: tie_of(text)})
    some, others = among(own, odd, [doc, tie])  # rows that stay, and are no one's repetition, aren't shuffled
    some = some.join(odd, [doc, tie], "left").where(F.coalesce(keep, F.lit(True))).dropDuplicates([doc, tie])
    return some.select(*docs.columns).unionByName(others.select(*docs.columns))
