"""Nearest neighbours from randomly rotated one-bit codes.

Vectors are dealt to the nearest of a few centres. Each, less its centre and
rotated at random, is kept as the signs of its components, its length and one
correction scalar. Inner products with a query are estimated from the packed bits;
the scalar gives an error bound of ``SIGMAS`` standard deviations, and only vectors
whose lower bound on the distance isn't beyond the k-th best so far are compared
exactly, in double precision.

Centres and rotation come from a bounded sample (``SAMPLE`` vectors); every row is
indexed. Cells are cut into chunks of about ``CHUNK`` vectors. Queries are rows of a
table like the vectors: first each meets one chunk of its nearest cell, which
bounds its k-th distance; then it goes to the chunks of all cells whose radius that
bound reaches. A task holds one chunk and streams the queries that come to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, partitions

SAMPLE, CELLS, CHUNK, SIGMAS = 10_000, 1024, 16_384, 3.0
#: Queries compared with a chunk in one step, and pairs of one exact step.
STEP, PAIRS = 128, 1 << 16


def usable(vectors: DataFrame, d: int | None = None) -> DataFrame:
    """vec_id, embedding (doubles) of rows that take part: one for each id, of d components (the commonest number if None).

    Null ids, and vectors null, empty, zero or with a null or non-finite
    component don't. Of rows that repeat an id the smallest vector counts.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    if d is None:
        top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        d = top["d"] if top else 0
    return rows.where(F.size("embedding") == d)


class Codes:
    """Centres of cells and a rotation, from a sample."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.matrix = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.centers = sample[rng.permutation(len(sample))[:cells]]
        for _ in range(10):
            near = self.nearest(sample)
            n = np.bincount(near, minlength=len(self.centers))
            sums = np.zeros_like(self.centers)
            np.add.at(sums, near, sample)
            self.centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centers)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        square = (self.centers**2).sum(1)
        for a in range(0, len(x), 4096):
            out[a : a + 4096] = (square[None] - 2 * x[a : a + 4096] @ self.centers.T).argmin(1)
        return out

    def turned(self, x: np.ndarray, cell: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors from the centre, after the rotation, and lengths."""
        r = (x - self.centers[cell]) @ self.matrix
        n = np.sqrt((r * r).sum(1))
        return r / np.where(n > 0, n, 1)[:, None], n

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, packed signs, lengths and correction scalars."""
        cell = self.nearest(x)
        u, n = self.turned(x, cell)
        return cell, np.packbits(u > 0, axis=1), n, np.abs(u).sum(1) / np.sqrt(x.shape[1])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


INDEXED = "cell int, vec_id long, embedding array<double>, code binary, length double, scalar double"


def index(rows: DataFrame, codes: Codes) -> DataFrame:
    """cell, vec_id, embedding, code, length, scalar of every row."""
    d = codes.matrix.shape[0]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code, n, f = codes.codes(matrix(b.column(1), d))
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), b.column(1), packed, pa.array(n), pa.array(f)], names=["cell", "vec_id", "embedding", "code", "length", "scalar"])

    return rows.mapInArrow(build, INDEXED)


class Chunk:
    """Indexed vectors of one cell, ready to be compared with queries."""

    def __init__(self, codes: Codes, cell: int, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, length: np.ndarray, scalar: np.ndarray):
        self.codes, self.cell, self.ids, self.vectors = codes, cell, ids, vectors
        d = vectors.shape[1]
        self.signs = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
        f = np.maximum(scalar, 1e-12)
        self.slack = (SIGMAS * np.sqrt(np.maximum(0, 1 - f * f) / (f * f)) / np.sqrt(max(1, d - 1))).astype(np.float32)
        self.over, self.length = (1 / f).astype(np.float32), length.astype(np.float32)

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query (by its number), vec_id and distance of each query's k nearest here, none beyond its bound; and how many were compared exactly."""
        u, n = self.codes.turned(queries, self.cell)
        u, n32 = u.astype(np.float32), n.astype(np.float32)
        reach = np.minimum(1, (u @ self.signs.T) * self.over + self.slack)
        base = n32[:, None] ** 2 + self.length[None] ** 2
        low = base - 2 * n32[:, None] * self.length[None] * reach - np.float32(1e-5) * base
        low[query_ids[:, None] == self.ids[None]] = np.inf
        limit = bound * bound
        if low.shape[1] > 8 * k:  # those that look nearest first: they tighten the bound for the rest
            first = np.argpartition(low, 4 * k, axis=1)[:, : 4 * k]
            near = np.sqrt(((self.vectors[first] - queries[:, None]) ** 2).sum(2))
            near[self.ids[first] == query_ids[:, None]] = np.inf
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] ** 2)
        q, v = np.nonzero(low <= (limit * (1 + 1e-9) + 1e-12)[:, None])
        dist = np.empty(len(q))
        for a in range(0, len(q), PAIRS):
            diff = self.vectors[v[a : a + PAIRS]] - queries[q[a : a + PAIRS]]
            dist[a : a + PAIRS] = np.sqrt((diff * diff).sum(1))
        keep = (dist <= bound[q]) & (self.ids[v] != query_ids[q])
        q, ids, dist = q[keep], self.ids[v[keep]], dist[keep]
        order = np.lexsort((ids, dist, q))
        q, ids, dist = q[order], ids[order], dist[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        return q[top], ids[top], dist[top], len(v)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` by Euclidean distance.

    ``queries`` has vec_id and embedding like ``vectors``; a query's own id isn't
    a candidate. With fewer candidates all are returned. What takes part, see
    ``usable``; other columns aren't carried.
    """
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors))
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sample.shape[1]
    codes = Codes(sample, max(1, min(CELLS, len(sample) // 10, rows.count() // CHUNK)))
    coded = checkpointed(index(rows, codes))
    cells = {r["cell"]: (-(-r["n"] // CHUNK), r["radius"]) for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("radius")).collect()}  # at most CELLS rows
    chunks = F.element_at(F.create_map(*(F.lit(x) for c, (n, _) in sorted(cells.items()) for x in (c, n))), F.col("cell"))
    dealt = coded.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int"))
    asked = checkpointed(usable(queries, d))

    def visits(everywhere: bool):
        """Rows of queries (vec_id, embedding, bound) for the chunks that they have to meet."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sorted(cells)
            radius = np.array([cells[c][1] for c in own])
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    x, bound = matrix(b.column(1), d), b.column(2).to_numpy()
                    if everywhere:
                        apart = np.sqrt(((x[:, None] - codes.centers[own][None]) ** 2).sum(2))
                        q, c = np.nonzero(apart - radius[None] <= bound[:, None] * (1 + 1e-9) + 1e-9)
                        n = np.array([cells[k][0] for k in own])[c]
                        q, c = np.repeat(q, n), np.repeat(np.array(own)[c], n)
                        chunk = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                    else:
                        near = ((x[:, None] - codes.centers[own][None]) ** 2).sum(2).argmin(1)
                        q, c = np.arange(len(x)), np.array(own)[near]
                        chunk = b.column(0).to_numpy() % np.array([cells[k][0] for k in c.tolist()])
                    at_q = pa.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(chunk.astype(np.int32)), *(b.column(i).take(at_q) for i in range(3))], names=["cell", "chunk", "vec_id", "embedding", "bound"])

        return send

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a chunk, then the queries that come to it; rows are sorted so."""
        here, held, chunk = None, [], None
        for whole in batches:
            key = [whole.column(i).to_numpy() for i in range(3)]
            cuts = [0, *(1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0))).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, place = whole.slice(a, b - a), (int(key[0][a]), int(key[1][a]))
                if place != here:
                    here, held, chunk = place, [], None
                if key[2][a] == 0:
                    held.append(part)
                    continue
                if chunk is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    vectors_ = t.column("embedding").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    chunk, held = Chunk(codes, here[0], t.column("vec_id").to_numpy(), vectors_, code, t.column("length").to_numpy(), t.column("scalar").to_numpy()), []
                if chunk is not None:
                    for at in range(0, part.num_rows, STEP):
                        own = part.slice(at, STEP)
                        ids = own.column(3).to_numpy()
                        q, near, dist, _ = chunk.nearest(matrix(own.column(4), d), ids, own.column(8).to_numpy(), k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(near), pa.array(dist)], names=["query_id", "vec_id", "score"])

    def met(asking: DataFrame) -> DataFrame:
        nothing = (F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("length"), F.lit(0.0).alias("scalar"))
        ours = dealt.select("cell", "chunk", F.lit(0).alias("kind"), "vec_id", "embedding", "code", "length", "scalar", F.lit(0.0).alias("bound"))
        both = ours.unionAll(asking.select("cell", "chunk", F.lit(1).alias("kind"), "vec_id", "embedding", *nothing, "bound"))
        return both.repartition(partitions(spark), "cell", "chunk").sortWithinPartitions("cell", "chunk", "kind").mapInArrow(scanned, "query_id long, vec_id long, score double")

    visit = "cell int, chunk int, vec_id long, embedding array<double>, bound double"
    first = met(asked.withColumn("bound", F.lit(float("inf"))).mapInArrow(visits(False), visit))
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
    told = checkpointed(asked.join(bounds, "vec_id", "left").select("vec_id", "embedding", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met(told.mapInArrow(visits(True), visit)).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
