"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, partitions


#: Edges for each task: less are not worth its files.
EDGES = 1 << 16


def fitted(rows: DataFrame, n: int) -> DataFrame:
    """As many partitions as ``n`` rows need, at most as many as there are."""
    return rows.coalesce(max(1, -(-n // EDGES)))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for edges (u, v) of any orderable type.

    Alternates large-star and small-star rounds until a round changes nothing;
    roots themselves are listed too. Each round is checkpointed, so that a lost
    executor costs one round. Tasks are as many as the edges need, since each leaves
    three files in a shuffle, however few its rows.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state, was = _state(now), None
    while state[0] and state != was:
        both = fitted(now, state[0]).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = with_least(both, 2 * state[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("of"))
        large = fitted(large.where("u > of").select("u", "v").distinct(), state[0])
        small = with_least(large, state[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = checkpointed(fitted(small.where("u > v").distinct(), state[0]))
        was, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_least(rows: DataFrame, total: int) -> DataFrame:
    """u, v, m of rows (u, v): m is the smallest of u and all v beside it.

    A u that holds more than its share of the ``total`` rows is a hub. There are
    fewer than four for each partition, so hubs are broadcast and their rows stay
    where they are; all others meet their minimum in a join.
    """
    most = max(64, total // (4 * partitions(rows.sparkSession)))
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = low.where(F.col("n") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    told = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    light = told.where("hub is null").select("u", "v").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return fitted(light.unionAll(told.where("hub is not null").select("u", "v", F.col("hub_m").alias("m"))), total)


def _state(edges: DataFrame) -> tuple:
    r = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(r)
