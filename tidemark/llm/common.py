"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids have to be ordered: before every other id.
NULL_ID = -(2**63)
#: Bits of the map that tells rows apart by a table of keys.
KEY_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local master gets a folder of its own; a cluster is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-checkpoints')}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def partitions(spark: SparkSession, least: int = 8) -> int:
    """Reduce-side parallelism, as the session is configured."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def joined(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str = "cnt") -> DataFrame:
    """``rows`` of groups by ``key`` with the facts of their group, one of which is its number of rows.

    Groups of more than a quarter of a partition's share of the ``total`` rows are
    fewer than four for each partition. Their facts are broadcast, so that the
    rows of a hot key stay where they are. Groups without facts go.
    """
    most = max(64, total // (4 * partitions(rows.sparkSession)))
    large = facts.where(F.col(count) > most)
    told = rows.join(F.broadcast(large.withColumn("is_large", F.lit(True))), key, "left")
    light = told.where("is_large is null").select(*rows.columns).join(facts.where(F.col(count) <= most), key)
    return light.unionByName(told.where("is_large").drop("is_large"))


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the keys, and rows that have none; both stay where they are.

    A bitmap of fixed size (2 MB, ``KEY_BITS``) of the keys is broadcast, so that a
    join that few of the rows take part in need not shuffle the others. Every row is in
    one of the two. ``keys`` is read here and again by the join: it should be stored.
    """
    names = fresh(rows, "bucket", "place", "bits")
    bucket, place, bits = names
    told = lambda df: df.withColumn(place, F.pmod(F.xxhash64(*on), F.lit(KEY_BITS)) + 1).withColumns({bucket: F.bitmap_bucket_number(place), place: F.bitmap_bit_position(place)})
    maps = told(keys.select(*on)).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    is_set = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    met = told(rows).join(F.broadcast(maps), bucket, "left")
    return met.where(is_set).select(*rows.columns), met.where(~is_set).select(*rows.columns)


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches re-cut so that each holds about ``most_bytes`` or a single row.

    Long texts therefore never add up to more memory than one slice.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        per_row = max(1, batch.nbytes // n)
        step = max(1, most_bytes // per_row)
        for at in range(0, n, step):
            yield batch.slice(at, step)
