"""What modules of registered queries share: a registry, tables, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s


class Registry:
    """Queries by the names of their functions, and the SQL of those that have some."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x: Column, digits: int = 4) -> Column:
    return s.js_round(x, digits)


def eighths(vector: Column) -> Column:
    """Ten times the mean of each eighth of a vector of 64: eight levels that all components are in."""
    part = lambda k: F.aggregate(F.slice(vector, 8 * k + 1, F.lit(8)), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: part(k) / 8 * 10)


def rs(x: str, digits: int = 4) -> str:
    """The same in SQL: ties go up."""
    return f"(floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)})"


def values(rows: list[tuple], names: str) -> str:
    """A table of constants in SQL."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, row)) + ')' for row in rows)}) AS t({names})"


def asked(spark: SparkSession, sf: str, key: str, names: list[str]) -> DataFrame:
    """p_partkey and ``key``: the one of ``names`` that each part asks for, in turn."""
    of = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", of.alias(key))


def asked_sql(sql: str, key: str, names: list[str]) -> str:
    """The rows of ``sql`` for each part's own name."""
    each = ", ".join(f"'{n}'" for n in names)
    return f"SELECT * FROM ({sql}) JOIN (SELECT p_partkey, [{each}][1 + p_partkey % {len(names)}] AS {key} FROM part) USING ({key})"


CYCLES, VECTORS = 6, 500


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk rows, with sample_rate, of stereo clips: every vector is a cycle, played six times; 500 vectors in order are a clip.

    The right channel plays half of each cycle, and half of it backwards.
    """
    e = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    clip = F.floor(F.col("vec_id") / VECTORS)
    right = F.zip_with("v", F.reverse("v"), lambda a, b: (a + b) / 2)
    own = e.select(clip.alias("clip"), "vec_id", F.posexplode(F.array("v", right)).alias("channel", "v"))
    samples = F.flatten(F.array_repeat("v", CYCLES)).cast("array<float>")
    w = Window.partitionBy("clip", "channel").orderBy("vec_id")  # VECTORS rows at most
    rows = own.select("clip", "channel", "vec_id", samples.alias("samples"))
    rows = rows.withColumns({
        "chunk_idx": F.row_number().over(w) - 1,
        "start_frame": F.sum(F.size("samples")).over(w) - F.size("samples"),
    })
    return rows.select(
        F.concat(F.lit("clip-"), F.col("clip").cast("string")).alias("clip_id"), "channel", F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.col("start_frame").cast("long").alias("start_frame"), F.size("samples").alias("frame_count"), "samples", F.lit(48_000).alias("sample_rate"),
    )
