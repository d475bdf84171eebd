"""Corpus pipeline: five stages over ``documents``, each on all that the one before kept.

``run(spark, sf_dir)`` writes what every stage returns as Parquet in the shared
folder that ``spark.checkpoint.dir`` names (a folder of its own there) and reads
it again for the next stage, so a lost executor never costs more than one stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lshforest, packing, pii, toxicity
from tidemark.llm.common import fresh, shared_folder, table

#: Characters of a text, where a table carries their number.
SIZE = "n_chars"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from the labelled rows of the input."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of a five-word-shingle similarity of 0.8 make, the smallest doc_id stays."""
    return lshforest.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is generalised, revealing terms are removed."""
    (name,) = fresh(docs, "pii")
    clean = F.when(F.col("text").isNotNull(), F.col(name)["clean"])
    changed = {"text": clean} | ({SIZE: F.length(clean).cast("long")} if SIZE in docs.columns else {})
    return pii.sanitise(docs).withColumns(changed).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: A recurrent network, MinHash and a tokenizer aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
