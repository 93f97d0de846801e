"""A corpus pipeline over the table documents: language, near duplicates, contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of docs; the last adds shard and slot.  A stage
works on the Parquet files its predecessor wrote.  Null, repeated and empty inputs: see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm._common import drop_parked, park, parked
from lintlake.llm.decontamination import remove_contaminated
from lintlake.llm.jaccard import one_of_each
from lintlake.llm.language import accepted
from lintlake.llm.mixing import mixed
from lintlake.llm.sharding import sharded


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language stands out, or without letters, go."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter one) go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken by their weights; documents of sources asked for more than they have are repeated."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    return sharded(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: The stages' similarity join, language profiles and order of mixing have no SQL form; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each result written to the shared folder and read again.

    What a stage parked goes once its result is written, all of it if a stage fails; the last stage's goes with drop_parked.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), parked()
    try:
        for name, stage in STAGES[:-1]:
            docs = park(stage(spark, docs, sf_dir), name)
            drop_parked(spark, mark, keep=1)
        return STAGES[-1][1](spark, docs, sf_dir)
    except Exception:
        drop_parked(spark, mark)
        raise
