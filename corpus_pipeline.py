"""A corpus from raw documents to shards: five stages, each one operator of callweight.llm.

Every stage gets the rows its predecessor kept, as a table read from Parquet, and its decisions
take effect: rejected, repeated and contaminated documents go, mixed documents appear as often as
they are taken, and the last stage gives every row its shard.

All stages keep every column of their input, whatever its name, read whole texts however long, and
return no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweight.llm import decontam, jaccard, mixing, quality, shards
from callweight.llm.scale import Scratch, passing, tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote does not reject; learned as in op1_quality.

    Null and empty texts are judged like any text without words. Equal texts go or stay together.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return quality.keep_good(docs, tables(spark, sf_dir, "labels"), held_out, cut=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.75.

    The smallest id stays; null, empty and wordless texts are in no group and stay.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks.

    Null and empty texts stay; rows that share an id go or stay together.
    """
    return decontam.clean(docs, tables(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source schedule takes them.

    A null source is a source; null, empty and wordless texts are not taken.
    """
    return mixing.realise(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard by jump consistent hashing, which replaces a column `shard`.

    Null ids share a shard; repeated rows share theirs.
    """
    return shards.shard_rows(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Votes, similarity components and the schedule are not expressible in SQL; tests/llm compare the
#: stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written and read again in between.

    Tables of a stage, its input too, are removed once its output is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing():
            kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
