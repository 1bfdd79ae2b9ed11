"""The corpus pipeline: from raw documents to shards, stage by stage.

Each stage works on all that its predecessor kept, is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm import decontaminate, mixing, near_dedup, quality, sharding
from beaconry.llm.common import staged, table
from beaconry.llm.queries import MIX_EXPONENT, SHARDS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.kept(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are 0.8 alike or more, linked in any number of steps, one stays."""
    return near_dedup.deduplicated(docs, k=5, threshold=80, once=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark windows go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the schedule's order: the mix first, then what is left when a source of weight has run out."""
    mix = mixing.mixed(docs, mixing.temperature_weights(docs, MIX_EXPONENT))
    return mix.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its shard and its slot there: a shard's slots are in the order in which the rows were written, which is the mix's.

    A row's file and its number there stand for that order and find its text again, so that texts are dealt out once. Takes rows as read from files.
    """
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = docs.select("*", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = sharding.sharded(rows, SHARDS, keep=("file", "row"))
    placed = sharding.in_order(placed, "file", "row").drop("doc_id")
    return rows.join(placed, ["file", "row"]).select("doc_id", "size", "text_crc32", "shard", "slot", "lang", "source", "n_chars", "text")


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the fitted scorer, the sketches or the ring; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
