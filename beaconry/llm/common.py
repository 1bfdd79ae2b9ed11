"""What the corpus operators share: tables, the shared folder, unused column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry import session

#: Rows in one Arrow batch. Documents may be long, so batches are short.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch; a longer document has a batch of its own.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Arrow batches of the session are kept short, in rows and in bytes, from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return session.table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; if unset, one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, stem: str) -> str:
    """A fresh folder name below the shared folder; the writer creates it."""
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def staged(df: DataFrame, stem: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back, which cuts the lineage.

    The files outlive any executor, so a later failure recomputes nothing before them.
    """
    path = new_dir(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    n = 0
    while f"{stem}_{n}" in taken:
        n += 1
    return f"{stem}_{n}"


def longs(values: list[int]) -> Column:
    """An array of numbers as one literal, however long."""
    return F.lit(np.array(values, np.int64))


def first_place(n: int, before: Callable[[Column], Column]) -> Column:
    """How many of n places, which hold first and don't later, hold by `before` (of a place's number, null or false past the last): a binary search."""
    steps = F.lit(np.array([1 << i for i in reversed(range(n.bit_length()))], np.int32))
    return F.aggregate(steps, F.lit(0), lambda found, by: F.when(before(found + by - 1), found + by).otherwise(found))
