"""Keyed state: event keys, upserts by policy, list cells and identifiers."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import list_cell


def event_key(source: Column, native: Column, payload: Column) -> Column:
    """source:native, or a key from the payload's hash where there is no native id."""
    named = F.coalesce(F.trim(native), F.lit("")) != ""
    return F.when(named, F.concat(source, F.lit(":"), native)).otherwise(F.concat(source, F.lit(":h:"), F.substring(F.sha2(payload, 256), 1, 24)))


def upserted(state: DataFrame, batch: DataFrame, key: str, order: str, kept: list[str], touched: list[str]) -> DataFrame:
    """New state after a batch: unknown keys are inserted as first met, known ones only get `touched` columns of the last meeting.

    Both sides have the key and all columns; `order` ranks the batch's rows. Doing a batch twice changes nothing. The batch is
    aggregated before it is joined, so a key met many times costs one row.
    """
    first = F.min_by(F.struct(*kept), order)
    last = F.max_by(F.struct(*touched), order)
    met = batch.groupBy(key).agg(first.alias("f"), last.alias("l"))
    both = state.withColumn("_old", F.lit(True)).join(met, key, "full_outer")
    return both.select(
        key,
        *(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"f.{c}")).alias(c) for c in kept),
        *(F.coalesce(F.col(f"l.{c}"), F.col(c)).alias(c) for c in touched),
    )


def new_and_seen(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: rows of the batch, and keys that the state didn't have."""
    fresh = batch.select(key).distinct().join(state.select(key), key, "left_anti").agg(F.count("*").alias("new"))
    return batch.agg(F.count("*").alias("seen")).crossJoin(fresh)  # one row each


def refreshed(state: DataFrame, seed: DataFrame, key: str, refresh: list[str], frozen: list[str]) -> DataFrame:
    """Configuration after a reload: new keys whole, known ones with `refresh` columns from the seed, others as edited."""
    s = seed.select(key, *(F.col(c).alias(f"_s_{c}") for c in [*refresh, *frozen]), F.lit(True).alias("_in"))
    both = state.withColumn("_old", F.lit(True)).join(s, key, "full_outer")
    return both.select(
        key,
        *(F.when(F.col("_in"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in refresh),
        *(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c) for c in frozen),
    )


def list_rows(rows: DataFrame, key: str, cell: str, out: str) -> DataFrame:
    """One row per value of a list cell, each once."""
    return rows.select(key, F.explode(F.array_distinct(list_cell(F.col(cell)))).alias(out))


def identifiers_filled(rows: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """Blank identifiers filled from `ids` (key, value); a value offered for several keys, or a null one, fills none."""
    once = ids.where("value is not null").groupBy("value").agg(F.count("*").alias("_n"), F.first(key).alias(key))
    single = once.where("_n = 1").select(key, "value")
    return rows.join(single, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.col("value"))).drop("value")


MANIFEST = "name string, folder string, rows bigint, checksum string, columns string"


def measured_table(df: DataFrame) -> DataFrame:
    """One row: a table's rows and a checksum over all its cells, whatever their order."""
    cells = [F.to_json(F.col(f"`{name}`")) if kind.startswith("map") else F.col(f"`{name}`") for name, kind in df.dtypes]
    mark = F.xxhash64(*cells, F.concat_ws(",", *(c.isNull().cast("string") for c in cells))) if cells else F.lit(0)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def export_snapshot(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Every table as Parquet below a folder of its own, and at last a manifest of all of them; the tables' folders.

    What stands in the files is measured, not what was to be written. While it is written, and if it is torn, the export can't be read.
    """
    if not tables or "manifest" in tables:
        raise ValueError("an export needs tables, none of them called manifest")
    rows, spark = [], next(iter(tables.values())).sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        m = measured_table(spark.read.schema(df.schema).parquet(path)).first()
        rows.append((name, path, m["rows"], m["checksum"], df.schema.json()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return [path for _, path, *_ in rows]


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an export. Raises ValueError if it has no manifest or a table isn't as the manifest says."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()  # a row a table
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        manifest = []
    if not manifest:
        raise ValueError(f"{folder} is no whole export")
    out = {}
    for r in manifest:
        try:
            out[r["name"]] = df = spark.read.schema(StructType.fromJson(json.loads(r["columns"]))).parquet(r["folder"])
            m = measured_table(df).first()
        except PySparkException as e:
            raise ValueError(f"table {r['name']} of {folder} can't be read") from e
        if (m["rows"], m["checksum"]) != (r["rows"], r["checksum"]):
            raise ValueError(f"table {r['name']} of {folder} has {m['rows']} rows with another checksum or number than the manifest's {r['rows']}")
    return out


def unmet_parents(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and those whose doesn't."""
    known = parents.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")
