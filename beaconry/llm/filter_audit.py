"""Audit of how five filters interact, kept up to date by a stream that retracts.

All files are taken as available-now micro-batches. A document fails A to D by its own text; E if a smaller id has the same text, which
later files may still bring. So keyed state holds, for each text, the smallest id seen and the counts of the documents that have it. A
smaller id takes its place: what was counted for the earlier one without E is retracted and counted again with E. Each micro-batch
writes its changes of the part counters (documents by part, filters failed and labels) under its own number, so one that is repeated
after a failure replaces itself. The sum of the changes is exact after any split into files and batches and in any order of them.

Rows of one Arrow batch are combined by text before they are shuffled, so a text that a third of all rows have sends some rows a batch.
The report for all orders is made from the counters: at most 128 rows a part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import new_dir, staged

FILTERS = "ABCDE"
LEAST_WORDS = 200
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
#: Bytes that don't begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: The bit of filter E among the failed ones.
REPEATED = 1 << FILTERS.index("E")
#: Files in a micro-batch at least, and micro-batches in a run at most.
FILES, BATCHES = 4, 16
CHANGES = "part string, failed int, good boolean, toxic boolean, n bigint"
#: Of each text in a slot its smallest id, what it fails by itself, and how many documents have that id, by cell: the two labels as 0 or 1, then the part.
STATE = "digest array<binary>, low array<bigint>, failed array<int>, cell array<string>, n array<bigint>"
#: Texts in a slot, on average. A call of Python costs as much as some hundred texts do.
SLOT_TEXTS = 512


def own_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails by itself."""
    words = raw.split()  # on the six ASCII blanks
    n_chars = len(raw.translate(None, CONTINUATION))
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * n_chars
    marked = len(raw.translate(None, SYMBOLS)) < len(raw)
    return short | dull << 1 | loud << 2 | marked << 3


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """digest of the text, id, part and the filters among A to D that fail."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            digests, failed = [hashlib.sha256(t).digest() for t in texts], [own_failures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("id"), batch.column("part"), pa.array(failed, pa.int32())], ["digest", "id", "part", "failed"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    return rows.mapInArrow(read, "digest binary, id bigint, part string, failed int")


def combined(rows: DataFrame) -> DataFrame:
    """Counts per Arrow batch, text and kind. `id` is null where E is settled: the batch has a smaller one, or there is no id."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            least = x.groupby("digest")["id"].transform("min")
            later = x["id"] > least
            x["failed"] = np.where(later, x["failed"] | REPEATED, x["failed"])
            x["id"] = x["id"].where(~later)
            yield x.groupby(["digest", "id", "part", "failed", "good", "toxic"], as_index=False, dropna=False, sort=False).size().rename(columns={"size": "n"})

    return rows.mapInPandas(combine, f"digest binary, id bigint, {CHANGES}")


def counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the part counters by a micro-batch's documents of the texts of one slot."""
    lows: dict[bytes, tuple[int, int, Counter]] = {}  # by text: the smallest id, the text's own failures, that id's documents by cell
    if state.exists:
        for digest, low, failed, cell, n in zip(*state.get, strict=True):
            lows.setdefault(bytes(digest), (low, failed, Counter()))[2][cell] += n
    changes, moved = Counter(), False
    for frame in frames:
        for digest, i, part, failed, good, toxic, n in zip(*(frame[c].tolist() for c in ("digest", "id", "part", "failed", "good", "toxic", "n")), strict=True):
            cell = f"{good:d}{toxic:d}{part}"
            if i is None or i != i:  # settled
                changes[cell, failed] += n
                continue
            low, own, cells = lows.get(digest) or (None, failed, None)
            if low is None or i < low:
                for earlier, m in (cells or {}).items():
                    changes[earlier, own] -= m
                    changes[earlier, own | REPEATED] += m
                low, cells = i, Counter()
                lows[digest] = low, own, cells
            if i == low:
                cells[cell] += n
                changes[cell, own] += n
                moved = True
            else:
                changes[cell, own | REPEATED] += n
    if moved:
        rows = [(digest, int(low), int(own), cell, int(n)) for digest, (low, own, cells) in lows.items() for cell, n in cells.items()]
        state.update(tuple(map(list, zip(*rows, strict=True))))
    out = [(cell[2:], failed, cell[0] == "1", cell[1] == "1", n) for (cell, failed), n in changes.items() if n]
    yield pd.DataFrame(out, columns=["part", "failed", "good", "toxic", "n"])


def streamed(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream of so many files a micro-batch. The table is a folder or, which a stream takes as a pattern only, one file."""
    whole = spark.read.parquet(path)
    files = files or max(FILES, -(-len(whole.inputFiles()) // BATCHES))
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def slots_of(spark: SparkSession, folder: str, texts: int) -> int:
    """Slots of the state for so many texts. The first run with a folder settles their number for all later ones."""
    path = f"{folder}/slots"
    try:
        return spark.read.schema("slots bigint").parquet(path).first()["slots"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    slots = max(64, -(-texts // SLOT_TEXTS))
    spark.createDataFrame([(slots,)], "slots bigint").coalesce(1).write.parquet(path)
    return slots


def counters(docs: DataFrame, labels: DataFrame, folder: str, texts: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, failed (bits of the filters that fail), good, toxic and n of a stream of documents, read until it has no more.

    `folder`, shared by driver and executors, keeps the stream's place, its state and its changes. A run with an earlier run's folder
    reads only what is new, and its counters are those of all files together. The state store is the session's choice; `texts` says for how
    many texts it is laid out (more make its slots larger).
    """
    spark = docs.sparkSession
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(mark("quality"), mark("toxic"))
    marks = staged(marks.withColumnRenamed("quality", "good"), "marks")
    known = facts(docs, id_col, text_col, part_col).join(marks, F.col("id") == F.col("_id"), "left").drop("_id")
    known = known.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    slot = F.pmod(F.xxhash64("digest"), F.lit(slots_of(spark, folder, texts)))
    changes = combined(known).withColumn("slot", slot).groupBy("slot").applyInPandasWithState(counted, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, n: int) -> None:
        batch.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    start = spark.createDataFrame([], CHANGES)  # so that there is something to read if there is no file
    start.write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    changes.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(CHANGES).parquet(f"{folder}/changes")
    return made.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def total(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(name)


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.explode(F.lit(["".join(p) for p in itertools.permutations(FILTERS)])).alias("filter_order")
    rows = counts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.expr("substr(filter_order, 1, step - 1)")
    rows = rows.withColumns(
        {
            "letter": F.expr("substr(filter_order, step, 1)"),
            "earlier": sum((F.when(F.instr(before, x) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(FILTERS)), F.lit(0)),
        }
    ).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', letter) - 1)"))
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("earlier")) != 0
    out = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"), total(F.col("failed") == F.col("bit"), "unique_fails"),
        total(fails & ~gone & F.col("good"), "good_lost"), total(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audited(docs: DataFrame, labels: DataFrame, folder: str | None = None, texts: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of a stream of documents: part, filter_order, step (its filter is the order's letter of that place) and the counts.

    kept: left after the step. removed: gone here. redundant: fails this filter, gone before. unique_fails: fails no other filter.
    good_lost, toxic_lost: removed here with that label. shapley: removed by the step's filter, summed over all orders.

    A null text counts as empty, a null part as the empty string. Filter E compares ids: a document without an id neither fails it nor makes
    others fail it, and rows that repeat an id and a text don't fail it for each other. A label counts if any row of the id has it.
    Every part that has a document has all 600 rows; an empty table has none. Extra columns take no part.
    """
    return report(counters(docs, labels, folder or new_dir(docs.sparkSession, "filter-audit"), texts, id_col, text_col, part_col))
