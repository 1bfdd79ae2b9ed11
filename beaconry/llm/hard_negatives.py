"""Hard-negative mining with exact integer scores by the method of Four Russians.

Components are quantized to whole numbers. A candidate is kept as its bit planes: bit p of eight neighbouring components makes
one byte. For an anchor, each group of eight dimensions has a table of its 256 subset sums, so a byte looks up what its plane
and group add to the inner product; the planes' sums are shifted to their weight and added (the sign's plane is taken away).
That gives full scores, with no rounding and no multiplication by a candidate's components.

The anchors are a stated query set. They are taken in blocks of `ANCHORS` rows, each sent to the tasks that read the packed
candidates; vectors are never shuffled, and a task keeps the best of each anchor only. A first pass finds an anchor's positives, the
second its negatives between two shares of each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, staged

#: Anchors that are held against the candidates at once: their tables take 256 sums per group of eight dimensions each.
ANCHORS = 2048
#: Candidates scored at once.
CHUNK = 256
#: Found rows that a task gathers before it keeps the best of each key.
GATHERED = 400_000
SCALE = 256
LOWEST = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and v of the rows that take part: with an id and a label, without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


@dataclass(frozen=True)
class Layout:
    """How vectors are packed: `groups` of eight dimensions, `planes` bits of two's complement."""

    groups: int
    planes: int

    @staticmethod
    def of(rows: DataFrame, scale: int) -> Layout:
        """Holds every row. Scores that might not fit 64 bits are an error, as they would not be exact."""
        size = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
        most = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.coalesce(F.max(size), F.lit(0.0)).alias("size")).first()
        groups = -(-most["dims"] // 8)
        planes = (int(most["size"] * scale) + 1).bit_length() + 1 if most["size"] * scale < 2.0**62 else 64
        if (groups * 8) << (2 * planes - 2) >= 1 << 63:
            raise ValueError(f"components up to {most['size']:g} in {most['dims']} dimensions give scores beyond 64 bits")
        return Layout(groups, planes)

    def quantized(self, column: pa.Array, scale: int) -> np.ndarray:
        """floor(scale * x) of each row; a shorter row counts as followed by zeros."""
        n = len(column)
        ends = np.asarray(column.offsets)
        sizes, at = np.diff(ends), np.arange(ends[-1] - ends[0])
        row = np.repeat(np.arange(n), sizes)
        out = np.zeros((n, self.groups * 8), np.int64)
        out[row, at - (ends[:-1] - ends[0])[row]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
        return out

    def packed(self, m: np.ndarray) -> np.ndarray:
        """Bytes by row, plane and group."""
        bits = (m[:, None, :] >> np.arange(self.planes)[None, :, None]) & 1
        return np.packbits(bits.astype(np.uint8).reshape(len(m), self.planes, self.groups, 8), axis=3, bitorder="little")[..., 0]

    def unpacked(self, b: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(b[..., None], axis=3, bitorder="little").reshape(len(b), self.planes, -1).astype(np.int64)
        weight = 1 << np.arange(self.planes)
        weight[-1] *= -1
        return (bits * weight[None, :, None]).sum(axis=1)

    def bytes_of(self, column: pa.Array) -> np.ndarray:
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, np.uint8).reshape(len(column), self.planes, self.groups)


class Anchors:
    """Subset-sum tables of a block of anchors."""

    def __init__(self, m: np.ndarray, layout: Layout):
        self.layout = layout
        small = np.abs(m).sum(axis=1).max(initial=0) < 1 << 31
        self.sums = np.zeros((layout.groups, 256, len(m)), np.int32 if small else np.int64)
        by_dim = m.T.reshape(layout.groups, 8, len(m))
        for i in range(8):
            self.sums[:, 1 << i : 2 << i] = self.sums[:, : 1 << i] + by_dim[:, i : i + 1]

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """Inner products of candidates (rows) with all anchors (columns)."""
        out = np.zeros((len(planes), self.sums.shape[2]), np.int64)
        for p in range(self.layout.planes):
            plane = np.zeros(out.shape, self.sums.dtype)
            for g in range(self.layout.groups):
                plane += self.sums[g][planes[:, p, g]]
            shifted = plane.astype(np.int64) << p
            if p == self.layout.planes - 1:
                out -= shifted
            else:
                out += shifted
        return out


class Best:
    """The k best (score, then smaller id) of each of `keys` keys, of any number of rows, in bounded memory."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, LOWEST)
        self.rows, self.waiting = [np.empty(0, np.int64)] * 3, []

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((key, score, ids))
        if sum(len(x[0]) for x in self.waiting) >= GATHERED:
            self.settle()

    def settle(self) -> None:
        key, score, ids = (np.concatenate([a, *(w[i] for w in self.waiting)]) for i, a in enumerate(self.rows))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        rank = np.arange(len(key)) - first
        kept = rank < self.k
        self.rows, self.waiting = [key[kept], score[kept], ids[kept]], []
        last = rank == self.k - 1
        self.least[key[last]] = score[last]


def mined(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    A score is the whole inner product of components floor(scale * x). An anchor is a row for which `is_anchor`, a condition on id_col,
    holds; its positives are its best rows of the same label and another id, ties by smaller id. For each positive come the best rows of
    other labels whose score is from window[0] to window[1] hundredths of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. A shorter vector counts as followed by
    zeros, an empty one as zeros. Repeated rows count as often as they come, so an id may be found several times; an anchor that is
    repeated is answered each time. An anchor without positives or without negatives has no rows, nor has an empty table.
    Integer labels only. Components so large that a score might leave 64 bits raise ValueError.
    """
    spark, (low, high) = vectors.sparkSession, window
    rows = usable(vectors, id_col, vector_col, label_col)
    layout = Layout.of(rows, scale)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = layout.packed(layout.quantized(batch.column("v"), scale))
            raw = pa.array([x.tobytes() for x in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), raw], ["id", "label", "planes"])

    packed = staged(rows.mapInArrow(pack, "id bigint, label bigint, planes binary"), "bit-planes")
    named = packed.withColumnRenamed("id", id_col).where(is_anchor).withColumnRenamed(id_col, "id")
    anchors = staged(named.withColumn("at", F.monotonically_increasing_id()), "anchors")
    out = new_dir(spark, "hard-negatives")
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    blocks = ranges(anchors)
    for n, (start, end) in enumerate(blocks):
        block = anchors.where((F.col("at") >= start) & (F.col("at") < end)).orderBy("at").toArrow()  # ANCHORS rows at most
        a_id, a_label = (block[c].to_numpy() for c in ("id", "label"))
        own = spark.sparkContext.broadcast((a_id, a_label, layout.unpacked(layout.bytes_of(block["planes"].combine_chunks()))))
        like = best_of(packed, own, None, layout, positives).collect()  # `positives` rows an anchor at most
        target = np.full((len(a_id), positives), LOWEST)
        positive_id = np.zeros((len(a_id), positives), np.int64)
        for r in like:
            target[r["key"], r["rank"] - 1], positive_id[r["key"], r["rank"] - 1] = r["score"], r["id"]
        scores = [int(x) for x in target.ravel()]
        least = np.array([-(-low * x // 100) if x != LOWEST else 0 for x in scores], np.int64).reshape(target.shape)
        most = np.array([high * x // 100 if x != LOWEST else -1 for x in scores], np.int64).reshape(target.shape)  # no score, nothing fits
        found = best_of(packed, own, spark.sparkContext.broadcast((least, most)), layout, negatives)
        keys = pa.table({"key": pa.array(np.arange(target.size)), "anchor_id": np.repeat(a_id, positives), "positive_id": positive_id.ravel(), "positive_score": target.ravel()})
        facts = F.broadcast(spark.createDataFrame(keys))  # one row an anchor and positive
        joined = found.join(facts, "key").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        joined.select(*(c.split()[0] for c in result.split(", "))).write.parquet(f"{out}/block={n}")
    if not blocks:
        return spark.createDataFrame([], result)
    return spark.read.schema(result).parquet(*(f"{out}/block={n}" for n in range(len(blocks))))


def ranges(anchors: DataFrame) -> list[tuple[int, int]]:
    """Ranges of `at` that hold ANCHORS rows at most. `at` is a partition's number, 33 bits up, and a row's number in it."""
    counts = sorted((r["part"], r["count"]) for r in anchors.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    out, start, room = [], 0, ANCHORS
    for part, count in counts:
        used = 0
        while count - used > room:
            used += room
            end = (part << 33) + used
            out.append((start, end))
            start, room = end, ANCHORS
        room -= count - used
    if counts and (room < ANCHORS or start == 0):
        out.append((start, (counts[-1][0] + 1) << 33))
    return out


def best_of(packed: DataFrame, own, windows, layout: Layout, k: int) -> DataFrame:
    """key, rank, id and score of the k best candidates of each key.

    Without windows a key is an anchor's number, and candidates have its label and another id. Windows are the least and most
    scores by anchor and positive: a key is the anchor's number times the positives plus the positive's, and candidates have another label.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_id, a_label, m = own.value
        tables = Anchors(m, layout)
        low, high = windows.value if windows else (None, None)
        slots = low.shape[1] if windows else 1
        best = Best(len(a_id) * slots, k)
        for batch in batches:
            ids, labels, planes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), layout.bytes_of(batch.column(2))
            for at in range(0, len(ids), CHUNK):
                i, label = ids[at : at + CHUNK], labels[at : at + CHUNK]
                score = tables.scores(planes[at : at + CHUNK])
                same = label[:, None] == a_label[None, :]
                for j in range(slots):
                    least = best.least[j::slots]
                    fits = score >= least[None, :]
                    if windows:
                        fits &= ~same & (score >= low[None, :, j]) & (score <= high[None, :, j])
                    else:
                        fits &= same & (i[:, None] != a_id[None, :])
                    row, anchor = np.nonzero(fits)
                    best.add(anchor * slots + j, score[row, anchor], i[row])
        best.settle()
        key, score, ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["key", "id", "score"])

    found = packed.mapInArrow(search, "key bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
