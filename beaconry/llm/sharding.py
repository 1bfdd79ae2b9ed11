"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `VNODES` points on a ring of 64-bit hashes; a row belongs to the arc that its id's hash
falls in, and so to the shard of the next point clockwise. A shard takes no more rows than its bound:
floor or ceil of `load` times the mean. What an arc's shard can't take goes on clockwise to the next shard
that isn't full, so balance is guaranteed, and only overflowing rows leave their arc.

The plan is made from counts per arc (`shards x VNODES` numbers). Rows are ranked within their arc by a
two-level count, so the largest task holds a slice of an arc, and find their shard and slot by rank.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_place, longs

VNODES = 64
MADE = ("doc_id", "size", "text_crc32", "shard", "slot")
#: Rows that one task ranks at most, on average.
SLICE_ROWS = 20_000


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The ring: (position, shard) in order of position; positions are signed 64-bit numbers."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


@dataclass(frozen=True)
class Piece:
    """Ranks [start, end) of an arc go to `shard`, where they take slots from `slot` on."""

    arc: int
    start: int
    end: int
    shard: int
    slot: int


def bounds(total: int, shards: int, load: Fraction) -> list[int]:
    """Each shard's bound: with load 1, floor or ceil of the mean, `total` in all; else ceil(load x mean)."""
    if load == 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-total * load.numerator // (shards * load.denominator))] * shards


def placed(counts: dict[int, int], ring: list[tuple[int, int]], shards: int, load: Fraction) -> list[Piece]:
    """Where each arc's rows go. In round r each arc offers what is left to the r-th shard clockwise."""
    room = bounds(sum(counts.values()), shards, load)
    n, taken, pieces = len(ring), [0] * shards, []
    left = {a: (0, c) for a, c in sorted(counts.items()) if c}
    walks = {}
    for a in left:
        walks[a] = list(dict.fromkeys(ring[(a + i) % n][1] for i in range(n)))
    for r in range(shards):
        for a, (start, end) in list(left.items()):
            s = walks[a][r] if r < len(walks[a]) else None
            take = 0 if s is None else min(end - start, room[s] - taken[s])
            if take:
                pieces.append(Piece(a, start, start + take, s, taken[s]))
                taken[s] += take
                left[a] = (start + take, end)
        left = {a: x for a, x in left.items() if x[0] < x[1]}
    assert not left, "the bounds hold all rows"
    return pieces


def arc_of(ring: list[tuple[int, int]]):
    """The arc of a column of positions, in SQL functions: a binary search for the points before it."""
    at = longs([p for p, _ in ring])
    return lambda position: first_place(len(ring), lambda i: F.get(at, i) < F.col(position)) % len(ring)


def arc_at(ring: list[tuple[int, int]], position: int) -> int:
    """The arc of one position, plainly."""
    return bisect_left([p for p, _ in ring], position) % len(ring)


def sharded(docs: DataFrame, shards: int, load: Fraction | int = 1, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot and the columns named in `keep` (but for those of these five names).

    size is the text's UTF-8 bytes plus 1; a null text counts as no bytes, also in its crc. Null ids share a position; rows of one id
    share an arc and are told apart by text checksum and size, which also rank them. With load 1, counts are at most one
    apart. An empty table gives no rows. Slots of a shard run from 0 without a gap.
    """
    keep = [c for c in keep if c.lower() not in MADE]
    spark, ring, load = docs.sparkSession, points(shards, vnodes), Fraction(load)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    facts = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(raw).cast("bigint") + 1).alias("_size"),
        F.crc32(raw).alias("_crc"),
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
    ).withColumn("_hash", F.xxhash64("_id"))
    rows = facts.withColumn("_arc", arc_of(ring)("_hash"))
    slices = max(1, -(-docs.count() // (len(ring) * SLICE_ROWS)))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_id", "_crc"), F.lit(slices)).cast("int"))
    sizes = rows.groupBy("_arc", "_slice").count()
    before = Window.partitionBy("_arc").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_arc", "_slice", "_base")
    order = ["_hash", "_id", "_crc", "_size"]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_slice").orderBy(*order)) - 1)
    if slices > 1:
        ranked = ranked.join(base, ["_arc", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    counts = {r["_arc"]: r["count"] for r in sizes.groupBy("_arc").agg(F.sum("count").alias("count")).collect()}
    pieces = placed(counts, ring, shards, load)
    plan = spark.createDataFrame([(p.arc, p.start, p.end, p.shard, p.slot) for p in pieces], "_arc int, _start bigint, _end bigint, shard int, _slot bigint")
    here = (ranked["_arc"] == plan["_arc"]) & (ranked["_rank"] >= plan["_start"]) & (ranked["_rank"] < plan["_end"])
    # The plan has at most shards x shards x VNODES rows.
    out = ranked.join(F.broadcast(plan), here)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_rank") - F.col("_start") + F.col("_slot")).cast("bigint").alias("slot"),
        *(F.col(f"_keep_{c}").alias(c) for c in keep),
    )


def in_order(placed: DataFrame, segment: str, at: str) -> DataFrame:
    """Slots dealt anew, so that each shard's rows follow each other in order of `segment` and, in it, of `at`.

    A segment is a run of rows in order, of a size that one task holds, such as a file of a table that was written in order. Ties of `at`
    get slots in an order of their ids and checksums. Shards and columns stay.
    """
    sizes = placed.groupBy("shard", F.col(segment).alias("_segment")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a segment and shard
    rank = F.row_number().over(Window.partitionBy("shard", segment).orderBy(at, "doc_id", "text_crc32")) - 1
    rows = placed.withColumn("slot", rank).join(base.withColumnRenamed("shard", "_shard"), (F.col("shard") == F.col("_shard")) & F.col(segment).eqNullSafe(F.col("_segment")))
    return rows.withColumn("slot", (F.col("slot") + F.col("_base")).cast("bigint")).select(placed.columns)
