"""Mixing sources to target weights by Pfair scheduling.

Weights are whole shares w of a period of P slots. Block j of a source (from 0) is released at slot
floor(j * P / w) and due by ceil((j + 1) * P / w). In each slot, of the released blocks the one due first is taken.
As the shares fill the period exactly, every block meets its window, so after any number of slots a
source's blocks deviate from its weight's part by less than one block.

Weights are taken exactly, floats as the decimals that they print as, and windows are found in whole numbers of any length. Where the
period is short, one period is made and repeated: it depends on the weights alone. Otherwise every block of the table is scheduled;
blocks are made so long that there are `MOST_SLOTS` at most (beyond one a source), so the schedule doesn't grow with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unused

#: The longest period that is made to be repeated, and the most blocks (but for one a source) that are scheduled otherwise.
PERIOD, MOST_SLOTS = 1_000_000, 1_000_000
BLOCK_ROWS = 8
#: Tables up to so many rows (slots; sources by partition) are broadcast.
BROADCAST_ROWS = 100_000
#: Rows that a task numbers, on average.
SLICE_ROWS = 20_000


def shares(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole shares that sum to the period, 1 at least each: the largest remainders are rounded up."""
    checked(weights)
    if not weights or len(weights) > period:
        raise ValueError("weights must be for 1 to `period` sources")
    total = sum(map(fraction, weights.values()))
    exact = {k: fraction(w) * period / total for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    spare = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], str(k)))[: max(0, spare)]:
        out[k] += 1
    for k in sorted(exact, key=lambda k: (-exact[k], str(k))):  # shares raised to 1 are taken from the largest
        cut = min(out[k] - 1, max(0, -spare))
        out[k], spare = out[k] - cut, spare + cut
    return out


def checked(weights: dict[str | None, float]) -> None:
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")


def fraction(w) -> Fraction:
    return Fraction(str(w)) if isinstance(w, float) else Fraction(w)


def whole(weights: dict[str | None, float], longest: int | None = None) -> dict[str | None, int]:
    """The weights as whole shares without a common factor; rounded only if their sum is beyond `longest`, where that is given."""
    checked(weights)
    exact = {k: fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*out.values()) or 1
    out = {k: w // common for k, w in out.items()}
    return out if longest is None or sum(out.values()) <= longest else shares(weights, longest)


def schedule(share: dict[str | None, int]) -> list[tuple[str | None, int]]:
    """One period: (source, block number in the period) of each slot, earliest deadline first among the released."""
    return [(k, j) for k, j, *_ in scheduled(share, share)]


def scheduled(share: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, due) of so many blocks of each source, slot by slot: earliest deadline first among the released.

    While no source has run out no slot stays empty; after that, slots without a released block do.
    """
    period = sum(share.values())
    window = lambda k, j: (j * period // share[k], -(-(j + 1) * period // share[k]))
    names = list(share)
    waiting = [(*window(k, 0), str(k), i, 0) for i, k in enumerate(share) if blocks.get(k)]
    heapq.heapify(waiting)
    ready, t = [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            r, d, name, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (d, name, i, j, r))
        d, name, i, j, r = heapq.heappop(ready)
        assert t < d, "a deadline is missed"
        yield names[i], j, t, r, d
        if j + 1 < blocks[names[i]]:
            heapq.heappush(waiting, (*window(names[i], j + 1), name, i, j + 1))
        t += 1


def temperature_weights(docs: DataFrame, exponent: float, source_col: str = "source") -> dict[str | None, float]:
    """Target weights: each source's rows to the power `exponent`. One row a source comes to the driver."""
    return {r[0]: float(r[1]) ** exponent for r in docs.groupBy(source_col).count().collect()}


MADE = ["mix_block", "mix_release", "mix_due", "mix_slot", "mix_position", "in_mix"]


def mixed(docs: DataFrame, weights: dict[str | None, float], period: int = PERIOD, block_rows: int = BLOCK_ROWS, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """`docs` with mix_block, mix_release, mix_due, mix_slot, mix_position and in_mix; columns of those names are replaced.

    A source's rows are numbered in order of id (nulls first; repeated ids in an order of their hashes) and cut into blocks of block_rows, or
    of more where the weights have no period of `period` slots or fewer and the table more than MOST_SLOTS such blocks.
    mix_position orders all rows: slot by slot, and within the block by number. in_mix is true as far as the weights can be
    met: up to the slot where the first source runs out. All rows are returned; past that slot the remaining sources go on by
    their own deadlines. A last block may be short. A source without a weight has no slot (nulls, in_mix false), so without any
    weight no row has. Null is a source like any other. Weights so far apart that slots have no 64-bit number raise ValueError.
    """
    share = whole(weights) if weights else {}
    length = sum(share.values())
    sizes = {r[0]: r[1] for r in docs.groupBy(source_col).count().collect()}
    repeated = length <= period
    if not repeated:
        block_rows = max(block_rows, -(-sum(sizes.get(k, 0) for k in share) // MOST_SLOTS))
    blocks = {k: -(-sizes.get(k, 0) // block_rows) for k in share}
    horizon = min((blocks[k] * length // w + (blocks[k] * length % w > 0) for k, w in share.items()), default=0)

    base = docs.drop(*MADE)
    number = unused(base, "number")
    rows = numbered(base, source_col, id_col, sum(sizes.values()), number)
    rows = rows.withColumn("mix_block", F.floor(F.col(number) / block_rows))
    rows = in_period(rows, share, source_col) if repeated else in_whole(rows, share, blocks, block_rows, source_col)
    return rows.withColumns(
        {
            "mix_position": F.col("mix_slot") * block_rows + F.col(number) % block_rows,
            "in_mix": F.coalesce(F.col("mix_slot") < F.lit(min(horizon, 1 << 62)), F.lit(False)),
        }
    ).drop(number)


def in_period(rows: DataFrame, share: dict[str | None, int], source_col: str) -> DataFrame:
    """`rows` with the windows and slots of their blocks, from one period of the schedule."""
    length = sum(share.values())
    slots = slot_table(rows, share)
    known = slots.where("_turn = 0").select("_source", "_share")
    part, turn, source = unused(rows, "share"), unused(rows, "turn"), unused(rows, "source")
    rows = rows.join(small(known.toDF(source, part), len(share)), F.col(source_col).eqNullSafe(F.col(source)), "left").drop(source)
    rows = rows.withColumn(turn, F.col("mix_block") % F.col(part))
    offset, due = unused(rows, "offset"), unused(rows, "due")
    at = slots.select("_source", "_turn", "_offset").toDF(source, due, offset)
    rows = rows.join(small(at, length), F.col(source_col).eqNullSafe(F.col(source)) & (F.col(turn) == F.col(due)), "left")
    p = F.lit(length).cast("bigint")
    return rows.withColumns(
        {
            "mix_release": F.floor(F.col("mix_block") * p / F.col(part)),
            "mix_due": F.ceil((F.col("mix_block") + 1) * p / F.col(part)),
            "mix_slot": F.floor(F.col("mix_block") / F.col(part)) * p + F.col(offset),
        }
    ).drop(part, turn, source, due, offset)


def in_whole(rows: DataFrame, share: dict[str | None, int], blocks: dict[str | None, int], block_rows: int, source_col: str) -> DataFrame:
    """`rows` with the windows and slots of their blocks, from the schedule of all blocks."""
    table = list(scheduled(share, blocks))
    if table and max(d for *_, d in table) * block_rows >= 1 << 62:
        raise ValueError("weights are too far apart for the table's sizes")
    columns = [pa.array(c, t) for c, t in zip(zip(*table, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)] if table else [pa.array([], t) for t in (pa.string(), *[pa.int64()] * 4)]
    source, block = unused(rows, "source"), unused(rows, "block")
    at = rows.sparkSession.createDataFrame(pa.table(columns, [source, block, "mix_slot", "mix_release", "mix_due"]))
    return rows.join(small(at, len(table)), F.col(source_col).eqNullSafe(F.col(source)) & (F.col("mix_block") == F.col(block)), "left").drop(source, block)


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def slot_table(docs: DataFrame, share: dict[str | None, int]) -> DataFrame:
    """One period: _source, _turn (its block in the period), _offset (the slot) and _share."""
    table = schedule(share) if share else []
    columns = [[k for k, _ in table], [j for _, j in table], list(range(len(table))), [share[k] for k, _ in table]]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
    arrow = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_source", "_turn", "_offset", "_share"])
    return docs.sparkSession.createDataFrame(arrow)


def numbered(rows: DataFrame, source_col: str, id_col: str, total: int, name: str) -> DataFrame:
    """`rows` with their number in their source as column `name`, in order of id.

    The rows are range-partitioned by source and id, whatever the sizes of the sources, and staged in that order; counts
    per partition and source give each partition its first numbers.
    """
    tie, place, at = unused(rows, "tie"), unused(rows, "place"), unused(rows, "at")
    plain = [F.col(c) for c, t in rows.dtypes if not t.startswith("map")]
    rows = rows.withColumns({tie: F.xxhash64(*plain), place: F.monotonically_increasing_id()})
    order = [F.col(source_col), F.col(id_col).asc_nulls_first(), F.col(tie), F.col(place)]
    n = max(1, -(-total // SLICE_ROWS))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(tie, place)
    ranged = staged(ranged.withColumn(at, F.monotonically_increasing_id()), "mix-rows")
    runs = ranged.groupBy(F.col(source_col).alias("_of"), F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"), F.min(at).alias("_from"))
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).drop("_n", "_from"), "mix-runs")
    of, part, shift = unused(ranged, "of"), unused(ranged, "part"), unused(ranged, "shift")
    # A row for each source and partition that hold a row in common: their numbers' sum at most.
    first = small(runs.toDF(of, part, shift), runs.count())
    joined = ranged.join(first, F.col(source_col).eqNullSafe(F.col(of)) & (F.shiftright(at, 33) == F.col(part)), "left")
    return joined.withColumn(name, F.col(at) + F.col(shift)).drop(of, part, shift, at)
