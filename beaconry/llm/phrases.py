"""Fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level runs of an equal name become one name; deterministic coin tossing (each name takes the place and
value of the lowest bit in which it differs from the one before, again and again until six colours are left, then three) colours the rest
so that neighbours differ; a phrase begins at each local maximum of the colours, so it has two to four names; and a phrase is named by
a hash of the names in it. Which phrase a name falls into depends only on `LEFT` names before it and `RIGHT` after it. So
equal substrings have equal phrases inside, wherever they stand, but for some at their edges.

The fingerprint has the `KEPT` smallest hashes of the phrase names on each of `LEVELS` (phrases of some 6, 14 and 32 code points); the likeness of
two is the mean, over those levels, of the share of common phrases that these bottom-k samples estimate (exact where a text has few phrases).

To compare a document with its successor, whole texts are dealt once, by ranges of the documents' order; the first
document of a range also goes to the range before. Bounds of the ranges come from a sort of ids and text hashes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_place, longs, staged

LEVELS = (2, 3, 4)
KEPT = 32
#: On how many names before and after it a name's place in a phrase depends, on each level.
LEFT, RIGHT = 9, 5
#: Code points parsed together, which is what a core's cache holds. A longer text is parsed alone.
CHUNK_CHARS = 1 << 17
#: Rows in a range at least, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1024, 50_000
NONE = 127  # in place of a neighbour's label at a text's ends
LOWEST = -(1 << 63)


def lowest_difference(a: int, b: int) -> int:
    at = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * at + (b >> at & 1)


def coin_table() -> np.ndarray:
    """By the label before and the own one: the next label."""
    out = [[b & 1 if a == NONE else 0 if a == b else lowest_difference(a, b) for b in range(128)] for a in range(128)]
    return np.array(out, np.uint8).ravel()


def colour_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """By the colours before, at and after a place (7: none): what replaces colours 5, 4 and 3, and where phrases begin."""
    places = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    fewer = [np.array([min({0, 1, 2} - {a, c}) if b == colour else b for a, b, c in places], np.uint8) for colour in (5, 4, 3)]
    return fewer, np.array([(a == 7 or b > a) and (c == 7 or b > c) for a, b, c in places])


COINS = coin_table()
FEWER, BEGINS = colour_tables()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (splitmix's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrased(names: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next level: phrase names, their texts and where they begin. `of` has each name's text, texts one after another."""
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
    runs = np.flatnonzero(new)
    if len(runs) < n:
        length = np.diff(np.append(runs, n)).astype(np.uint64)
        names, of = names[runs], of[runs]
        many = length > 1
        names = names.copy()
        names[many] = mixed(names[many] + length[many] * np.uint64(0x9E3779B97F4A7C15))
        n = len(names)
    first = np.ones(n, bool)
    first[1:] = of[1:] != of[:-1]
    starts = np.flatnonzero(first)
    last = np.append(starts[1:] - 1, n - 1) if n else starts

    before = np.empty_like(names)
    before[1:], before[:1] = names[:-1], 0
    differs = names ^ before
    place = np.bitwise_count((differs & (~differs + np.uint64(1))) - np.uint64(1))
    label = (place << 1) | ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label = np.minimum(label, NONE - 1)  # place is 64 only if hashes of different neighbours are equal
    label[starts] = (names[starts] & np.uint64(1)).astype(np.uint8)
    at = np.empty(n, np.uint16)
    for _ in range(3):
        at[1:] = label[:-1]
        at[starts] = NONE
        label = COINS[(at << 7) | label]
    for table in (*FEWER, BEGINS):
        at[1:] = label[:-1]
        at[starts] = 7
        at = (at << 3) | label
        at <<= 3
        after = np.empty(n, np.uint8)
        after[:-1] = label[1:]
        after[last] = 7
        label = table[at | after]
    begins = np.flatnonzero(label | first)
    inside = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    parts = mixed(names + (inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return (mixed(np.add.reduceat(parts, begins)) if n else names), of[begins], runs[begins]


def parsed(texts: list[str], levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level the phrases of the texts: names, the text's number and the code point where the phrase begins (counted through all texts)."""
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    at = np.arange(len(names))
    for _ in range(levels):
        names, of, begins = phrased(names, of)
        at = at[begins]
        yield names, of, at


def sketches(texts: list[str]) -> list[tuple[tuple[int, ...], ...]]:
    """Of each text, for each of LEVELS, the KEPT smallest hashes (32 bits) of its phrase names."""
    out = [[] for _ in texts]
    for level, (names, of, _) in enumerate(parsed(texts, LEVELS[-1]), 1):
        if level in LEVELS:
            key = np.unique((of.astype(np.uint64) << np.uint64(32)) | (mixed(names) >> np.uint64(32)))
            ends = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
            low = key.astype(np.uint32)
            for rows, start, end in zip(out, ends[:-1], ends[1:], strict=True):
                rows.append(tuple(low[start : min(end, start + KEPT)].tolist()))
    return [tuple(x) for x in out]


def sketches_by_chunks(texts: list[str]) -> list[tuple[tuple[int, ...], ...]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            out += sketches(texts[start:i])
            start, size = i, 0
        size += len(t)
    return out + sketches(texts[start:]) if texts else out


def written(sketch: tuple[tuple[int, ...], ...]) -> str:
    """The fingerprint: eight hexadecimal digits a hash, levels parted by dashes."""
    return "-".join("".join(f"{x:08x}" for x in level) for level in sketch)


def read(fingerprint: str) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(int(level[i : i + 8], 16) for i in range(0, len(level), 8)) for level in fingerprint.split("-"))


def likeness(a: tuple[tuple[int, ...], ...], b: tuple[tuple[int, ...], ...]) -> float:
    """From 0 (no phrase in common) to 1 (all): two texts without any are alike, one without any is like none that has some."""
    if a == b:
        return 1.0
    total = 0.0
    for x, y in zip(a, b, strict=True):
        both, any_of = set(x) & set(y), sorted({*x, *y})[:KEPT]
        total += sum(z in both for z in any_of) / len(any_of) if any_of else 1.0
    return total / len(a)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the text replaced by the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def range_of(bounds: list[tuple[int, int]], doc: Column, tie: Column) -> Column:
    """The number of the last of the bounds (descending ids, ascending ties) that isn't after the key, by binary search."""
    ids, ties = longs([b[0] for b in bounds]), longs([b[1] for b in bounds])
    return first_place(len(bounds), lambda at: (F.get(ids, at) > doc) | ((F.get(ids, at) == doc) & (F.get(ties, at) <= tie))) - 1


FINGERPRINTED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of `docs`.

    The next document is the one with the next smaller id; after the last comes the first. A document that is alone is its own next. A null text
    counts as empty; a null id as the smallest number. Rows that repeat an id follow each other in order of their texts' hashes, so each has
    its row. An empty table gives none. Extra columns take no part. A task holds a batch of texts, and of a long text some
    hundred bytes a code point.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(LOWEST)), "tie": F.xxhash64("t")})
    order = [F.desc("key"), F.asc("tie")]
    keys = rows.select("key", "tie").repartitionByRange(*order).sortWithinPartitions(*order)
    keys = staged(keys.withColumn("at", F.monotonically_increasing_id()), "keys")
    of_range = max(RANGE_ROWS, -(-keys.count() // MOST_RANGES))
    firsts = keys.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % of_range == 0).select("key", "tie").distinct()
    bounds = sorted(((r["key"], r["tie"]) for r in firsts.collect()), key=lambda b: (-b[0], b[1]))  # one a range or partition of ids
    if not bounds:
        return spark.createDataFrame([], FINGERPRINTED)
    n = len(bounds)
    placed = rows.withColumn("range", range_of(bounds, F.col("key"), F.col("tie")))
    at = F.col("range")
    begins = (F.get(longs([b[0] for b in bounds]), at) == F.col("key")) & (F.get(longs([b[1] for b in bounds]), at) == F.col("tie"))
    here, there = F.struct(at.alias("range"), F.lit(False).alias("beyond")), F.struct(F.pmod(at - 1, F.lit(n)).alias("range"), F.lit(True).alias("beyond"))
    dealt = placed.withColumn("to", F.explode(F.when(begins, F.array(here, there)).otherwise(F.array(here)))).select("to.*", "id", "key", "tie", "t")
    dealt = dealt.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "beyond", *order)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document before: range, id, text, sketch
        for batch in batches:
            ranges, beyond, ids, texts = (batch.column(c).to_pylist() for c in ("range", "beyond", "id", "t"))
            own = sketches_by_chunks(texts)
            pairs = []
            for here, past, i, text, sketch in zip(ranges, beyond, ids, texts, own, strict=True):
                if waiting is not None and waiting[0] == here:
                    pairs.append((*waiting[1:], text, sketch))
                waiting = None if past else (here, i, text, sketch)
            changed = [edited(p[1], p[3]) for p in pairs]
            marks = sketches_by_chunks(changed)
            columns = [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([written(p[2]) for p in pairs], pa.string()),
                pa.array([written(m) for m in marks], pa.string()),
                pa.array([likeness(p[2], m) for p, m in zip(pairs, marks, strict=True)], pa.float64()),
                pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FINGERPRINTED.split(", ")])

    return dealt.mapInArrow(follow, FINGERPRINTED)
