"""Near-duplicates by b-bit MinHash: bands give candidates, packed low bits estimate, full sets confirm.

1. Each text becomes a set of 64-bit shingle hashes, `BANDS * ROWS` minima, one hash per band, and a sketch:
   the low B bits of the first minima, packed. Texts with equal sets form a class, and one member stands for it.
2. The share of equal b-bit codes, corrected for chance collisions, estimates a pair's similarity. Of each band bucket
   those members stay to which another one comes near (a semi-join: the first such is enough).
3. At first only stars are candidates: every member with its bucket's first and last one. Each class confirms its best
   star edge on full sets; then members meet the centre of their bucket's largest component, if it is another, as long
   as that links many. Connected components are formed after each round.
4. What is left are pairs that share a bucket but not a component. Members of such buckets get a longer sketch and
   the start of their set, rare shingles first. Pairs whose sizes and finer estimate may reach the threshold and
   whose starts overlap (all linked pairs' do) are confirmed, each once, in the first bucket that it shares.
   No pairs within a component are made.

A link is lost only by chance: with a probability of 1.3e-7 at similarity 0.8 (bands), of about 3e-7 (5 sigmas of the
short sketch) and 4e-6 (4.5 sigmas of the long one), less above 0.8; and only if no other path joins the two.

Buckets, classes and components are only ever aggregated and joined, by minima; no group is gathered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

#: A pair at similarity 0.8 shares none of 40 bands of 5 minima with a probability of 1.3e-7.
BANDS, ROWS = 40, 5
B = 2
CODES = 192  # minima in the sketch: six words of 32 codes
FINE = 2560  # minima in the longer sketch, of which one bit each is kept
THRESHOLD = 80  # of 100
#: Estimates are let through from so many standard deviations below the threshold; finer ones from somewhat fewer.
SIGMAS, FINE_SIGMAS = 5.0, 4.5
#: Bits per member, and in all, of the filter that tells which texts are read again.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27
#: Words whose hash a task remembers.
MEMO = 200_000
#: Slots in which shingles are counted to tell rare from common ones.
MOST_SLOTS = 1 << 20
#: A round with centres is followed by another while one in so many of its pairs is a link.
WORTH_A_ROUND = 20
M64 = (1 << 64) - 1

SKETCHED = "doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>, sketch array<bigint>"


class Hasher:
    """Shingle sets and signatures of texts."""

    def __init__(self, k: int, hashes: int = BANDS * ROWS):
        self.k, self.known = k, {}
        rng = np.random.default_rng(20240229 + hashes)
        self.mul = (rng.integers(0, 1 << 63, hashes, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def shingles(self, raw: bytes | None) -> np.ndarray:
        """Distinct hashes of the k-word shingles; of fewer words, the hash of the whole sequence; none of none."""
        w = raw.lower().split() if raw else []
        if not w:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        k = min(self.k, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), M64, np.uint64)
        step = max(1, 200_000 // len(self.mul))  # what a core's cache holds
        for at in range(0, len(s), step):
            part = s[None, at : at + step] * self.mul[:, None]
            part += self.add[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low >> np.uint64(24)

    def bands(self, low: np.ndarray) -> np.ndarray:
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            h = (h ^ low[i::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h.view(np.int64)

    @staticmethod
    def sketch(low: np.ndarray, codes: int = CODES, b: int = B) -> np.ndarray:
        kept = (low[:codes] & np.uint64((1 << b) - 1)).reshape(-1, 64 // b)
        return np.bitwise_or.reduce(kept << (np.arange(64 // b, dtype=np.uint64) * np.uint64(b)), axis=1).view(np.int64)


def lists(rows: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, kind)))


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, class (digest of the set; null if empty), band hashes and sketch of each document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, none = Hasher(k), np.empty(0, np.int64)
        for batch in batches:
            n, cls, bands, sketches = [], [], [], []
            for raw in batch.column(1).to_pylist():
                s = hasher.shingles(raw)
                n.append(len(s))
                if not len(s):
                    cls.append(None), bands.append(none), sketches.append(none)
                    continue
                low = hasher.minima(s)
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(hasher.bands(low)), sketches.append(hasher.sketch(low))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), lists(bands), lists(sketches)], ["doc_id", "n_shingles", "cls", "bands", "sketch"])

    return docs.mapInArrow(sketch, SKETCHED)


def bit_filter(ids: DataFrame) -> np.ndarray:
    """Which of 2^m slots the hashes of the ids (one column) take, as bytes of bits; at most MOST_FILTER_BITS.

    Past that bound more ids share a slot and the filter lets more through; what uses it is exact afterwards.
    """
    n = max(1, ids.count())
    bits = min(MOST_FILTER_BITS, 1 << max(10, (n * FILTER_BITS - 1).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 32).cast("int"))
    words = ids.select(F.floor(slot / 32).alias("w"), bit.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint8)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id and the full shingle set of each document whose id is in `wanted` (one column).

    The texts stay where they are: a bounded filter tells which of them to read, and a join of the sets makes it exact.
    """
    taken = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))
    bits = len(taken.value) * 8

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(k)
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            at = pa.array(np.flatnonzero((taken.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1))
            texts = batch.column(1).take(at).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), lists([hasher.shingles(x).view(np.int64) for x in texts])], ["doc_id", "shingles"])

    rows = docs.where("doc_id is not null").select("doc_id", "t", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("slot"))
    found = rows.mapInArrow(full, "doc_id bigint, shingles array<bigint>")
    return found.join(wanted.toDF("doc_id"), "doc_id", "left_semi")


def finer(sets: DataFrame) -> DataFrame:
    """doc_id and the longer sketch of each set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1, FINE)
        for batch in batches:
            column = batch.column(1)
            rows = [hasher.sketch(hasher.minima(column[i].values.to_numpy().view(np.uint64)), FINE, 1) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows)], ["doc_id", "fine"])

    return sets.mapInArrow(sketch, "doc_id bigint, fine array<bigint>")


def estimate(a: Column, b: Column, codes: int = CODES, bits: int = B) -> Column:
    """Similarity from two sketches: the share of equal codes, less what chance makes equal."""
    low = F.lit(sum(1 << i for i in range(0, 64, bits)) - (1 << 64 if bits == 1 else 0)).cast("bigint")

    def differing(x: Column) -> Column:
        folded = reduce(lambda y, s: y.bitwiseOR(F.shiftrightunsigned(x, s)), range(1, bits), x)
        return F.bit_count(folded.bitwiseAND(low))

    words = codes * bits // 64
    unequal = reduce(lambda x, y: x + y, [differing(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(words)])
    chance = 2.0**-bits
    return (1 - unequal / codes - chance) / (1 - chance)


def least_estimate(threshold: int, codes: int = CODES, bits: int = B, sigmas: float = SIGMAS) -> float:
    p = threshold / 100 + (1 - threshold / 100) * 2.0**-bits
    return threshold / 100 - sigmas * math.sqrt(p * (1 - p) / codes) / (1 - 2.0**-bits)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    reached = 100 * both >= threshold * (F.size("_sa") + F.size("_sb") - both)
    return joined.where(reached).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node), by alternating large and small stars.

    Each round is written to the shared folder; hubs are handled by minima per node, joined back. It ends when all
    edges are stars about their smallest node.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        roles = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("below")), F.struct(F.col("v").alias("n"), F.lit(0).alias("below")))).alias("x"))
        tangled = roles.groupBy("x.n").agg(F.sum("x.below").alias("below"), F.count("*").alias("edges")).where("below > 0 and edges > 1")
        if not tangled.count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def grouped(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`.

    Words are parted by blanks, A-Z lower-cased. A null, empty or blank text has an empty set and is linked with
    nothing. An id is taken to name one text: rows repeated with it share their component, and classes of different
    texts with the same smallest id count as one. A row without an id can't name a component: it has none, links
    nothing and is kept. An empty table gives no rows. Extra columns take no part.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    all_rows = staged(sketched(texts, k), "sketches")
    rows = all_rows.where("doc_id is not null and cls is not null")
    # One row a class: its members' bands and sketches are equal.
    classes = staged(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    linked = links(classes, texts, k, threshold)
    named = classes.select("cls", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    placed = rows.select("doc_id", "n_shingles", "cls").join(named, "cls").drop("cls")
    alone = all_rows.where("doc_id is null or cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def links(classes: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """node and component of all classes that are linked with another."""
    banded = classes.select("rep", F.posexplode("bands").alias("i", "band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("band")
    members = banded.join(buckets, "band", "left_semi").join(classes.select("rep", "n_shingles", "sketch"), "rep")
    members = staged(members, "buckets")
    members = staged(alike(members, members, threshold, least_estimate(threshold), "sketch"), "alike")
    ends = members.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    sketch = staged(members.select("rep", "n_shingles", "sketch").distinct(), "sketches")
    sets = staged(sets_of(texts, sketch.select("rep"), k), "sets")
    members = staged(members.select("i", "band", "rep", "n_shingles").join(ends, "band"), "members")

    stars = members.select("rep", F.explode(F.array("low", "high")).alias("hub")).where("rep <> hub").distinct()
    likely = staged(likeliest(stars, sketch, threshold), "stars")
    best = likely.groupBy("rep").agg(F.max_by("hub", F.struct("likeness", "hub")).alias("hub"))
    edges = staged(confirmed(ordered(best), sets, threshold), "links")
    parts = components(edges)

    # Further rounds: the centre of a bucket's largest component, with the bucket's members outside it.
    while True:
        placed = staged(placed_in(members, parts), "placed")
        tried = staged(to_centres(placed, edges, sketch, threshold), "pairs")
        found = staged(confirmed(tried, sets, threshold), "links")
        tries, links_found = tried.count(), found.count()
        if links_found:
            edges = edges.unionByName(found)
            parts = components(as_edges(parts).unionByName(found))
        if links_found * WORTH_A_ROUND < tries or not links_found:
            break

    # A bucket whose members are all of one component has nothing left to find. Of any pair of different
    # components one is outside the bucket's largest, so the members of the largest never meet each other.
    left = placed_in(members, parts)
    open_buckets = largest(left).where("parts > 1").select("band", "of")
    left = staged(left.join(open_buckets, "band").withColumn("inner", F.col("part") == F.col("of")).drop("of"), "left")
    fine = staged(finer(sets.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")), "fine")
    cut = least_estimate(threshold, FINE, 1, FINE_SIGMAS)
    left = staged(left.join(fine.withColumnRenamed("doc_id", "rep"), "rep"), "left")
    outer = left.where("not inner")
    near_outer = alike(left.where("inner"), outer, threshold, cut, "fine", "part")
    left = staged(near_outer.unionByName(alike(outer, left, threshold, cut, "fine", "part")), "left")
    rare = rare_first(sets.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), threshold)
    short = classes.select("rep", F.transform("bands", lambda b: F.hash(b)).alias("bands"))
    left = staged(left.join(rare.withColumnRenamed("doc_id", "rep"), "rep").join(short, "rep"), "left")
    side = lambda n: left.select("i", "band", "inner", *(F.col(c).alias(f"{c}_{n}") for c in ("rep", "part", "n_shingles", "fine", "rare", "bands")))
    first = F.array_position(F.zip_with("bands_x", "bands_y", lambda p, q: p == q), True) == F.col("i") + 1
    near = (F.col("inner") | (F.col("rep_x") < F.col("rep_y"))) & (F.col("part_x") != F.col("part_y")) & like("n_shingles_x", "n_shingles_y", threshold)
    near &= estimate(F.col("fine_x"), F.col("fine_y"), FINE, 1) >= cut
    least = F.ceil(threshold * (F.col("n_shingles_x") + F.col("n_shingles_y")) / (100 + threshold) - 1e-9).cast("int")  # shared, if linked
    start = lambda n: F.slice(f"rare_{n}", F.lit(1), F.greatest(F.lit(0), F.col(f"n_shingles_{n}").cast("int") - least + 1))
    rest = side("x").where("not inner").drop("inner").join(side("y").drop("i"), "band").where(near & first & F.arrays_overlap(start("x"), start("y")))
    rest = staged(rest.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "pairs")
    found = staged(confirmed(rest, sets, threshold), "links")
    return parts if found.isEmpty() else components(as_edges(parts).unionByName(found))


def like(n: str, m: str, threshold: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(F.col(n), F.col(m)) >= threshold * F.greatest(F.col(n), F.col(m))


def alike(members: DataFrame, others: DataFrame, threshold: int, cut: float, sketch: str, part: str = "rep") -> DataFrame:
    """The rows of bucket members to which one of the others in the bucket (and of another `part`) comes near: one such is enough."""
    bits, codes = (1, FINE) if sketch == "fine" else (B, CODES)
    other = others.select(*(F.col(c).alias(f"_{c}") for c in ("band", "n_shingles", sketch, part)))
    near = (F.col("band") == F.col("_band")) & (F.col(part) != F.col(f"_{part}")) & like("n_shingles", "_n_shingles", threshold)
    return members.join(other, near & (estimate(F.col(sketch), F.col(f"_{sketch}"), codes, bits) >= cut), "left_semi")


def largest(placed: DataFrame) -> DataFrame:
    """Per bucket its part with the most members as `of`, and the number of its parts."""
    counts = placed.groupBy("band", "part").count()
    return counts.groupBy("band").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("of"), F.count("*").alias("parts"))


def likeliest(pairs: DataFrame, sketch: DataFrame, threshold: int) -> DataFrame:
    """rep, hub and likeness of those pairs whose sizes and sketches may reach the threshold."""
    hub = sketch.select(F.col("rep").alias("hub"), F.col("n_shingles").alias("_m"), F.col("sketch").alias("_x"))
    rep = sketch.select("rep", F.col("n_shingles").alias("_n"), F.col("sketch").alias("_y"))
    both = pairs.join(rep, "rep").join(hub, "hub").where(like("_n", "_m", threshold))
    return both.withColumn("likeness", estimate(F.col("_x"), F.col("_y"))).where(F.col("likeness") >= least_estimate(threshold)).select("rep", "hub", "likeness")


def placed_in(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The bucket members with their component as `part`."""
    at = members.select("i", "band", "rep", "n_shingles").join(parts, F.col("rep") == F.col("node"), "left")
    return at.select("i", "band", "rep", "n_shingles", F.coalesce("component", "rep").alias("part"))


def to_centres(placed: DataFrame, edges: DataFrame, sketch: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members with the centre of their bucket's largest component, if they are of another one.

    A component's centre is its node with the most confirmed links. A member meets one centre a bucket at most.
    """
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count()
    nodes = placed.select("part", "rep").distinct().join(degree, "rep", "left")
    centres = nodes.groupBy("part").agg(F.max_by("rep", F.struct(F.coalesce("count", F.lit(0)), -F.col("rep"))).alias("hub"))
    pairs = placed.select("band", "rep", "part").join(largest(placed), "band").where("part <> of").select("rep", "of").distinct()
    pairs = pairs.join(centres.withColumnRenamed("part", "of"), "of").where("rep <> hub").select("rep", "hub").distinct()
    return likeliest(pairs, sketch, threshold).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def rare_first(sets: DataFrame, threshold: int) -> DataFrame:
    """doc_id and `rare`: the start of each set in one order for all, what few sets have first.

    Two sets that share t shingles have one in common among the first size - t + 1 of each, in whichever common order; as t is at
    least size * threshold / 100, no longer start is kept. The order is by counts in a bounded number of slots, then by hash;
    counts only decide how few pairs are left, not which are found. Shingles are kept as 32 bits, so that some may look equal.
    """
    n = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    slots = min(MOST_SLOTS, 1 << (2 * n + 1024).bit_length())
    shared = sets.select(F.explode("shingles").alias("g")).select(F.pmod("g", F.lit(slots)).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    counts = np.ones(slots, np.int64)
    counts[shared["slot"].to_numpy()] = shared["n"].to_numpy()
    taken = sets.sparkSession.sparkContext.broadcast(counts.clip(max=0x7FFFFFFF).astype(np.int32))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows = batch.column(1), []
            for i in range(len(column)):
                x = column[i].values.to_numpy()
                order = np.lexsort((x, taken.value[x % slots]))
                rows.append(x[order[: len(x) - -(-threshold * len(x) // 100) + 1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows, np.int32)], ["doc_id", "rare"])

    return sets.mapInArrow(start, "doc_id bigint, rare array<int>")


def ordered(stars: DataFrame) -> DataFrame:
    """Star edges as pairs (a, b), a the smaller."""
    return staged(stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "pairs")


def as_edges(parts: DataFrame) -> DataFrame:
    """Components as stars of edges, which link the same nodes."""
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def deduplicated(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of `docs`, all columns kept, of one document of each group: the one with the smallest id.

    Rows that repeat a kept id all stay, with `once` only one of them. Rows without an id all stay.
    """
    gone, again = unused(docs, "gone"), unused(docs, "again")
    drop = grouped(docs, k, threshold, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    out = docs.join(drop, F.col(id_col) == F.col(gone), "left_anti")
    if not once:
        return out
    repeated = docs.groupBy(F.col(id_col).alias(again)).count().where(F.col(again).isNotNull() & (F.col("count") > 1)).select(again)
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, F.col(id_col) == F.col(again), "left_semi").dropDuplicates([id_col])
    return out.join(repeated, F.col(id_col) == F.col(again), "left_anti").unionByName(once)
