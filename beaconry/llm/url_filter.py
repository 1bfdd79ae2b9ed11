"""URL rules by a Bloom filter cascade, in DataFrame functions only.

Keys are `host suffix + path prefix`. Level 0 of a cascade holds the listed keys; level 1 holds what else in
the corpus's complete key universe level 0 lets through; level 2 the listed keys that level 1 lets through,
and so on until nothing is let through wrongly. A key's first level that doesn't hold it tells what it is,
with no error over the universe, and no page is joined with anything.

Two cascades answer for a url: one tells listed keys from all others, one tells blocking keys from allowing ones.
A level is a bit string in the plan, so levels are bounded: `MAX_LEVEL_BITS` each, checked before collecting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4
BITS_PER_KEY = 8
#: 4 MB a level; some 4 million listed keys. Longer lists are refused, with a hint to split them by host.
MAX_LEVEL_BITS = 1 << 25
MAX_LEVELS = 40


@dataclass(frozen=True)
class Level:
    bits: int
    seed: int
    data: bytes


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys a rule may have to fit this url, longest rule first: host suffixes x path prefixes."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lengths))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.struct((-F.length(s) - F.length(p)).alias("order"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda x: x["key"])


def positions(key: Column, level: Level) -> list[Column]:
    """The key's bit positions in a level, by one seeded hash each."""
    return [F.pmod(F.xxhash64(key, F.lit(level.seed), F.lit(i)), F.lit(level.bits)) for i in range(HASHES)]


def holds(key: Column, level: Level) -> Column:
    """Whether a level lets a key through. The level is a literal; one byte of it is looked at per hash."""
    if not level.data:
        return F.lit(False)
    data = F.lit(bytearray(level.data))
    out = F.lit(True)
    for p in positions(key, level):
        byte = F.conv(F.hex(F.substring(data, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, (p % 8).cast("int")) == 1)
    return out


def level_of(keys: DataFrame, n: int, seed: int) -> Level:
    """Encodes the column `key`: bits are or-ed to words in Spark; only words that are set come to the driver."""
    bits = max(64, 1 << max(0, (BITS_PER_KEY * n - 1).bit_length()))
    if bits > MAX_LEVEL_BITS:
        raise ValueError(f"{n} keys need a level of {bits} bits; the bound is {MAX_LEVEL_BITS}: split the list by host")
    level = Level(bits, seed, b"")
    if n == 0:
        return level
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), level))).alias("p"))
    words = set_bits.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 32).cast("int"))).alias("v"))
    data = bytearray(bits // 8)
    for w, v in words.collect():
        data[w * 4 : w * 4 + 4] = int(v).to_bytes(4, "little")
    return Level(bits, seed, bytes(data))


def cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels that tell the keys of `listed` from those of `others` (both: distinct `key`) without error."""
    levels: list[Level] = []
    inside, outside = listed.cache(), others.cache()
    kept = [inside, outside]
    try:
        n = inside.count()
        while n:
            level = level_of(inside, n, 1 + len(levels))
            levels.append(level)
            if len(levels) > MAX_LEVELS:
                raise ValueError("the cascade doesn't end: a key is listed both ways")
            inside, outside = outside.where(holds(F.col("key"), level)).cache(), inside
            kept.append(inside)
            n = inside.count()
    finally:
        for x in kept:
            x.unpersist()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the parity of the first level that doesn't hold it."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~holds(key, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of those names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, and of
    rules alike but for the verdict the blocking one. A url no rule fits gets `default`. A null url, or
    one without `://`, has an empty host and path, which no rule fits. Rows are neither joined nor moved.
    """
    spark: SparkSession = pages.sparkSession
    blocking = {r.key for r in rules if r.block}
    listed = {r.key for r in rules}
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    own = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rows = [(k, k in blocking) for k in sorted(listed)]
    table = spark.createDataFrame(rows, "key string, block boolean")
    universe = own.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"), F.lit(False).alias("listed"))
    marked = universe.unionByName(table.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    others = marked.where("not listed").select("key")
    known = cascade(table.select("key"), others)
    blocks = cascade(table.where("block").select("key"), table.where(~F.col("block")).select("key"))
    fits = unused(own, "fits")
    keys = F.filter(candidate_keys(F.col("host"), F.col("path"), lengths), lambda k: member(k, known))
    out = own.withColumn(fits, F.when(F.col("host") != "", F.get(keys, 0)))
    verdict = F.when(F.col(fits).isNull(), F.lit(default)).when(member(F.col(fits), blocks), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": F.col(fits), "verdict": verdict}).drop(fits)
