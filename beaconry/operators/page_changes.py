"""Standards named in what changed between two snapshots of a page.

Two texts are compared word by word. What both begin and end with is set aside; in what is left, runs of words that occur once in
either text anchor them to each other, single words if there are such, else runs of two, four, eight and more. The anchors that keep their order
are kept, as many as possible, and the same is done between them. What is left without an anchor was replaced. Each step is
linear but for sorting, so pages of any length take a time in proportion.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

BATCH = {"maxRecordsPerBatch": "1000", "maxBytesPerBatch": str(8 << 20)}
STANDARD = re.compile(r"\bCIP-\d{3}\b")


def anchors(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places in both of runs that occur once in either: of the shortest runs (1, 2, 4, ... words) of which there are such. In order of the first."""
    numbers: dict = {}
    mine, theirs = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (old, new))
    size = 1
    while True:
        common = once(theirs)
        pairs = [(i, common[x]) for x, i in once(mine).items() if x in common]
        if pairs or set(mine).isdisjoint(theirs) or 2 * size > min(len(old), len(new)):
            return pairs
        numbers = {}  # a run of twice the size is a pair of runs, named by a number again
        mine, theirs = ([numbers.setdefault(p, len(numbers)) for p in zip(x, x[size:])] for x in (mine, theirs))
        size *= 2


def once(numbers: list[int]) -> dict[int, int]:
    """The numbers that occur once, with their place."""
    seen: dict[int, int] = {}
    for i, x in enumerate(numbers):
        seen[x] = -1 if x in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def in_both_orders(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, which are in order of their first numbers, that is in order of the second too."""
    tails: list[int] = []  # last second numbers of the best chains by length
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        before[k] = at[n - 1] if n else -1
        tails[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def changed_regions(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """What was replaced, in order: old[a:b] by new[c:d], of which one may be empty."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        chain = [(a + i, c + j) for i, j in in_both_orders(anchors(old[a:b], new[c:d]))]
        if not chain:
            if a < b or c < d:
                out.append((a, b, c, d))
            continue
        for i, j in chain:  # the first word of an anchor is enough to part what stands before it
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    return sorted(out)


def changed_standards(old: str, new: str, around: int = 8, most: int = 400) -> list[tuple[str, str]]:
    """Standards named in words added or replaced, by name, each with the first such region and some words around it."""
    before, after = old.split(), new.split()
    found: dict[str, str] = {}
    for _, _, start, end in changed_regions(before, after):
        for name in STANDARD.findall(" ".join(after[start:end])):
            found.setdefault(name, " ".join(after[max(0, start - around) : end + around])[:most])
    return sorted(found.items())


@F.pandas_udf(ArrayType(StructType().add("standard", StringType()).add("snippet", StringType())))
def _changes(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"standard": s, "snippet": t} for s, t in changed_standards(a, b)] for a, b in zip(old, new)])


def standard_changes(snapshots: DataFrame) -> DataFrame:
    """A row per page change and standard. `snapshots` has url, event_date, text and prev (null for a page's first, which gives none).

    Texts reach Python in batches of some 8 MB, however many pages a task has (the session's Arrow settings are changed).
    Only snapshots that differ and name a standard at all reach Python; null texts are empty ones.
    """
    for name, most in BATCH.items():
        snapshots.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", most)
    rows = snapshots.withColumn("text", F.coalesce("text", F.lit(""))).where("prev is not null and text <> prev").where(F.col("text").rlike(STANDARD.pattern))
    rows = rows.select("url", "event_date", F.explode(_changes("prev", "text")).alias("c")).select("url", "event_date", "c.*")
    headline = F.concat(F.lit("NERC standards page update: "), "standard", F.lit(" changed - CIP revision activity affecting registered entities"))
    return rows.withColumns({"headline": headline, "confidence": F.lit(0.65), "trigger_id": F.lit("nerc_cip_revision"), "scope": F.lit("sector")})
