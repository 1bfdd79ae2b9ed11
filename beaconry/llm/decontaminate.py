"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words. Windows of one length share a block shift table: the last
two words under the reading position say how far the position can move without passing an occurrence,
so most of a clean text is never compared. Where the shift is zero, the bucket of that suffix block
lists the windows to test, their first word is checked, and a direct comparison confirms.

The windows are held in every task, so benchmark text is taken in blocks of `BLOCK_BYTES` at most:
one block is one search inside the scan of the documents; further blocks repeat the search over the
staged result. Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import staged, unused

WINDOW = 13
BLOCK_BYTES = 4_000_000
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

#: Bytes to word bytes: A-Z lower-cased; 0-9, a-z and everything above ASCII kept; the rest parts words.
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(raw: bytes | None) -> list[bytes]:
    """The words of a text's UTF-8 bytes; null has none."""
    return raw.translate(TO_WORDS).split() if raw else []


class WuManber:
    """Windows of benchmark items, ready to be searched for. Built in the task from (item, bytes) pairs."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.items, self.window, self.groups = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "groups": None}

    def build(self) -> None:
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, raw in self.items:
            w = words(raw)
            m = min(self.window, len(w))
            for i in range(len(w) - m + 1) if m else ():
                owners[m][tuple(w[i : i + m])].update(() if item is None else (item,))
        self.groups = []
        for m, windows in sorted(owners.items()):
            b = min(2, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
            for window, who in windows.items():
                for end in range(b, m + 1):
                    block = window[end - b : end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets[window[m - b :]][window[0]].append((list(window), sorted(who)))
            self.groups.append((m, b, shift, {k: dict(v) for k, v in buckets.items()}))

    def search(self, w: list[bytes]) -> tuple[list[int], list[str]]:
        """Merged spans [start, end, start, end, ...] of hit words and the items with occurring windows."""
        if self.groups is None:
            self.build()
        found, spans, n = set(), [], len(w)
        for m, b, shift, buckets in self.groups:
            i, far = m, m - b + 1  # i is one past the window's last word
            while i <= n:
                block = tuple(w[i - b : i])
                step = shift.get(block, far)
                if step:
                    i += step
                    continue
                for window, who in buckets[block].get(w[i - m], ()):
                    if w[i - m : i] == window:
                        found.update(who)
                        spans.append((i - m, i))
                i += 1
        return merged(spans), sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def searcher(index):
    """The search as a column function; `index` is a broadcast WuManber."""

    @arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.to_pylist():
            w = words(raw)
            spans, who = index.value.search(w)
            rows.append({"n_words": len(w), "spans": spans, "items": who})
        return pa.array(rows, FOUND_ARROW)

    return search


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """`docs` with one struct column more (its name is returned): n_words, spans of hit words, items.

    Null or empty texts have no words, no spans and no items. A benchmark row without words gives no
    window; one whose id is null has its windows searched for, but no name to report. Repeated item
    rows count once. Rows of `docs`, repeated ones too, stay as they are.
    """
    text = F.col(item_text_col).cast("binary")
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), text.alias("t")).where(F.length(text) > 0)
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    name = unused(docs, "found")
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        pairs = sorted({(r["i"], bytes(r["t"])) for r in part.toLocalIterator()}, key=str)
        index = docs.sparkSession.sparkContext.broadcast(WuManber(pairs, window))

        search = searcher(index)
        now = search(F.col(text_col).cast("binary"))
        if k == 0:
            out = out.withColumn(name, now)
        else:
            both = unused(out, "more")
            out = out.withColumn(both, now).withColumn(name, joined(F.col(name), F.col(both))).drop(both)
        if blocks > 1:
            out = staged(out, "decontaminate")
    return out, name


@arrow_udf(FOUND)
def joined(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        pairs = [(s[i], s[i + 1]) for s in (x["spans"], y["spans"]) for i in range(0, len(s), 2)]
        rows.append({"n_words": x["n_words"], "spans": merged(pairs), "items": sorted({*x["items"], *y["items"]})})
    return pa.array(rows, FOUND_ARROW)


def n_hit(found):
    """Words inside any occurrence, from the merged spans."""
    return F.aggregate(
        F.transform(found["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )


def is_contaminated(found):
    """A document is contaminated if at least a twentieth of its words, and at least one, are hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns kept, without the contaminated ones."""
    out, name = scan(docs, benchmark, **options)
    return out.where(~is_contaminated(F.col(name))).drop(name)
