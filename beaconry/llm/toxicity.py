"""Toxicity of deobfuscated text: a noisy channel undoes leetspeak, spacing and repetition, then words are scored.

The language model counts letter trigrams over all documents (64 letter classes, so at most 64^3 counts come to
the driver). Suspicious chunks (letters mixed with digits or signs, letters three times in a row, letters
spelled out one by one) become a lattice: each observed sign may stand for itself or for the letters it looks like,
a run for one or two letters, and the separators of spelled-out words for nothing or a word's edge. Viterbi decoding over
trigram states finds the likeliest reading, in time linear in the chunk's length; long chunks are read piece by piece. Words of the restored text then give whole-word and prefix features to
a logistic scorer, fitted on a bounded sample of labelled rows (`TRAIN_ROWS`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import staged

#: Labelled rows that train the scorer at most, taken by the hash of their id.
TRAIN_ROWS = 20_000
#: Features that the scorer weighs: those of the labelled rows with so much evidence (log-likelihood ratio) for toxicity.
MIN_EVIDENCE = 20.0
PREFIXES = (4, 5, 6)
MEMO = 300_000
#: A chunk that is longer than this with its runs folded isn't one word: its pieces are read one by one, long ones with word edges.
LONGEST_WORD = 40

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "€": "e", "£": "l", "¥": "y",
}
COST_SWAP, COST_SIGN, COST_RUN, COST_DOUBLE, COST_PAIR, COST_EDGE = 1.0, 6.0, 0.5, 1.0, 3.0, 1.0
SIGNS = re.escape("".join(LOOKALIKES))
#: Letters three times in a row, or a look-alike sign before or after a letter.
REPEATED = re.compile(r"([^\W\d_])\1\1")
DISGUISED = re.compile(rf"[^\W\d_][{SIGNS}]|[{SIGNS}][^\W\d_]|([^\W\d_])\1\1")
#: Four letters or look-alikes and more, one by one, between equal separators.
SPELLED = re.compile(rf"(?<![^\W_])[^\W_]([ .\-_*])(?:[^\W_]|[{SIGNS}])(?:\1(?:[^\W_]|[{SIGNS}])){{2,}}(?![^\W_])")
#: A run of one sign, which counts as three at most; a piece of a chunk between marks that stand for no letter.
RUN = re.compile(r"(.)\1{3,}", re.S)
PIECE = re.compile(rf"(?:[^\W_]|[{SIGNS}])+")
#: Marks around a chunk that belong to the sentence.
AROUND = ".,;:?!\"'()[]<>*#&%-_$"
WORD = re.compile(r"[^\W_]+")
ALPHABET = 64


def letter_class(c: str) -> int:
    """0 a word's edge, 1-26 a-z, 27 digits and signs, 28-63 other letters by code."""
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 28 + o % 36 if c.isalpha() else 27


#: Code points of UTF-16 units to letter classes; what isn't a letter or digit is an edge.
CLASSES = np.array([letter_class(chr(i)) if (chr(i).isalpha() or chr(i).isdigit()) else 0 for i in range(0x10000)], np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Trigram numbers of a lower-cased text, words padded by edges."""
    units = np.frombuffer(f"  {text} ".encode("utf-16-le", "surrogatepass"), "<u2")
    c = CLASSES[units].astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one edge between words
    return (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]


def language_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Costs (-log P) of a letter after two others, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(trigrams(text.lower()), minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["g", "n"])

    rows = docs.select(text_col).mapInArrow(count, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(ALPHABET**3, 0.02)
    counts[rows["g"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
    counts = counts.reshape(-1, ALPHABET)
    return (-np.log(counts / counts.sum(1, keepdims=True))).astype(np.float32).reshape(ALPHABET, ALPHABET, ALPHABET)


def lattice(seen: str, edges: bool = False) -> list[list[tuple[str, float]]]:
    """Readings of each run of an observed chunk: (letters, cost). With `edges` a word may end (a blank) at any place."""
    out = []
    for m in re.finditer(r"(.)\1*", seen, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():  # two letters are rarely one drawn out, three always are
            ways = [(c, (0, 0, COST_PAIR)[n] if n < 3 else COST_RUN), *([(c + c, COST_DOUBLE * (n > 2))] if n > 1 else [])]
        else:
            ways = [(c * min(n, 2), COST_SIGN * min(n, 2))]
            for x in LOOKALIKES.get(c, ""):
                ways += [(x, COST_SWAP + COST_RUN * (n > 1)), *([(x + x, 2 * COST_SWAP)] if n > 1 else [])]
        if edges:
            ways += [(f"{c} {c}", COST_EDGE + COST_DOUBLE * (n > 2))] if c.isalpha() and n > 1 else []
            ways += [(f"{x} ", cost + COST_EDGE) for x, cost in ways] if m.end() < len(seen) else []
        out.append(ways)
    return out


def written(path: tuple | None) -> str:
    """The letters of a path, which is its last step: (path before, letters)."""
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def restored(seen: str, costs: np.ndarray, edges: bool = False) -> str:
    """The likeliest reading of a lower-case chunk, by Viterbi over states of two letter classes."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice(seen, edges):
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (cost, path) in best.items():
            for letters, noise in ways:
                a, b, total = p, q, cost + noise
                for x in letters:
                    k = 0 if x == " " else letter_class(x)
                    total += float(costs[a, b, k])
                    a, b = b, k
                if (a, b) not in now or total < now[a, b][0]:
                    now[a, b] = (total, (path, letters))
        best = now
    ends = [(cost + float(costs[p, q, 0]), path) for (p, q), (cost, path) in best.items()]
    least = min(cost for cost, _ in ends)
    return min(written(path) for cost, path in ends if cost == least)


class Reader:
    """Restores texts and gives their features; frequent chunks are remembered per task."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs, {}

    def __getstate__(self):
        return {"costs": self.costs, "known": {}}

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk (what stands between blanks), restored if it looks disguised."""
        return self.undone(chunk) or WORD.findall(chunk)

    def undone(self, chunk: str) -> list[str]:
        """The restored words of a chunk, none if it doesn't look disguised."""
        inside = chunk.strip(AROUND)
        if chunk.isalpha() or inside.isalpha() and chunk[0] != "$":
            return self.reading(inside).split() if REPEATED.search(inside) else []
        if WORD.search(chunk) and DISGUISED.search(chunk):
            return WORD.findall(self.reading(chunk.lstrip(AROUND[:-1]).rstrip(AROUND)))
        return []

    def reading(self, chunk: str) -> str:
        """The likeliest reading of a whole chunk; of a long one, that of each disguised piece."""
        folded = RUN.sub(r"\1\1\1", chunk)
        if len(folded) <= LONGEST_WORD:
            return restored(folded, self.costs) if folded else folded
        return PIECE.sub(lambda m: restored(m[0], self.costs, len(m[0]) > LONGEST_WORD) if DISGUISED.search(m[0]) else m[0], folded)

    def spelled_out(self, match: re.Match) -> str:
        """The words of a run of single letters, without their separators, restored."""
        return restored(re.sub(r"[ .\-_*]", "", match[0]), self.costs, edges=True)

    def spelled(self, text: str) -> list[str]:
        """Words spelled out letter by letter, restored: as several words, and as one, with and without a first letter that may be a word."""
        out = []
        for m in SPELLED.finditer(text):
            out += WORD.findall(self.spelled_out(m))
            letters = re.sub(r"[ .\-_*]", "", m[0])
            for one in (letters, letters[1:]):
                out += WORD.findall(restored(one, self.costs))
        return out

    def restore(self, text: str | None) -> str:
        """The text, lower-cased, with disguised words restored: what the scorer reads, in one piece."""
        low = SPELLED.sub(self.spelled_out, (text or "").lower())
        return re.sub(r"\S+", lambda m: " ".join(self.undone(m[0]) or WORD.findall(m[0])) if DISGUISED.search(m[0]) and WORD.search(m[0]) else m[0], low)

    @staticmethod
    def parts(word: str) -> list[str]:
        """Features of a word: the word itself, and its beginnings."""
        return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]

    def features(self, text: str | None, wanted: dict[str, int] | None = None) -> set:
        """Distinct features of a whole text, restored; with `wanted`, their columns there."""
        if not text:
            return set()
        low, out, known = text.lower(), set(), self.known
        if SPELLED.search(low):
            out.update(self.columns(self.spelled(low), wanted))
            low = SPELLED.sub(" ", low)
        if len(known) > MEMO:
            known.clear()
        chunks = set(low.split())
        for chunk in chunks.difference(known):
            known[chunk] = self.columns(self.words_of(chunk), wanted)
        out.update(*map(known.__getitem__, chunks))
        return out

    def columns(self, words: list[str], wanted: dict[str, int] | None) -> tuple:
        found = (x for w in words for x in self.parts(w))
        return tuple(found) if wanted is None else tuple(wanted[x] for x in found if x in wanted)


def evidence(toxic: Column, clean: Column, toxic_rows: int, clean_rows: int) -> Column:
    """Log-likelihood ratio of a feature's counts against equal rates, for features likelier in toxic rows."""
    n, total = toxic + clean, toxic_rows + clean_rows
    part = lambda k, rows: F.when(k > 0, k * F.log(k / (n * (rows / total)))).otherwise(0.0)
    return F.when(toxic / toxic_rows > clean / clean_rows, 2 * (part(toxic, toxic_rows) + part(clean, clean_rows))).otherwise(0.0)


def fit(rows: list[tuple[list[int], int]], size: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression over sets of columns, by Adam over all rows; no weight goes below zero."""
    y = np.array([t for _, t in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    col = np.fromiter((c for cs, _ in rows for c in cs), np.int64, len(at))
    w, m, s = np.ones(size + 1), 0.0, 0.0  # every feature has evidence for it
    w[-1] = -2.0
    for t in range(1, rounds + 1 if len(rows) else 1):
        z = np.bincount(at, w[col], minlength=len(rows)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(col, d[at], minlength=size), d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-10)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of every row of `docs`; only rows that aren't held out teach.

    A row is held out if crc32 of its id as text is divisible by five; null ids are. Null and empty texts have
    no features and get the score of a text without evidence. Labels that are null teach nothing; of an id's repeated
    labels each counts. Repeated rows get equal scores. Without any toxic and any clean label all scores are 0.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
    costs = language_model(docs, text_col)
    reader = docs.sparkSession.sparkContext.broadcast(Reader(costs))
    teach = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1)")
    teach = teach.where(F.crc32(F.col("_id").cast("string")) % 5 != 0)
    thin = max(1, -(-teach.count() // train_rows))
    teach = teach.where(F.pmod(F.xxhash64("_id"), F.lit(thin)) == 0)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    if thin > 1:
        narrow = narrow.where(F.pmod(F.xxhash64("_id"), F.lit(thin)) == 0)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(reader.value.features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["y", "features"])

    sample = staged(narrow.join(teach, "_id").select("_y", "_t").mapInArrow(extract, "y int, features array<string>"), "toxicity-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.lit(0.0).alias("score"))
    seen = sample.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    strong = seen.withColumn("e", evidence(F.col("t"), F.col("c"), n[1], n[0])).where(F.col("e") >= MIN_EVIDENCE)
    # Every such feature stands in several of the TRAIN_ROWS rows.
    wanted = {f: i for i, f in enumerate(sorted(r["f"] for r in strong.select("f").collect()))}
    table = docs.sparkSession.createDataFrame([(f, i) for f, i in wanted.items()], "f string, i int")
    kept = sample.withColumn("row", F.monotonically_increasing_id()).select("row", "y", F.explode_outer("features").alias("f"))
    # The table has a row for each feature that is on the driver.
    rows = kept.join(F.broadcast(table), "f", "left").groupBy("row").agg(F.first("y").alias("y"), F.collect_list("i").alias("cols")).collect()
    weights, bias = fit(sorted((sorted(r["cols"]), r["y"]) for r in rows), len(wanted))
    model = docs.sparkSession.sparkContext.broadcast((wanted, weights, bias))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("_t"))
    return out.select("doc_id", "held_out", scorer(reader, model)(F.col("_t")).alias("score"))


def scorer(reader, model):
    """The fitted scorer as a column function."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        wanted, weights, bias = model.value
        own = Reader(reader.value.costs)
        name = model._path or str(id(model))
        if name not in MEMOS:
            MEMOS.clear()
        own.known = MEMOS.setdefault(name, {})
        z = np.array([sum(weights[i] for i in own.features(t, wanted)) + bias for t in texts.to_pylist()])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


#: The last model's memory of chunks (MEMO at most); one worker serves many tasks.
MEMOS: dict[str, dict] = {}
