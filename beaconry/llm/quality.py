"""Quality from weak labels: labellers' accuracies by expectation-maximisation, posteriors train a hashed linear scorer.

Eight heuristic labellers look at a document and vote good (+1), bad (-1) or abstain (0). How often each
pattern of votes occurs is counted over all documents (3^8 patterns at most come to the driver); EM over the
counts estimates the share of good documents and, for each labeller, how it votes on good and on bad ones.
The posterior of a pattern then labels a bounded sample of different texts (`TRAIN_ROWS`; one with n copies weighs
1 + log n), which trains a logistic scorer on hashed features: byte trigrams, shapes (letter case, digits, punctuation) in fives, repeated
words. The scorer, not the votes, judges every document, so what labellers abstain on is judged as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import unused

#: The scorer is fitted on so many different texts at most, taken by their hash.
TRAIN_ROWS = 6000
BITS = 11
SEED = 7

#: (labeller, bad from, good up to): a ratio from the first on votes bad, up to the second votes good.
LABELLERS = [
    ("symbols", 0.10, 0.02),  # marks other than . , ; : ' " ( ) - to visible characters
    ("capitals", 0.50, 0.15),  # upper-case to all letters
    ("separators", 0.15, 0.02),  # words that are a lone mark
    ("echoes", 0.30, 0.05),  # words equal to the one before
    ("exclaims", 0.20, 0.02),  # words ending in two marks or more
    ("monotony", 0.60, 0.35),  # 1 - distinct/total, the mean over windows of 200 words, of 20 words or more
    ("unclosed", 0.995, 0.96),  # words without a closing . , ; : ? or !
    ("digits", 0.30, 0.05),  # digits to visible characters
]
MONOTONY_WORDS = 200
PLAIN_MARKS = b".,;:'\"()-"

#: Byte classes: 0 blank, 1 lower-case, 2 upper-case, 3 digit, 4 closing mark, 5 other mark, 6 non-ASCII, 7 line feed.
CLASS = np.array(
    [7 if c == 10 else 0 if c <= 32 else 3 if 48 <= c <= 57 else 2 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 6 if c >= 128 else 4 if chr(c) in ".,;:?!'\"()-" else 5 for c in range(256)],
    np.int64,
)


def monotony(w: list[bytes]) -> float:
    """Mean share of repeats in windows of `MONOTONY_WORDS` over all words; the last window is the text's last words, whole as the others."""
    last = max(0, len(w) - MONOTONY_WORDS)
    starts = [*range(0, last, MONOTONY_WORDS), last]
    return sum(1 - len(set(x)) / len(x) for x in (w[i : i + MONOTONY_WORDS] for i in starts)) / len(starts)


def measures(raw: bytes) -> list[float | None]:
    """The labellers' ratios; None where a labeller can't tell."""
    if not raw or raw.isspace():
        return [None] * len(LABELLERS)
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    w = raw.split()
    n, visible, letters = len(w), len(raw) - int(kinds[0] + kinds[7]), int(kinds[1] + kinds[2])
    marks = sum(raw.count(bytes([c])) for c in b"#$%&*+/<=>@[\\]^_`{|}~!")
    lone = sum(len(x) == 1 and CLASS[x[0]] == 5 for x in w)
    echoes = sum(a == b for a, b in zip(w, w[1:], strict=False))
    double = sum(len(x) > 2 and CLASS[x[-1]] in (4, 5) and x[-1] == x[-2] for x in w)
    closed = sum(x[-1] in b".,;:?!" for x in w)
    return [
        marks / max(1, visible),
        int(kinds[2]) / letters if letters >= 20 else None,
        lone / n if n >= 4 else None,
        echoes / (n - 1) if n >= 6 else None,
        double / n if n >= 4 else None,
        monotony(w) if n >= 20 else None,
        1 - closed / n if n >= 40 else None,
        int(kinds[3]) / max(1, visible),
    ]


def votes(raw: bytes | None) -> str:
    """One letter per labeller: g, b or -."""
    return "".join("-" if x is None else "b" if x >= bad else "g" if x <= good else "-" for x, (_, bad, good) in zip(measures(raw or b""), LABELLERS, strict=True))


@arrow_udf(StringType())
def votes_of(texts: pa.Array) -> pa.Array:
    return pa.array([votes(x) for x in texts.to_pylist()], pa.string())


def fit_labels(patterns: dict[str, int], rounds: int = 60) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over pattern counts: share of good documents, P(vote | class) per labeller, P(good | pattern).

    Votes start as right more often than wrong, which tells the classes apart; counts are smoothed by one.
    An abstention says nothing of either class, so a short text isn't held to be bad for being short.
    """
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], float)
    v = np.array([["gb-".index(c) for c in p] for p in names]).reshape(len(names), len(LABELLERS))
    share = 0.7
    tables = np.tile(np.array([[0.85, 0.15, 1.0], [0.5, 0.5, 1.0]])[:, None, :], (1, len(LABELLERS), 1))
    post = np.full(len(names), share)
    for _ in range(rounds if len(names) else 0):
        logs = np.log([share, 1 - share])[:, None] + sum(np.log(tables[:, j, v[:, j]]) for j in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        weight = np.stack([counts * post, counts * (1 - post)])
        share = float(np.clip((weight[0].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        for j in range(len(LABELLERS)):
            got = np.stack([np.bincount(v[:, j], w, minlength=3)[:2] for w in weight]) + 1
            tables[:, j, :2] = got / got.sum(1, keepdims=True)
    return share, tables, dict(zip(names, post.tolist(), strict=True))


def features(raw: bytes) -> np.ndarray:
    """Hashed features of one text: roots of their rates, in 2^BITS slots."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    size, out = 1 << BITS, np.zeros(1 << BITS, np.float32)
    for codes, order, salt in ((b, 3, 0x9E3779B1), (CLASS[b], 5, 0x85EBCA6B)):
        if len(codes) >= order:
            h = np.zeros(len(codes) - order + 1, np.int64)
            for i in range(order):
                h = h * 257 + codes[i : len(codes) - order + 1 + i]
            slots = ((h * salt) & 0xFFFFFFFF) >> (32 - BITS)
            out += np.bincount(slots, minlength=size).astype(np.float32) / len(slots)
    w = raw.split()
    out[0] += sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(1, len(w) - 1)
    return np.sqrt(out)


def fit_scorer(x1: np.ndarray, y: np.ndarray, rounds: int = 250, decay: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam over all rows; the same rows give the same weights.

    The last column of `x1` is the bias's: ones.
    """
    w, b, m, s = np.zeros(x1.shape[1], np.float32), 0.0, 0.0, 0.0
    part = np.ones(len(x1)) if weight is None else weight
    part = (part / max(1e-9, part.sum())).astype(np.float32)
    for t in range(1, rounds + 1 if len(x1) else 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ ((p - y) * part).astype(np.float32) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = (w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    b = float(w[-1])
    return w[:-1], b


def scored(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, str]:
    """`docs` with one double column more (its name is returned): P(good), from the fitted scorer.

    Null, empty and blank texts score 0: nothing speaks for them; ties at a threshold are the caller's (0.5 is kept by kept()). All rows stay, repeated ones too, and each gets
    the score of its text. An empty table is returned empty. Whole texts are looked at.
    """
    raw = F.col(text_col).cast("binary")
    voted = docs.select(raw.alias("t"), votes_of(raw).alias("v"))
    counted = voted.where(F.length(F.trim(F.col("t").cast("string"))) > 0).groupBy("v").count()
    patterns = {r["v"]: r["count"] for r in counted.collect()}
    total = sum(patterns.values())
    _, _, posterior = fit_labels(patterns)

    thin = max(1, -(-total * 11 // (train_rows * 10)))
    sample = docs.select(raw.alias("t")).where(F.pmod(F.xxhash64("t", F.lit(SEED)), F.lit(thin)) == 0).where(F.length(F.trim(F.col("t").cast("string"))) > 0)
    sample = sample.groupBy("t").agg(F.count("*").alias("n"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([posterior.get(votes(x), 0.5) for x in texts], pa.float64()), pa.array([features(x).astype("<f2").tobytes() for x in texts], pa.binary()), batch.column(1)], ["y", "x", "n"]
            )

    rows = sample.mapInArrow(featured, "y double, x binary, n bigint").orderBy(F.xxhash64("x"), "x", "y").limit(train_rows).toArrow()
    x = np.ones((len(rows), (1 << BITS) + 1), np.float32)
    for i, one in enumerate(rows["x"]):
        x[i, :-1] = np.frombuffer(one.as_buffer(), "<f2")
    weights, bias = fit_scorer(x, rows["y"].to_numpy().astype(np.float32), weight=1 + np.log(rows["n"].to_numpy().astype(float)))
    del rows, x

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        z = [None if not t or t.isspace() else float(features(t) @ weights) + bias for t in texts.to_pylist()]
        return pa.array([0.0 if v is None else float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in z], pa.float64())

    name = unused(docs, "quality_score")
    return docs.withColumn(name, score(raw)), name


def kept(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` that the scorer doesn't reject, all columns kept."""
    out, name = scored(docs, **options)
    return out.where(F.col(name) >= threshold).drop(name)
