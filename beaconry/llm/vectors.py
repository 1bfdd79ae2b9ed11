"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means that makes crowded clusters dearer. A graph joins each
centroid with its nearest ones; a search walks it best-first and takes every list whose centroid is at most
`ratio` times as far as the nearest (and more, until the lists hold enough vectors). All vectors are indexed: one near a
boundary goes to several lists, but not where a closer list's centroid lies nearer to the list's than
the vector does. Lists are cut into blocks of `BLOCK` vectors and queries of a list into blocks as well, so no task's group
grows with the data; each block gives each query its nearest, scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors that fit the centroids, about so many at most: one an id, taken by the hash of their ids.
SAMPLE = 20_000
LIST_SIZE = 512
MAX_LISTS = 4096
REPLICAS = 4
#: A vector goes to lists up to so many times as far as its nearest centroid.
BUILD_RATIO = 1.10
#: A query looks into lists up to so many times as far as its nearest centroid.
SEARCH_RATIO = 1.22
DEGREE = 24
#: A walk expands so many centroids at least, so that it doesn't end in a hollow.
EXPAND = 32
BLOCK, QUERY_BLOCK = 4096, 1024
SEED = 11


@dataclass
class Centroids:
    """Unit centroids and the graph over them."""

    at: np.ndarray
    graph: np.ndarray
    starts: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int, rounds: int = 12) -> Centroids:
        rng = np.random.default_rng(SEED)
        k = max(1, min(lists, len(sample)))
        c = sample[rng.choice(len(sample), k, replace=False)] if len(sample) else np.zeros((1, 1))
        load = np.zeros(k)
        for _ in range(rounds if len(sample) else 0):
            near = 2 - 2 * sample @ c.T
            own = np.argmin(near + 0.1 * near.mean() * np.minimum(load, 3), axis=1)
            count = np.bincount(own, minlength=k)
            load = count / max(1, count.mean())
            total = np.zeros_like(c)
            np.add.at(total, own, sample)
            spare = np.flatnonzero(count == 0)
            total[spare] = sample[rng.choice(len(sample), len(spare))]
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
        near = c @ c.T
        np.fill_diagonal(near, -np.inf)
        degree = min(DEGREE, k - 1)
        graph = np.argsort(-near, axis=1)[:, :degree]
        far = np.array([rng.choice(k, min(4, k), replace=False) for _ in range(k)])  # long edges hold the graph together
        return Centroids(c, np.hstack([graph, far]), rng.choice(k, min(8, k), replace=False))

    def walk(self, x: np.ndarray, ratio: float, least: np.ndarray | None = None, want: int = 0) -> list[np.ndarray]:
        """For each row of x the centroids within `ratio` times the nearest distance, nearest first.

        Best-first over the graph, all rows in step: the nearest centroid that isn't expanded yet is, while it is within
        the ratio and `EXPAND` times at least. With `least` (list sizes) rows go on until the lists taken hold `want` vectors.
        """
        n, k = len(x), len(self.at)
        d = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        rows = np.arange(n)
        d[:, self.starts] = np.sqrt(np.maximum(0, 2 - 2 * x @ self.at[self.starts].T))
        held, steps = np.zeros(n), 0
        while len(rows):
            open_d = np.where(done[rows], np.inf, d[rows])
            at = open_d.argmin(axis=1)
            here = open_d[np.arange(len(rows)), at]
            go = (here <= ratio * d[rows].min(axis=1) + 1e-12) | (steps < EXPAND)
            if least is not None:
                go |= held[rows] < want
            go &= np.isfinite(here)
            steps += 1
            rows, at = rows[go], at[go]
            done[rows, at] = True
            if least is not None:
                held[rows] += least[at]
            to = self.graph[at]
            d[rows[:, None], to] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ngd->ng", x[rows], self.at[to])))
        out = []
        for i in range(n):
            ids = np.flatnonzero(done[i])
            ids = ids[np.argsort(d[i, ids], kind="stable")]
            take = int((d[i, ids] <= ratio * d[i, ids[0]] + 1e-12).sum())  # the way there may have led over farther ones
            if least is not None:
                take = max(take, 1 + int(np.searchsorted(np.cumsum(least[ids]), want)))
            out.append(ids[:take])
        return out

    def assigned(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and of the others near the boundary those that aren't in its lee."""
        out = []
        for row, ids in zip(x, self.walk(x, BUILD_RATIO), strict=True):
            taken = [int(ids[0])]
            for j in ids[1:]:
                d = np.linalg.norm(row - self.at[j])
                if len(taken) < REPLICAS and all(np.linalg.norm(self.at[i] - self.at[j]) >= d for i in taken):
                    taken.append(int(j))
            out.append(np.array(taken))
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part: with an id, without null or non-finite components, not zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows over their norm; scaled first, so that huge or tiny components neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; equal rows give equal bits wherever they stand.

    Rows are scaled by powers of two first, which changes no bit of the result but where squares would over- or underflow.
    """
    a, b = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) for m in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = SEARCH_RATIO) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of each query's k nearest found among `vectors`.

    Rows with null ids, null, zero or non-finite vectors take no part, nor do vectors whose length isn't
    the commonest (ties: the shortest). Rows that share the query's id aren't its candidates; an id that is repeated is found once,
    with its best score. A query id that is repeated is one query too: a candidate's score is the best with any of its vectors. Ties go to the
    smaller id. A query gets fewer than k rows only if there are fewer ids to find: one that its lists leave short looks into all lists.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = sorted(((r["count"], -r["n"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect()), reverse=True)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dims = -sizes[0][1]
    rows = rows.where(F.size("v") == dims)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dims)

    ids = rows.select("id").distinct().count()
    thin = max(1, -(-ids // SAMPLE))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(thin)) == 0).groupBy("id").agg(F.min("v").alias("v"))  # one vector an id
    sample = drawn.toPandas().sort_values("id", kind="stable")
    sample = unit(np.stack(sample["v"].to_numpy())) if len(sample) else np.zeros((0, dims))
    lists = int(min(MAX_LISTS, max(1, ids // LIST_SIZE), max(1, len(sample) // 8)))
    index = spark.sparkContext.broadcast(Centroids.fit(sample if len(sample) else np.eye(1, dims), lists))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"))
            if len(m):
                own = index.value.assigned(unit(m))
                at = np.repeat(np.arange(len(m)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int32()), *(batch.column(c).take(pa.array(at)) for c in ("id", "v"))], ["list", "id", "v"])

    posted = staged(rows.mapInArrow(post, "list int, id bigint, v array<double>"), "postings")
    held_ids = posted.groupBy("list", "id").agg(F.count("*").alias("n")).groupBy("list").agg(F.count("*").alias("ids"), F.sum("n").alias("n")).collect()  # a row a list
    counts, ids_of = {r["list"]: r["n"] for r in held_ids}, {r["list"]: r["ids"] for r in held_ids}
    held = np.array([ids_of.get(i, 0) for i in range(len(index.value.at))])
    want = REPLICAS * (k + 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"))
            if len(m):
                own = index.value.walk(unit(m), ratio, held, want)
                at = np.repeat(np.arange(len(m)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int32()), *(batch.column(c).take(pa.array(at)) for c in ("id", "v"))], ["list", "id", "v"])

    looked = staged(asked.mapInArrow(look, "list int, id bigint, v array<double>"), "looked")

    def nearest(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, m = np.stack(asking["v"].to_numpy()), np.stack(there["v"].to_numpy())
        qi, mi = asking["id"].to_numpy(), there["id"].to_numpy()
        order = np.argsort(mi, kind="stable")
        m, mi = m[order], mi[order]
        starts = np.flatnonzero(np.append(True, mi[1:] != mi[:-1]))
        rough = unit(q) @ unit(m).T
        rough[qi[:, None] == mi[None, :]] = -np.inf
        by_id = np.maximum.reduceat(rough, starts, axis=1)  # an id's copies mustn't take the places of others
        take = min(k, len(starts))
        least = np.partition(by_id, len(starts) - take, axis=1)[:, len(starts) - take]
        out = []
        for i in range(len(qi)):  # one by one, as all of a block's vectors may tie
            at = np.flatnonzero((rough[i] >= least[i] - 1e-9) & np.isfinite(rough[i]))
            exact = cosines(np.broadcast_to(q[i], (len(at), q.shape[1])), m[at]) if len(at) else np.empty(0)
            best, ids, scores = np.lexsort((mi[at], -exact)), mi[at], exact
            _, first = np.unique(ids[best], return_index=True)  # an id that is repeated counts once, with its best score
            best = best[np.sort(first)][:k]
            out.append(pd.DataFrame({"query_id": qi[i], "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out)

    def searched(looking: DataFrame) -> DataFrame:
        """query_id, vec_id and score: each query's k nearest ids in each block of the lists that it looks into."""
        waiting = {r["list"]: r["count"] for r in looking.groupBy("list").count().collect()}
        cuts = [(i, -(-counts[i] // BLOCK), -(-waiting[i] // QUERY_BLOCK)) for i in counts if i in waiting]
        # One row a list: MAX_LISTS at most.
        cut = F.broadcast(spark.createDataFrame(cuts, "list int, blocks int, turns int"))
        keys = ["list", "block", "turn"]
        cells = posted.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(*keys, "id", "v")
        turns = looking.join(cut, "list").withColumn("turn", F.pmod(F.xxhash64("id", "v"), F.col("turns")).cast("int"))
        turns = turns.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "id", "v")
        found = turns.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(nearest, "query_id bigint, vec_id bigint, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    best = staged(ranked(searched(looked), k), "nearest")
    most = min(k, ids - 1)
    full = best.groupBy("query_id").count().where(F.col("count") >= most).select(F.col("query_id").alias("id"))
    short = staged(asked.join(full, "id", "left_anti"), "short")
    if most <= 0 or short.isEmpty():
        return best
    # These look into every list. Such are those whose lists hold copies of few ids.
    whole = short.withColumn("list", F.explode(F.lit(np.array(sorted(counts), np.int32)))).select("list", "id", "v")
    again = ranked(searched(staged(whole, "looked")), k)
    return best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
