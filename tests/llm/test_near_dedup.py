import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import near_dedup as n


def plain_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def plain(docs, k, threshold=80):
    sets = {i: plain_set(t, k) for i, t in docs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, words, size, edits):
    """A tree of copies: each a few edits away from an earlier one."""
    out = [list(words)]
    while len(out) < size:
        w = list(rng.choice(out))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = [t for _ in range(6) for t in family(rng, some(rng.randint(20, 90)), rng.randint(2, 25), 4)]
    texts += [" ".join(some(rng.randint(1, 60))) for _ in range(60)] + ["Same  TEXT\there"] * 9 + ["same text here"] * 3 + ["one"] * 2 + ["One"]
    texts += ["", None, "  \n", ""]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5)])
def test_components_like_brute_force(spark, seed, k):
    docs = corpus(seed)
    out = n.grouped(spark.createDataFrame([(*d, None) for d in docs], "doc_id long, text string, rep string").repartition(5), k=k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()}
    want = plain(docs, k)
    assert len(set(want[i][1] for i in want)) < len(docs)
    assert got == want


def test_chains_across_open_buckets(spark):
    """A long chain of small steps is one component, though its ends share nothing."""
    words = [f"c{i}" for i in range(60)]
    docs, at = [], list(words)
    for i in range(40):
        docs.append((i, " ".join(at)))
        at = at[2:] + [f"d{i}a", f"d{i}b"]
    got = {r["doc_id"]: r["component_id"] for r in n.grouped(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    assert got == {i: c for i, (_, c, _) in plain(docs, 2).items()}
    assert set(got.values()) == {0}


def test_ids_null_repeated_and_columns(spark):
    docs = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (7, "a b c d", "z"), (8, "other words stand here", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, gone_0 string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in n.grouped(df, k=2).collect() if r["doc_id"])
    assert got == [(1, 1, True), (1, 1, True), (7, 1, False), (8, 8, True)]
    out = n.deduplicated(df, k=2)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 1, 8]
    assert n.grouped(df.limit(0)).collect() == []


def test_estimates_are_close(spark):
    h = n.Hasher(1)
    rng = np.random.default_rng(3)
    rows, want = [], []
    for _ in range(30):
        both, only = int(rng.integers(20, 400)), int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 63, both + 2 * only, dtype=np.uint64)
        a, b = np.unique(base[: both + only]), np.unique(np.concatenate([base[:both], base[both + only :]]))
        rows.append([h.sketch(h.minima(x)).tolist() for x in (a, b)])
        want.append(both / (both + 2 * only))
    got = [r[0] for r in spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(n.estimate(F.col("a"), F.col("b"))).collect()]
    assert np.abs(np.array(got) - np.array(want)).max() < 0.2
    assert np.abs(np.array(got) - np.array(want)).mean() < 0.05


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(50)] + [(5, 5)]
    got = dict(n.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 60)}, **{101 + i: 100 for i in range(50)}}
