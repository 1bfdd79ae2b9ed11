import numpy as np
import pytest

from beaconry.llm import vectors as v


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "e") for i, x in rows], "vec_id long, embedding array<float>, score string")


def plain(rows, k=5):
    fine = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    out = {}
    for i, x in fine:
        if i % 50 == 0:
            best = {}
            for j, y in fine:
                if j != i:
                    s = float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))
                    best[j] = max(s, best.get(j, -2))
            out[i] = sorted(best.items(), key=lambda r: (-round(r[1], 12), r[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(v.neighbours(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (300, None), (301, []), (302, [0, 0, 0, 0]), (303, [1, None, 0, 0]), (304, [1, float("nan"), 0, 0]), (350, [float("inf"), 0, 0, 0]), (None, [1, 1, 1, 1]), (7, rows[7][1])]
    same(found(frame(spark, rows)), plain(rows))


def test_ties_and_fewer_candidates_than_asked(spark):
    same(found(frame(spark, [(i, [1, 2]) for i in range(40)] + [(50, [2, 4])])), plain([(i, [1, 2]) for i in range(40)] + [(50, [2, 4])]))
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])]
    same(found(frame(spark, rows)), plain(rows))
    assert found(frame(spark, [(0, [1, 0])])) == {}
    assert found(frame(spark, [])) == {}


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(v, "LIST_SIZE", 40)
    monkeypatch.setattr(v, "BLOCK", 60)
    monkeypatch.setattr(v, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[rng.integers(12)] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2500)]
    rows += [(5000 + i, rows[0][1]) for i in range(800)]  # a hot vector
    got, want = found(frame(spark, rows)), plain(rows)
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]


@pytest.mark.parametrize("ratio", [1.05, 1.4])
def test_the_walk_takes_the_lists_within_the_ratio(ratio):
    rng = np.random.default_rng(3)
    x = v.unit(rng.normal(size=(3000, 8)))
    index = v.Centroids.fit(x, 150)
    d = np.sqrt(np.maximum(0, 2 - 2 * x[:200] @ index.at.T))
    seen = agreed = 0
    for i, got in enumerate(index.walk(x[:200], ratio)):
        want = set(np.flatnonzero(d[i] <= ratio * d[i].min()).tolist())
        seen, agreed = seen + len(want), agreed + len(want & set(got.tolist()))
        assert set(got.tolist()) <= want
    assert agreed >= 0.97 * seen


def test_huge_components_and_many_ties(spark):
    import numpy as np

    from beaconry.llm import vectors as v

    assert v.cosines(np.array([[1e200, 1e200]]), np.array([[1e-200, 1e-200]]))[0] == 1.0
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000, [3.0, 1.0, 0.0]), (5001, [3.0, 1.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = v.neighbours(df, df.where("vec_id in (50, 5000)"), k=3).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 50] == [(50, 1, 0), (50, 2, 1), (50, 3, 2)]


def test_copies_of_an_id_leave_no_query_short(spark, monkeypatch):
    monkeypatch.setattr(v, "LIST_SIZE", 40)
    monkeypatch.setattr(v, "BLOCK", 500)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    near = centre[0] + 0.4 * rng.normal(size=16)
    rows = [(0, near.tolist())] + [(7, (near + 0.01 * rng.normal(size=16)).tolist()) for _ in range(1500)]
    rows += [(100 + i, (centre[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(600)]
    got, want = found(frame(spark, rows)), plain(rows)
    assert [i for i, _ in got[0]][0] == 7 and all(len(x) == 5 for x in got.values())
    assert sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want) >= 0.9 * sum(map(len, want.values()))


def test_few_ids_with_very_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(v, "LIST_SIZE", 20)
    rng = np.random.default_rng(5)
    rows = [(i % 4, rng.normal(size=6).tolist()) for i in range(800)] + [(50, rng.normal(size=6).tolist()), (60, (5 * np.ones(6)).tolist())]
    got, want = found(frame(spark, rows)), plain(rows)
    assert {k: {i for i, _ in x} for k, x in got.items()} == {0: {1, 2, 3, 50, 60}, 50: {0, 1, 2, 3, 60}}
    assert len(want[50]) == 5


def test_a_repeated_query_id_is_one_query(spark):
    rows = [(50, [1, 0, 0]), (50, [0, 1, 0]), (1, [1, 0.1, 0]), (2, [0, 1, 0.2]), (3, [1, 1, 1])]
    got = found(frame(spark, rows))
    best = lambda y: max(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for x in ([1, 0, 0], [0, 1, 0]))
    want = sorted(((i, best(np.array(y, np.float32).astype(float))) for i, y in rows if i != 50), key=lambda r: -r[1])
    assert [i for i, _ in got[50]] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got[50], want, strict=True))
