import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "e", None) for i, v, label in rows], SCHEMA)


def plain(rows, positives=5, negatives=10, low=30, high=90):
    """The contract by whole numbers of Python."""
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, own in fine:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, label) for i, w, label in fine)
        for s, p, _ in [x for x in scored if x[2] == own and x[1] != a][:positives]:
            fits = [(n, t) for t, n, label in scored if label != own and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in h.mined(df, F.col("vec_id") % 100 == 0, **more).collect())


def clusters(rng, n, dims=12, labels=3):
    centre = rng.normal(size=(labels, dims)) * 0.3 + 0.2
    return [(i, (centre[i % labels] + 0.3 * rng.normal(size=dims)).tolist(), i % labels if i % 11 else (i + 1) % labels) for i in range(n)]


def test_equal_to_plain_code_with_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(h, "CHUNK", 7)
    monkeypatch.setattr(h, "ANCHORS", 6)
    monkeypatch.setattr(h, "GATHERED", 50)
    rows = clusters(np.random.default_rng(5), 900)
    hot = rows[200]
    rows += [(2000 + i, hot[1], i % 3) for i in range(300)]  # one vector that many rows share: ties
    rows += [(3000, None, 1), (3001, [0.1, None], 1), (3002, [float("inf")] * 12, 1), (3003, [float("nan")] * 12, 1), (3004, hot[1], None), (None, hot[1], 1)]
    rows += [(3100, [], 1), (3200, [0.5, -3.0], 2), (7, rows[7][1], rows[7][2]), (300, rows[300][1], rows[300][2])]
    want = plain(rows)
    assert len(want) > 300 and len({r[0] for r in want}) > 5
    assert found(frame(spark, rows).repartition(5)) == want
    assert found(frame(spark, rows[:250]), positives=2, negatives=3, window=(0, 100)) == plain(rows[:250], 2, 3, 0, 100)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, [1.0], 1), (1, [0.5], 2)], [(None, None, None)]])
def test_nothing_to_find(spark, rows):
    assert found(frame(spark, rows)) == []


def test_scores_are_whole_for_any_signs_and_sizes():
    rng = np.random.default_rng(6)
    for bits in (2, 9, 20, 24):
        m = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (40, 24))
        layout = h.Layout(3, bits)
        planes = layout.packed(m)
        assert (layout.unpacked(planes) == m).all()
        assert (h.Anchors(m[:9], layout).scores(planes) == m @ m[:9].T).all()


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        found(frame(spark, [(100, [1e30], 1), (1, [1.0], 1)]))
    big = [(100, [3e5, 1e5], 1), (1, [3e5, -1e5], 1), (2, [1.5e5, 1e5], 2)]
    assert found(frame(spark, big)) == plain(big) != []
