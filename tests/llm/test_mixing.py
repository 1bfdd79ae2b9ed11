from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from beaconry.llm import mixing as m
from beaconry.llm import queries


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 0.9, "b": 0.05, "c": 0.03, None: 0.02}, {f"s{i}": 1 / (i + 1) for i in range(20)}])
def test_every_prefix_deviates_by_less_than_one_block(weights):
    share = m.shares(weights, 1000)
    assert sum(share.values()) == 1000
    slots = m.schedule(share)
    assert Counter(k for k, _ in slots) == share
    seen = Counter()
    for t, (k, j) in enumerate(slots * 2):
        assert j == seen[k] % share[k]
        seen[k] += 1
        for name, w in share.items():
            assert abs(seen[name] - Fraction(w * (t + 1), 1000)) < 1


def test_blocks_meet_their_windows():
    share = m.shares({"a": 4, "b": 3, "c": 3}, 10)
    for t, (k, j) in enumerate(m.schedule(share)):
        assert j * 10 // share[k] <= t < -(-(j + 1) * 10 // share[k])


@pytest.mark.parametrize("bad", [{}, {"a": 0}, {"a": -1}, {"a": float("inf")}, {f"s{i}": 1 for i in range(11)}])
def test_bad_weights(bad):
    with pytest.raises(ValueError, match="weights"):
        m.shares(bad, 10)


def docs(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else None, "x") for i in range(900)] + [(900 + i, None, "b", "y") for i in range(300)] + [(None, "n", "a", "z"), (5, "t5", "a", "x"), (5, "t5", "a", "x")] + [(2000, "", "unweighted", "u")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, mix_block string").repartition(5)


@pytest.mark.parametrize("slice_rows", [2000, 50])
def test_all_rows_get_the_slots_of_the_schedule(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(m, "SLICE_ROWS", slice_rows)
    rows, df = docs(spark)
    out = m.mixed(df, {"a": 5, "b": 2, None: 3}, period=10, block_rows=4).collect()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter(r[:3] for r in rows)
    share, table = m.shares({"a": 5, "b": 2, None: 3}, 10), {}
    for t, (k, j) in enumerate(m.schedule(share)):
        table[k, j] = t
    for source in ("a", "b", None):
        own = sorted((r for r in out if r["source"] == source), key=lambda r: r["mix_position"])
        ids = [r["doc_id"] for r in own]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        for n, r in enumerate(own):
            block = n // 4
            slot = block // share[source] * 10 + table[source, block % share[source]]
            assert (r["mix_block"], r["mix_slot"], r["mix_position"]) == (block, slot, slot * 4 + n % 4)
            assert r["mix_release"] <= r["mix_slot"] < r["mix_due"]
    lone = [r for r in out if r["source"] == "unweighted"]
    assert lone[0]["mix_slot"] is None and lone[0]["in_mix"] is False
    mixed_in = [r for r in out if r["in_mix"]]
    counts = Counter(r["source"] for r in mixed_in)
    for source, w in share.items():
        assert abs(counts[source] - len(mixed_in) * w / 10) <= 4


def test_empty_table(spark):
    _, df = docs(spark)
    assert m.mixed(df.limit(0), {"a": 1}).collect() == []


def test_the_query_takes_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_pfair_mix(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.mixing_stage(spark, df, str(tmp_path)).collect() == []


def test_more_sources_than_slots(spark):
    df = spark.range(2500).selectExpr("id as doc_id", "concat('host', id % 1100) as source")
    out = m.mixed(df, m.temperature_weights(df, 0.9)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(2500))
    assert len({(r["mix_position"]) for r in out}) == 2500 and any(r["in_mix"] for r in out)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_due"] for r in out)


@pytest.mark.parametrize("weights", [{"a": 0.5337, "b": 0.3331, "c": 0.1332}, {"big": 0.1} | {f"s{i}": 0.001 for i in range(900)}, {"x": 7, "y": 0.01, "z": 1e-4}])
def test_given_weights_are_met_over_many_slots(weights):
    share = m.whole(weights)
    total = sum(Fraction(str(w)) for w in weights.values())
    one = m.schedule(share)
    assert all(Fraction(w, len(one)) == Fraction(str(weights[k])) / total for k, w in share.items())
    named = list(weights)
    part = {k: Fraction(str(weights[k])) / total for k in named}
    seen, times = Counter(), 100_000 // len(one) + 1
    for t, (k, _) in enumerate((one * times)[:100_000]):
        seen[k] += 1
        assert abs(seen[k] - part[k] * (t + 1)) < 1
        if t % 997 == 0:
            assert all(abs(seen[x] - part[x] * (t + 1)) < 1 for x in named)


def test_weights_without_a_short_period_are_rounded_by_less_than_a_part():
    weights = {"a": 2**0.5, "b": 1.0, "c": 3**0.5, "d": 1e-9}
    share = m.whole(weights, 10_000)
    assert sum(share.values()) == 10_000 and share["d"] == 1
    assert all(abs(share[k] - 10_000 * w / sum(weights.values())) < 2 for k, w in weights.items())


def test_a_clashing_column_and_ties(spark):
    df = spark.createDataFrame([(1, "s", i % 2, "n") for i in range(100)], "doc_id long, source string, tie_0 int, number_0 string").repartition(7)
    out = m.mixed(df, {"s": 1}).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(100)) and set(out[0].asDict()) == {*df.columns, *m.MADE}


def test_weights_without_a_period_are_met_exactly_over_all_slots():
    sizes = {"hot": 340_000, "mid": 59_992, "tiny": 8}
    share = m.whole({k: float(n) ** 0.9 for k, n in sizes.items()})
    total = sum(share.values())
    assert total > m.PERIOD
    blocks = {k: 100_000 for k in sizes}
    seen = Counter()
    for t, (k, j, slot, release, due) in enumerate(m.scheduled(share, blocks)):
        if t == 100_000:
            break
        assert slot == t and j == seen[k] and release <= t < due
        seen[k] += 1
        assert all(abs(seen[x] * total - share[x] * (t + 1)) < total for x in sizes)


def test_rows_follow_the_schedule_of_all_blocks(spark, monkeypatch):
    rows, df = docs(spark)
    weights = {"a": 2**0.5, "b": 3**0.5, None: 1.0}
    share = m.whole(weights)
    for most, block_rows in ((1_000_000, 4), (100, 13)):
        monkeypatch.setattr(m, "MOST_SLOTS", most)
        out = m.mixed(df, weights, block_rows=4).collect()
        assert len(out) == len(rows)
        sizes = Counter(r[2] for r in rows)
        blocks = {k: -(-sizes[k] // block_rows) for k in weights}
        table = {(k, j): (t, r, d) for k, j, t, r, d in m.scheduled(share, blocks)}
        for source in weights:
            own = sorted((r for r in out if r["source"] == source), key=lambda r: r["mix_position"])
            assert [r["doc_id"] for r in own] == sorted((r[0] for r in rows if r[2] == source), key=lambda i: (i is not None, i or 0))
            for n, r in enumerate(own):
                slot, release, due = table[source, n // block_rows]
                assert (r["mix_block"], r["mix_slot"], r["mix_release"], r["mix_due"]) == (n // block_rows, slot, release, due)
                assert r["mix_position"] == slot * block_rows + n % block_rows
        inside = [r for r in out if r["in_mix"]]
        for source, w in weights.items():
            assert abs(sum(r["source"] == source for r in inside) - len(inside) * w / sum(weights.values())) <= 2 * block_rows


def test_weights_too_far_apart(spark):
    _, df = docs(spark)
    with pytest.raises(ValueError, match="far apart"):
        m.mixed(df, {"a": 1.0, "b": 1e-30})
