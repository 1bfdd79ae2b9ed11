"""The resolver on awkward names, identifiers and contexts."""

import pytest
from pyspark.sql import functions as F

from beaconry.operators import resolve

# An invented watchlist with aliases and terms that collide, and what each input must come to.
ENTITIES = [
    ("W01", "Marlow Energy", "0000700001", "M"), ("W02", "Northern Lantern Power", "0000700002", "NLP"), ("W03", "Zephyr Energy", "0000700003", "ZPH"),
    ("W04", "H&R", "0000700004", "HAR"), ("W05", "Quarter Energy (BQR)", "0000700005", "QRTR"), ("W06", "Heron Bay", "0000700006", "HRNB"),
    ("W07", "BQR Resources", "0000700007", "BQR"), ("W08", "Summit Resources", "0000700008", "SMR"), ("W09", "Lyric Energy", "0000700009", "LYRC"),
    ("WX1", "Cedar Utilities", "", ""), ("WX2", "Cedar Utility Services", "", ""),
]
ALIASES = [("W02", "NLP"), ("W04", "Harbor Gas and Rail"), ("W04", "H&R Corporation"), ("W05", "Quarter Energy"), ("W06", "Heron Bay Power"), ("W06", "Heron Bay Corporation"), ("W07", "Red Mesa Light")]
COLLISIONS = [("W01", "Marlow"), ("W09", "Lyric"), ("W08", "Summit"), ("W03", "Zephyr"), ("W06", "Heron Bay"), ("W05", "BQR"), ("W07", "BQR")]
CASES = [
    ("name", "Marlow", "", "review", None), ("name", "Marlow", "Crews of Marlow Energy were back at work on Monday", "matched", "W01"),
    ("name", "Lyric", "", "review", None), ("name", "Summit", "", "review", None), ("name", "Zephyr", "", "review", None), ("name", "Heron Bay", "", "review", None),
    ("name", "Heron Bay", "A new tariff of Heron Bay Power is before the board", "matched", "W06"), ("name", "BQR", "", "review", None),
    ("name", "BQR", "Shares of BQR Resources rose after its report", "matched", "W07"), ("name", "BQR", "One notice names Quarter Energy and also BQR Resources", "review", None),
    ("name", "Red Mesa Light", "", "matched", "W07"), ("name", "NLP", "", "matched", "W02"), ("name", "Harbor Gas & Rail", "", "matched", "W04"),
    ("name", "Zephyr Energy Corporation", "", "matched", "W03"), ("name", "Quarter Energy", "", "matched", "W05"), ("name", "Marlw Energy", "", "matched", "W01"),
    ("name", "Cedar Utilities Group", "", "matched", "WX1"), ("name", "Cedar Utilitys", "", "review", None), ("name", "Fourteen Hats Bakery", "", "none", None),
    ("cik", "0000700001", "", "matched", "W01"), ("cik", "700001", "", "matched", "W01"), ("ticker", "har", "", "matched", "W04"), ("ticker", "BQR", "", "matched", "W07"),
]


@pytest.fixture(scope="module")
def watchlist(spark):
    entities = spark.createDataFrame([(*e, "") for e in ENTITIES], "entity_id string, name string, cik string, ticker string, lei string")
    return entities, spark.createDataFrame(ALIASES, "entity_id string, alias string"), spark.createDataFrame(COLLISIONS, "entity_id string, term string")


def test_awkward_cases(spark, watchlist):
    kinds = ("cik", "ticker", "lei", "name")
    rows = [(i, *(value if k == kind else None for k in kinds), context) for i, (kind, value, context, _, _) in enumerate(CASES)]
    events = spark.createDataFrame([*rows, (99, None, None, None, None, None), (98, None, None, None, "Inc.", "")], "event_id int, cik string, ticker string, lei string, name string, context string")
    got = {r["event_id"]: r for r in resolve.resolved(events, *watchlist).collect()}
    assert len(got) == len(CASES) + 2
    for i, (_, value, context, status, entity) in enumerate(CASES):
        assert (got[i]["status"], got[i]["entity_id"]) == (status, entity), (value, context)
    assert got[98]["status"] == got[99]["status"] == "none"
    assert got[15]["method"] == "fuzzy" and 0.9 <= got[15]["confidence"] < 1


def test_bounds_never_lose_a_near_name(spark):
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(1)
    some = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 12))).strip() or "a"
    names, terms = {some() for _ in range(60)}, [(i, some()) for i in range(80)]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r for r in resolve.fuzzy(frame, spark.createDataFrame(terms, "entity_id int, term string")).collect()}
    for n in names:
        near = {t for _, t in terms if SequenceMatcher(None, t, n).ratio() >= 0.75}
        assert (n in got) == bool(near)
        if n in got:
            top = sorted(near, key=lambda t: (SequenceMatcher(None, t, n).ratio(), t), reverse=True)[:8]
            assert got[n]["confidence"] == pytest.approx(max(SequenceMatcher(None, n, t).ratio() for t in top), abs=1e-4)


def test_rollup_stops_in_cycles_and_at_absent_parents(spark):
    entities = spark.createDataFrame([(i, None) for i in range(1, 7)] + [(7, 6)], "entity_id long, parent_id long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (3, 9)], "child long, parent long")
    got = dict(resolve.rolled_up(entities, edges).collect())
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert got[5] == 5 and got[6] == 6 and got[7] in (5, 6)
    assert resolve.review_rows(spark.createDataFrame([(1, "review", ["a", "b"], "m", 0.7)], "event_id int, status string, candidates array<string>, method string, confidence double")).select(F.count("*")).first()[0] == 2
