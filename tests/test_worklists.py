from datetime import date

from pyspark.sql import functions as F

from beaconry.functions import text
from beaconry.operators import changes, measure, resolve


def test_walks_up_until_it_stops(spark):
    entities = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 26)] + [(100, 101), (101, 100)], "entity_id long, parent_id long")
    edges = spark.createDataFrame([], "child long, parent long")
    top = {r["entity_id"]: r["top"] for r in resolve.rolled_up(entities, edges, steps=4).collect()}
    assert {top[i] for i in range(1, 26)} == {1} and {100, 101} <= set(top)


def test_nested_parentheses_go(spark):
    rows = spark.createDataFrame([("X (a (b (c (d (e (f))))))",), ("A (b) ET AL.",), ("open ( here",), (None,)], "n string")
    assert [r[0] for r in rows.select(text.case_name(F.col("n"))).collect()] == ["X", "A", "open ( here", ""]


def test_equal_rows_stay_apart(spark):
    calls = spark.createDataFrame([("m", date(2024, 1, 5), 400, 10)] * 3 + [("x", date(2024, 1, 5), 1, 1)], "model string, day date, chars int, max_out int")
    prices = spark.createDataFrame([("m", date(2024, 1, 1), 1.0, 1.0), ("m", date(2024, 1, 4), 2.0, 2.0)], "model string, start date, per_million_in double, per_million_out double")
    assert sorted(str(r["cost"]) for r in measure.price_at(calls, prices).collect()) == ["0.00022"] * 3 + ["None"]
    points = spark.createDataFrame([(1, 1.0, 1.0)] * 3, "id int, x double, y double")
    boxes = spark.createDataFrame([("r", 0.0, 0.0, 2.0, 2.0), ("s", 0.0, 0.0, 1.0, 1.0)], "region string, x0 double, y0 double, x1 double, y1 double")
    assert [r["region"] for r in measure.located(points, boxes).collect()] == ["s"] * 3
    queue = spark.createDataFrame([(1, None, "pending"), (2, "a", "pending")], "event_id int, candidate string, disposition string")
    made = spark.createDataFrame([(1, None, True, 1), (1, None, False, 2)], "event_id int, candidate string, accept boolean, decided_at int")
    assert sorted((r["event_id"], r["disposition"]) for r in changes.disposed(queue, made).collect()) == [(1, "rejected"), (2, "pending")]


def test_signals_are_counted_by_trigger_before_they_meet_rules(spark):
    from beaconry import registry

    plan = registry.queries()["k11_sound_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [trigger_id") == 1 or plan.index("Join") < plan.rindex("Aggregate")


def test_rules_on_documents_are_judged_once_for_obligations(spark):
    from beaconry.plans import obligations

    plan = obligations._considered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the signals and the old ones among them, both from one checkpoint
