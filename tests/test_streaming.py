"""Streams give what the batch operators give over the same rows, after any split into batches and after restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from beaconry.operators import rules
from beaconry.operators.classify import identified
from beaconry.operators.state import upserted
from beaconry.streaming import ingest

STATE = "key string, payload double, first_seen bigint, last_seen bigint"
EVENTS = "run int, event_id bigint, key string, payload double"


def test_upserts_repeat_and_do_not_mind_order(spark):
    old = spark.createDataFrame([("a", 1.0, 1, 1)], STATE)
    batch = spark.createDataFrame([("a", 9.0, 5, 5), ("b", 3.0, 4, 4), ("b", 2.0, 3, 3), ("c", None, 7, 7)], STATE).withColumn("o", F.col("first_seen"))
    once = upserted(old, batch, "key", "o", ["payload", "first_seen"], ["last_seen"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("a", 1.0, 1, 5), ("b", 2.0, 3, 4), ("c", None, 7, 7)]
    again = upserted(once, batch.orderBy(F.desc("o")).repartition(3), "key", "o", ["payload", "first_seen"], ["last_seen"])
    assert sorted(map(tuple, again.collect())) == rows


def written(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files", [1, 5])
def test_upserts_of_a_stream(spark, tmp_path, files):
    rng = random.Random(files)
    folder, log = str(tmp_path / "in"), ingest.ChangeLog(spark, str(tmp_path / "state"), STATE)
    rows, state = [], spark.createDataFrame([], STATE)

    def run():
        events = ingest.file_stream(spark, folder, EVENTS, files).withColumns({"first_seen": F.col("event_id"), "last_seen": F.col("event_id")})
        ingest.upsert_stream(events, log, str(tmp_path / "ck"), "key", ["run", "event_id"], ["payload", "first_seen"], ["last_seen"]).awaitTermination()

    for r in range(2):  # the second run is a restart with new files
        new = [(r, r * 1000 + i, rng.choice("abcdefgh") + str(r * rng.randrange(2)), rng.choice([None, 1.5, 2.5])) for i in range(60)]
        for k in range(3):
            written(spark, new[k::3], EVENTS, folder)
        run()
        batch = spark.createDataFrame(new, EVENTS).selectExpr("key", "payload", "event_id", "event_id as first_seen", "event_id as last_seen")
        state = upserted(state, batch, "key", "event_id", ["payload", "first_seen"], ["last_seen"])
        rows += new
        assert sorted(map(tuple, log.latest("key").collect())) == sorted(map(tuple, state.collect()))
    n = log.read().agg(F.max("batch")).first()[0]
    assert log.read().where(F.col("batch") == n).count() <= 16  # a batch logs the keys that it met
    run()
    assert sorted(map(tuple, log.latest("key").collect())) == sorted(map(tuple, state.collect()))


PRESS = "raw_event_id string, delivered bigint, title string, event_date string"
SIGNALS = "signal_id string, raw_event_id string, name_hint string, confidence double, status string, change string"


def after(spark, rows):
    """Plainly: what each delivery gives by itself; the last one of an event counts."""
    given = {}
    for k, row in enumerate(rows):
        given[row[:2]] = k
    alone = spark.createDataFrame([(f"{e}#{d}", d, title, day) for e, d, title, day in rows], PRESS)
    found = {r["raw_event_id"]: r["name_hint"] for r in identified(rules.company_statements(alone)).collect()}
    out = {}
    for e in {r[0] for r in rows}:
        by = {d: found.get(f"{e}#{d}") for x, d in given if x == e}
        if any(v is not None for v in by.values()):
            last = by[max(by)]
            out[e] = ("active", last) if last is not None else ("retracted", None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_a_rule_over_a_stream_after_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    titles = ["Norwind confirms data breach", "Sudwind reports cyber-attack", "Rain", None, "Norwind confirms data breach again"]
    rows = [(f"e{i}", d, rng.choice(titles), None) for i in range(9) for d in range(rng.randrange(1, 4))]
    rng.shuffle(rows)  # later deliveries may come first
    folder = str(tmp_path / "in")
    for k in range(3):
        written(spark, rows[k::3], PRESS, folder)
    log, ledger = ingest.ChangeLog(spark, str(tmp_path / "log"), SIGNALS), ingest.ChangeLog(spark, str(tmp_path / "ledger"), ingest.LEDGER)
    for files in (1, 2):
        ingest.classify_stream(ingest.file_stream(spark, folder, PRESS, files), rules.company_statements, log, ledger, str(tmp_path / "ck")).awaitTermination()
    got = {r["raw_event_id"]: (r["status"], r["name_hint"] if r["status"] == "active" else None) for r in log.latest("signal_id").collect()}
    assert got == after(spark, rows)
    assert {r["change"] for r in log.read().collect()} <= {"new", "retracted", "restored", "refreshed"}


def test_a_rule_over_a_stream_broadcasts_nothing_and_judges_each_row_once(spark, tmp_path, monkeypatch):
    plans, judged = [], spark.sparkContext.accumulator(0)

    def rule(rows):
        @F.udf("string")
        def told(title):
            judged.add(1)
            return title

        return rules.company_statements(rows.withColumn("title", told.asNondeterministic()("title")))

    real = ingest.ChangeLog.write
    monkeypatch.setattr(ingest.ChangeLog, "write", lambda self, rows, n: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), real(self, rows, n))[1])
    folder, log = str(tmp_path / "in"), ingest.ChangeLog(spark, str(tmp_path / "log"), SIGNALS)
    ledger = ingest.ChangeLog(spark, str(tmp_path / "ledger"), ingest.LEDGER)
    for d in (1, 2):
        written(spark, [(f"e{i}", d, "Norwind confirms data breach", None) for i in range(50)], PRESS, folder)
        ingest.classify_stream(ingest.file_stream(spark, folder, PRESS), rule, log, ledger, str(tmp_path / "ck")).awaitTermination()
    assert plans and not [p for p in plans if "Broadcast" in p]
    assert judged.value == 100
    assert log.latest("signal_id").count() == 50


def test_a_rule_retracts_restores_and_leaves_the_dismissed(spark, tmp_path):
    folder, log = str(tmp_path / "in"), ingest.ChangeLog(spark, str(tmp_path / "log"), SIGNALS)
    ledger = ingest.ChangeLog(spark, str(tmp_path / "ledger"), ingest.LEDGER)
    dismissed = spark.createDataFrame([("own_incident:b:account",)], "signal_id string")
    changes = []
    for d, title in enumerate(["Norwind confirms data breach", "Norwind", "Norwind confirms data breach", "Sudwind confirms data breach", "Sudwind confirms data breach"]):
        written(spark, [(e, d, title, None) for e in ("a", "b", None)], PRESS, folder)
        ingest.classify_stream(ingest.file_stream(spark, folder, PRESS), rules.company_statements, log, ledger, str(tmp_path / "ck"), dismissed if d else None).awaitTermination()
        changes.append(sorted((r["raw_event_id"], r["change"], r["name_hint"]) for r in log.read().where(F.col("batch") == d).collect()))
    assert changes == [
        [("a", "new", "Norwind"), ("b", "new", "Norwind")],
        [("a", "retracted", "Norwind")],
        [("a", "restored", "Norwind")],
        [("a", "refreshed", "Sudwind")],
        [],
    ]


def test_daily_counts_and_late_rows(spark, tmp_path):
    schema, folder, out = "ts timestamp, event_type string", str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda day, hour=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)
    seen, batches = {}, [
        [(at(0), "a"), (at(0, 23), "a"), (at(3), "b"), (at(3, 1), "b")],
        [(at(0, 5), "a"), (at(1), "b"), (at(2), "a"), (None, "a")],  # the first is late: its day ended two days before the latest time; the next isn't
        [],
        [(at(9), "a"), (at(1, 3), "b")],
        [(at(1, 4), "b"), (at(8), "c")],
    ]
    mark = None
    for k, rows in enumerate(batches):
        written(spark, rows, schema, folder)
        ingest.count_stream(lambda: ingest.file_stream(spark, folder, schema, 1), out)
        for ts, kind in rows:
            if ts is not None:
                day = ts.replace(hour=0)
                late = mark is not None and day + datetime.timedelta(days=1) <= mark
                counts = seen.setdefault((day, kind), [0, 0])
                counts[late] += 1
        tops = [t for r in batches[: k + 1] for t, _ in r if t]
        mark = max(tops) - datetime.timedelta(days=2)
        closed = {d: tuple(n) for d, n in seen.items() if d[0] + datetime.timedelta(days=1) <= mark}
        got = {(r["day"], r["event_type"]): (r["n"], r["late"]) for r in ingest.counted(spark, out).collect()}
        assert got == closed
