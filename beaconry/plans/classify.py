"""Classification and derivation over orders as filings and lines as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_of
from ..operators import classify, derive
from ..session import table
from . import roles
from .roles import SIGNALS, values


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = F.array_compact(F.array(F.when(k % 5 == 0, "1.05"), F.when(k % 3 == 0, "5.02")))
    return o.select(F.concat(F.lit("r"), k).alias("raw_event_id"), F.when(k % 11 != 0, F.col("o_custkey")).alias("entity_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), F.when(k % 2 == 0, "8-K").otherwise("").alias("form"), items.alias("items"), k.alias("seq"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.incident_filings(_filings(spark, sf_dir))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = spark.createDataFrame([("own_incident", ["account", "parent"]), ("peer_incident", ["sector"])], "trigger_id string, scopes array<string>")
    return classify.admitted(_candidates(spark, sf_dir), triggers, roles.entities(spark, sf_dir).where("entity_id % 7 <> 0"))


def c03_incident_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and peer candidates of filings with the incident item."""
    return _candidates(spark, sf_dir).select("raw_event_id", "trigger_id", "entity_id", "confidence")


def c15_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the reason they are dropped for."""
    return _admitted(spark, sf_dir).groupBy("trigger_id", F.coalesce("dropped", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))


def c16_c17_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids of admitted candidates with their evidence rows."""
    kept = classify.identified(_admitted(spark, sf_dir).where("dropped is null"))
    return classify.evidence_rows(kept, 1, "v1").select("signal_id", "n", "text")


def c18_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18, on text made of its own source, so always true; `c18_next_turn` guards real next turns."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("authored"))
    rows = c.join(nxt, ["conv_id", "turn"])
    head = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 3), F.lit("Reported"), F.substring("authored", 1, 0))
    return rows.select("conv_id", "turn", (F.size(classify.novel_tokens(head, F.col("text"), ["reported"])) == 0).alias("own_words"))


def c18_next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation's next turn uses no word that the turn before hasn't, both texts whole."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("authored"))
    new = classify.novel_tokens(F.col("authored"), F.col("text"), ["reported"])
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", (F.size(new) == 0).alias("own_words"), F.size(new).cast("bigint").alias("new_words"))


def c20_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: statuses after a run over half of the events."""
    s = roles.signals(spark, sf_dir).withColumn("status", F.when(F.col("seq") % 13 == 0, "dismissed").when(F.col("seq") % 8 == 0, "retracted").otherwise(F.col("status")))
    out = classify.reconciled(s.select("signal_id", "raw_event_id", "status"), s.where("seq % 2 = 0").select("raw_event_id"), s.where("seq % 4 = 0").select("signal_id"))
    return out.select("signal_id", "status")


def c21_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that this classifier version hasn't seen."""
    rows = _filings(spark, sf_dir)
    ledger = rows.select("raw_event_id", F.when(F.col("seq") % 3 == 0, "incident").otherwise("other").alias("classifier"), F.when(F.col("seq") % 2 == 0, "1.1").otherwise("1.0").alias("version"))
    return classify.unprocessed(rows, ledger, "incident", "1.1").select("raw_event_id")


OBLIGATIONS = [("ob1", "subsector_in:BUILDING;MACHINERY|exclude_entities:5;6"), ("ob2", "subsector_in:HOUSEHOLD"), ("ob3", "everyone"), ("ob4", "subsector_in:"), ("ob5", "subsector_in:FURNITURE;FURNITURE|exclude_entities:")]


def j29_l05_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29, and of L05 only this: which obligations apply to which account; malformed rules apply to none."""
    return derive.applicable(spark.createDataFrame(OBLIGATIONS, "obligation_id string, applicability_rule string"), roles.entities(spark, sf_dir))


def l09_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L09 in part: plays of signals by trigger that aren't stored yet, without suppression, caution text or pinned facts."""
    plays = spark.createDataFrame([("1-URGENT", "monitor", "who watches?"), ("1-URGENT", "segment", "what is apart?"), ("5-LOW", "brief", "what changed?")], "trigger_id string, family string, question string")
    signals = roles.signals(spark, sf_dir)
    stored = signals.where("seq % 4 = 0").select(F.concat_ws(":", "signal_id", F.lit("monitor")).alias("snapshot_id"))
    return derive.snapshots(signals, plays, stored).select("snapshot_id", "outreach")


def l11_stale_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: those not verified within 180 days."""
    facts = roles.signals(spark, sf_dir).select(F.col("signal_id").alias("fact_id"), F.col("event_date").alias("verified_date"))
    return derive.stale_facts(facts, roles.NOW).select("fact_id", F.col("age").cast("bigint").alias("age"), "facts")


def j39_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each part is cited by the orders' lists of lines."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("fact_ids"))
    cited, orphans = derive.citations(lists, table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("fact_id")))
    return cited.withColumn("known", F.lit(True)).unionByName(orphans.withColumn("known", F.lit(False)))


QUERIES = {f.__name__: f for f in (c03_incident_candidates, c15_admission, c16_c17_signals, c18_next_turn, c20_reconcile, c21_unprocessed, j29_l05_obligations, l09_snapshots, l11_stale_facts, j39_citations)}

_CAND = """f AS (SELECT *, 'r' || o_orderkey AS raw_event_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS e, CASE WHEN o_orderkey % 2 = 0 THEN '8-K' ELSE '' END AS form FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT raw_event_id, 'own_incident' AS trigger_id, e AS entity_id, 0.9e0 AS confidence, form FROM f UNION ALL SELECT raw_event_id, 'peer_incident', NULL, 0.8e0, form FROM f),
a AS (SELECT *, CASE WHEN trigger_id = 'own_incident' AND entity_id IS NULL THEN 'no_entity' WHEN trigger_id = 'own_incident' AND entity_id % 7 = 0 THEN 'inactive_entity' ELSE 'admitted' END AS outcome FROM c)"""

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'), lambda x: length(x) >= 3)"

ORACLES = {
    "c03_incident_candidates": f"WITH {_CAND} SELECT raw_event_id, trigger_id, entity_id, confidence FROM c",
    "c15_admission": f"WITH {_CAND} SELECT trigger_id, outcome, count(*) AS n FROM a GROUP BY ALL",
    "c16_c17_signals": f"WITH {_CAND} SELECT trigger_id || ':' || raw_event_id || ':' || coalesce(CAST(entity_id AS VARCHAR), 'sector') AS signal_id, 0 AS n, 'Item 1.05 in ' || form AS text FROM a WHERE outcome = 'admitted'",
    "c18_next_turn": f"""WITH t AS (SELECT a.conv_id, a.turn, {_TOKENS.format("b.text")} AS m, list_append({_TOKENS.format("a.text")}, 'reported') AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
d AS (SELECT *, list_filter(m, lambda x, i: list_position(m, x) = i) AS d FROM t)
SELECT conv_id, turn, new_words = 0 AS own_words, new_words FROM (SELECT conv_id, turn, len(list_filter(d, lambda x: NOT list_contains(s, x) AND NOT (x = d[-1] AND len(list_filter(s, lambda k: starts_with(k, x))) > 0))) AS new_words FROM d)""",
    "c20_reconcile": f"""WITH {SIGNALS}, s AS (SELECT *, CASE WHEN seq % 13 = 0 THEN 'dismissed' WHEN seq % 8 = 0 THEN 'retracted' ELSE status END AS st FROM signals)
SELECT signal_id, CASE WHEN st = 'retracted' AND seq % 4 = 0 THEN 'active' WHEN seq % 2 = 0 AND seq % 4 <> 0 AND st NOT IN ('dismissed', 'retracted') THEN 'retracted' ELSE st END AS status FROM s""",
    "c21_unprocessed": "SELECT 'r' || o_orderkey AS raw_event_id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)",
    "j29_l05_obligations": f"""WITH {roles.ENTITIES}, o (obligation_id, subsector) AS ({values([("ob1", "BUILDING"), ("ob1", "MACHINERY"), ("ob2", "HOUSEHOLD"), ("ob5", "FURNITURE")])})
SELECT entity_id, obligation_id FROM entities JOIN o USING (subsector) WHERE NOT (obligation_id = 'ob1' AND entity_id IN (5, 6))""",
    "l09_snapshots": f"""WITH {SIGNALS}, p (trigger_id, family, question) AS ({values([("1-URGENT", "monitor", "who watches?"), ("1-URGENT", "segment", "what is apart?"), ("5-LOW", "brief", "what changed?")])})
SELECT signal_id || ':' || family AS snapshot_id, CASE WHEN tier = 'unconfirmed_early_warning' THEN NULL WHEN signal_scope IN ('account', 'parent') THEN 'Ask: ' || question ELSE 'Brief: ' || question END AS outreach
FROM signals JOIN p USING (trigger_id) WHERE NOT (family = 'monitor' AND seq % 4 = 0)""",
    "l11_stale_facts": f"""WITH {SIGNALS}, a AS (SELECT signal_id AS fact_id, date_diff('day', try_cast(event_date AS DATE), {roles.NOW_SQL}) AS age, count(*) OVER () AS facts FROM signals)
SELECT fact_id, age, facts FROM a WHERE age IS NULL OR age > 180""",
    "j39_citations": """WITH c AS (SELECT l_partkey AS fact_id, count(DISTINCT l_orderkey) AS cited FROM lineitem GROUP BY 1)
SELECT p_partkey AS fact_id, coalesce(cited, 0) AS cited, true AS known FROM part LEFT JOIN c ON p_partkey = fact_id WHERE p_partkey % 10 <> 0
UNION ALL SELECT fact_id, cited, false FROM c WHERE fact_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)""",
}
