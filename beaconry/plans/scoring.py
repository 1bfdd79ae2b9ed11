"""Scores, combinations and status changes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..operators import scoring as ops
from . import roles
from .roles import NOW, NOW_SQL, SCORED, SIGNALS, values

FACTORS = ["score_base", "score_decay", "score_account_fit", "score_scope_fit"]


def _scored(spark: SparkSession, sf_dir: str, combos: DataFrame | None = None) -> DataFrame:
    return ops.scored(roles.signals(spark, sf_dir), roles.triggers(spark), roles.entities(spark, sf_dir), roles.WEIGHTS, NOW, combos)


def k01_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age in days of every signal."""
    return roles.signals(spark, sf_dir).select("signal_id", age_days(F.col("event_date"), NOW).cast("bigint").alias("age"))


def k04_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal's score and its factors."""
    return _scored(spark, sf_dir).select("signal_id", *(F.round(c, 6).alias(c) for c in [*FACTORS, "score"]))


def k04_w02_scored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02 on K04: the 100 best active account cards, by score, date and id."""
    rows = _scored(spark, sf_dir).where("status = 'active' and signal_scope in ('account', 'parent')")
    best = rows.orderBy(F.desc_nulls_last(F.round("score", 6)), F.desc("event_date"), F.desc("signal_id")).limit(100)
    return best.select("signal_id", "entity_id", "trigger_id", "event_date", F.round("score", 6).alias("score"))


def k05_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by status after a rescoring pass."""
    out = ops.rescored(roles.signals(spark, sf_dir), roles.triggers(spark), roles.entities(spark, sf_dir), roles.WEIGHTS, NOW)
    return out.select("signal_id", "status", F.round("score", 6).alias("score"))


def k06_config_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token over nations and regions as configuration lines."""
    nations = roles.table(spark, sf_dir, "nation").select(F.concat_ws("|", F.lit("nation"), F.col("n_nationkey").cast("string"), "n_name"))
    regions = roles.table(spark, sf_dir, "region").select(F.concat_ws("|", F.lit("region"), F.col("r_regionkey").cast("string"), "r_name"))
    return ops.config_token(nations, regions)


RULES = [
    ("urgent_obliged", "trigger_any:1-URGENT,2-HIGH AND obligation:any", "1.5"),
    ("low_quiet", "trigger_any:5-LOW AND not_keyword:order of 1,order of 2", "1.25"),
    ("two_triggers", "trigger_any:5-LOW AND trigger_any:2-HIGH", "2"),
    ("keyword_first", "not_keyword:x AND trigger_any:5-LOW", "2"),
    ("bad_factor", "trigger_any:5-LOW", "-1"),
    ("no_number", "trigger_any:5-LOW", "many"),
    ("unknown_clause", "sector_is:power", "1.1"),
]
OBLIGED = ["BUILDING", "MACHINERY"]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, logic_expr string, multiplier string")


def _read_rules(spark: SparkSession) -> list[dict]:
    """The sound rules, as combo_multipliers() takes them; configuration of a few rows."""
    out = []
    for r in ops.rule_clauses(_rules(spark)).orderBy("rule_id").collect():
        terms = lambda kind, r=r: [t for c in r["c"] if c["kind"] == kind for t in c["terms"]]
        out.append({"rule_id": r["rule_id"], "multiplier": r["multiplier"], "triggers": terms("trigger_any"), "needs_obligation": bool(terms("obligation")), "absent": terms("not_keyword")})
    return out


def k10_combo_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's product of the multipliers of the rules that fire."""
    signals = roles.signals(spark, sf_dir).withColumn("text", F.regexp_replace("headline", r"(order of \d)\d*", "$1"))
    obliged = roles.entities(spark, sf_dir).where(F.col("subsector").isin(OBLIGED)).select("entity_id")
    return ops.combo_multipliers(signals, obliged, _read_rules(spark)).select("entity_id", F.round("multiplier", 6).alias("multiplier"))


def k10_combo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04 with combinations: scores of active signals whose entity has a fired rule."""
    rows = _scored(spark, sf_dir, k10_combo_multipliers(spark, sf_dir)).where("status = 'active' and score_combo is not null")
    return rows.select("signal_id", F.round("score", 6).alias("score"), "score_combo")


def k11_sound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that read right, with how many signals each one's triggers meet."""
    sound = ops.rule_clauses(_rules(spark)).select("rule_id", F.explode(F.flatten(F.transform(F.filter("c", lambda c: c["kind"] == "trigger_any"), lambda c: c["terms"]))).alias("trigger_id"))
    # Signals are counted by trigger first: joined as they are, all of a trigger would be sorted in one task.
    met = roles.signals(spark, sf_dir).groupBy("trigger_id").agg(F.count("*").alias("n"))
    return sound.join(met, "trigger_id").groupBy("rule_id").agg(F.sum("n").alias("signals"))


def j28_k12_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after later finals that share a docket have superseded proposals."""
    signals = roles.signals(spark, sf_dir)
    key = F.col("seq")
    kinds = signals.select("signal_id", F.when(key % 3 == 0, "Rule").otherwise("Proposed Rule").alias("kind"), F.array(F.format_string("RM%d-%d-000", key % 50, key % 7), F.format_string("RM%d-1-000", key % 211)).alias("dockets"))
    return ops.superseded(signals, kinds).select("signal_id", "status")


def k13_retier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of a batch of tier edits, one for every signal."""
    signals = roles.signals(spark, sf_dir)
    key = F.col("seq")
    new = F.element_at(F.array(*map(F.lit, ("confirmed", "corroborated", "unconfirmed_early_warning", "rumour"))), (key % 4 + 1).cast("int"))
    edits = signals.select("signal_id", new.alias("new_tier"), F.when(key % 5 != 0, "seen").otherwise("").alias("reason"), key.alias("ts"))
    state, trail = ops.retiered(signals, edits, roles.TIERS)
    applied = state.groupBy(F.coalesce("tier", F.lit("none")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("state").alias("part"), "key", "n")
    return applied.unionByName(trail.groupBy(F.col("outcome").alias("key")).agg(F.count("*").alias("n")).select(F.lit("trail").alias("part"), "key", "n"))


def k15_live_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight keys that an active signal consults."""
    rows = roles.signals(spark, sf_dir).where("status = 'active'").join(roles.entities(spark, sf_dir), "entity_id", "left")
    calendar, named = F.col("signal_scope") == "regulatory_calendar", F.col("entity_id").isNotNull()
    own = [k for kind, k in roles.WEIGHTS if kind == "applicability" and k != "default"]
    knobs = F.array_compact(
        F.array(
            F.when(named, F.concat(F.lit("subsector:"), "subsector")),
            F.when(named & ~calendar, F.concat(F.lit("richness:"), "richness")),
            F.when(named, F.concat(F.lit("coverage:"), "coverage_flag")),
            F.when(calendar, F.when(named & F.col("subsector").isin(own), F.concat(F.lit("applicability:"), "subsector")).otherwise("applicability:default")),
            F.concat(F.lit("scope:"), "signal_scope"),
            F.concat(F.lit("trigger:"), "trigger_id"),
        )
    )
    return rows.select(F.explode(knobs).alias("knob")).groupBy("knob").agg(F.count("*").alias("signals"))


QUERIES = {f.__name__: f for f in (k01_age, k04_factors, k04_w02_scored_feed, k05_rescore, k06_config_token, k10_combo_multipliers, k10_combo_scores, k11_sound_rules, j28_k12_supersede, k13_retier, k15_live_knobs)}

_SCORE = "score_base * score_decay * score_account_fit * score_scope_fit"
_COMBOS = """per AS (SELECT s.entity_id,
  max((trigger_id IN ('1-URGENT', '2-HIGH'))::INT) AS hit0, max((trigger_id = '5-LOW')::INT) AS hit1,
  min(CASE WHEN trigger_id = '5-LOW' THEN (NOT regexp_matches(headline, 'order of [12]'))::INT ELSE 1 END) AS clear1,
  max((subsector IN ('BUILDING', 'MACHINERY'))::INT) AS obliged
 FROM signals s LEFT JOIN entities e ON e.entity_id = s.entity_id WHERE status = 'active' AND s.entity_id IS NOT NULL GROUP BY s.entity_id),
combos AS (SELECT entity_id, round(CASE WHEN hit0 = 1 AND obliged = 1 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN hit1 = 1 AND clear1 = 1 THEN 1.25 ELSE 1.0 END, 6) AS multiplier
 FROM per WHERE (hit0 = 1 AND obliged = 1) OR (hit1 = 1 AND clear1 = 1))"""

ORACLES = {
    "k01_age": f"WITH {SIGNALS} SELECT signal_id, CAST(greatest(coalesce(date_diff('day', try_cast(event_date AS DATE), {NOW_SQL}), 0), 0) AS BIGINT) AS age FROM signals",
    "k04_factors": f"WITH {SCORED} SELECT signal_id, {', '.join(f'round({c}, 6) AS {c}' for c in FACTORS)}, round({_SCORE}, 6) AS score FROM scored",
    "k04_w02_scored_feed": f"""WITH {SCORED} SELECT signal_id, entity_id, trigger_id, event_date, round({_SCORE}, 6) AS score FROM scored
WHERE status = 'active' AND signal_scope IN ('account', 'parent') ORDER BY score DESC NULLS LAST, event_date DESC, signal_id DESC LIMIT 100""",
    "k05_rescore": f"""WITH {SCORED} SELECT signal_id, CASE WHEN status = 'active' AND {_SCORE} >= 1.0 THEN 'active' ELSE 'decayed' END AS status,
CASE WHEN status = 'active' THEN round({_SCORE}, 6) END AS score FROM scored""",
    "k06_config_token": """SELECT substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS token FROM (
SELECT 'nation|' || n_nationkey || '|' || n_name AS line FROM nation UNION ALL SELECT 'region|' || r_regionkey || '|' || r_name FROM region)""",
    "k10_combo_multipliers": f"WITH {SIGNALS}, {roles.ENTITIES}, {_COMBOS} SELECT entity_id, multiplier FROM combos",
    "k10_combo_scores": f"""WITH {SCORED}, {_COMBOS} SELECT signal_id, round({_SCORE} * multiplier, 6) AS score, multiplier AS score_combo
FROM scored JOIN combos USING (entity_id) WHERE status = 'active'""",
    "k11_sound_rules": f"""WITH {SIGNALS}, sound (rule_id, trigger_id) AS ({values([("urgent_obliged", "1-URGENT"), ("urgent_obliged", "2-HIGH"), ("low_quiet", "5-LOW")])})
SELECT rule_id, count(*) AS signals FROM signals JOIN sound USING (trigger_id) GROUP BY rule_id""",
    "j28_k12_supersede": f"""WITH {SIGNALS}, d AS (SELECT signal_id, trigger_id, event_date, status, CASE WHEN seq % 3 = 0 THEN 'Rule' ELSE 'Proposed Rule' END AS kind,
  unnest(['RM' || seq % 50 || '-' || seq % 7 || '-000', 'RM' || seq % 211 || '-1-000']) AS docket FROM signals),
f AS (SELECT trigger_id, docket, max(event_date) AS last FROM d WHERE kind = 'Rule' GROUP BY ALL),
gone AS (SELECT DISTINCT signal_id FROM d JOIN f USING (trigger_id, docket) WHERE kind = 'Proposed Rule' AND status = 'active' AND last > event_date)
SELECT signal_id, CASE WHEN signal_id IN (SELECT signal_id FROM gone) THEN 'superseded' ELSE status END AS status FROM signals""",
    "k13_retier": f"""WITH {SIGNALS}, e AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'corroborated' WHEN 2 THEN 'unconfirmed_early_warning' ELSE 'rumour' END AS new FROM signals),
o AS (SELECT *, CASE WHEN new = 'rumour' THEN 'unknown tier' WHEN tier IS NULL THEN 'not an incident' WHEN tier = new THEN 'no change'
  WHEN tier = 'unconfirmed_early_warning' AND seq % 5 = 0 THEN 'reason needed' ELSE 'applied' END AS outcome FROM e)
SELECT 'trail' AS part, outcome AS key, count(*) AS n FROM o GROUP BY outcome
UNION ALL SELECT 'state', coalesce(CASE WHEN outcome = 'applied' THEN new ELSE tier END, 'none') AS key, count(*) FROM o GROUP BY 2""",
    "k15_live_knobs": f"""WITH {SIGNALS}, {roles.ENTITIES}, k AS (SELECT unnest([
  CASE WHEN s.entity_id IS NOT NULL THEN 'subsector:' || subsector END,
  CASE WHEN s.entity_id IS NOT NULL AND signal_scope <> 'regulatory_calendar' THEN 'richness:' || richness END,
  CASE WHEN s.entity_id IS NOT NULL THEN 'coverage:' || coverage_flag END,
  CASE WHEN signal_scope = 'regulatory_calendar' THEN CASE WHEN subsector = 'BUILDING' THEN 'applicability:BUILDING' ELSE 'applicability:default' END END,
  'scope:' || signal_scope, 'trigger:' || trigger_id]) AS knob
 FROM signals s LEFT JOIN entities e ON e.entity_id = s.entity_id WHERE status = 'active')
SELECT knob, count(*) AS signals FROM k WHERE knob IS NOT NULL GROUP BY knob""",
}
