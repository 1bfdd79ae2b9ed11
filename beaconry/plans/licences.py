"""Licence facts and candidates, identifier chains, run books, fact tables and audited edits.

Orders stand for the rows of the price matrix and for runs, customers for entities and configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, enrich, licences
from ..session import table
from . import roles
from .roles import SIGNALS, TRIGGER_ROWS

QUESTION = "Would %s with %s close a gap?"
_CELLS = [None, "Yes, since 2020", "no", "No (planned)", "  ", "nobody knows", " NO(yet) "]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("sku"), k % 40).alias("product_id"),
        F.concat(F.lit("t"), k).alias("tier"),
        F.when(k % 2 == 0, "included").otherwise("addon").alias("included_or_addon"),
        F.concat("o_orderpriority", F.lit(" price")).alias("addon_price_note"),
        F.element_at(F.array(*map(F.lit, _CELLS)), (k % 7 + 1).cast("int")).alias("gcc_high"),
        F.lit("A").alias("source_quality"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("verified_date"),
        F.lit("https://prices.example").alias("source_url"),
    )


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    families = spark.range(40).select(F.concat(F.lit("sku"), i).alias("sku"), F.when(i % 10 != 0, F.concat(F.lit("fam"), i % 8)).alias("family"))
    tiers = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("t"), "o_orderkey").alias("tier"), F.lit("base suite").alias("prerequisite"))
    return licences.facts(_matrix(spark, sf_dir), families, tiers)


def l06_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix rows to commercial and government facts."""
    return _facts(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as stored: some edited, some of skus that are gone, some of operators."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where(k % 5 < 3)
    sku = F.concat(F.lit("sku"), k % 40, F.lit(":t"), k)
    same = F.lit("edited").alias
    return orders.select(
        F.when(k % 5 == 0, F.concat(sku, F.lit(":commercial"))).when(k % 5 == 1, F.concat(F.lit("gone"), k)).otherwise(F.concat(F.lit("own"), k)).alias("fact_id"),
        F.lit("old").alias("product_id"),
        F.when(k % 5 < 2, F.lit("old:plan")).alias("sku_or_plan"),
        F.lit("old").alias("segment"),
        *(same(c) for c in licences.EDITABLE),
    )


def l07_refreshed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts after a rebuild; every third of those gone is cited."""
    cited = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("gone"), "o_orderkey").alias("fact_id"))
    return licences.refreshed_facts(_stored(spark, sf_dir), _facts(spark, sf_dir), cited)


def l08_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by priority and nation of each customer's orders, with old ones that snapshots still need."""
    customer = table(spark, sf_dir, "customer")
    pairs = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("trigger_id"), F.concat(F.lit("n"), "c_nationkey").alias("product_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("product_id"), F.concat(F.lit("path "), "n_regionkey").alias("recommended_path"), F.col("n_name").alias("name"))
    old = customer.select(F.concat(F.lit("old:"), "c_custkey").alias("play_id"), F.lit("old").alias("trigger_id"), F.col("c_custkey").cast("string").alias("product_id"), F.lit("p").alias("recommended_path"), F.lit("q").alias("discovery_question"))
    snapshots = table(spark, sf_dir, "orders").select(F.concat(F.lit("old:"), "o_custkey").alias("play_id"))
    return licences.refreshed_candidates(old, pairs, n.drop("name"), n.drop("recommended_path"), snapshots, QUESTION)


def l08_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that snapshots cite and no fact has, with how often: each order cites its own commercial fact and a lost one."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("sku"), k % 40, F.lit(":t"), k, F.lit(":commercial"))
    snapshots = table(spark, sf_dir, "orders").select(F.array(own, F.concat(F.lit("lost"), k % 100)).alias("fact_ids"))
    return derive.citations(snapshots, _facts(spark, sf_dir))[1]


def j13_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' identifiers through registries by name, cik and lei; each registry repeats keys."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    entities = c.select(k.alias("entity_id"), F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("cik"), F.when(k % 7 == 0, F.concat(F.lit("L"), k)).alias("lei"))
    ciks = c.where(k % 3 == 1).select(k.alias("entity_id"), k.cast("string").alias("cik"))
    twice = c.select("c_custkey", F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    by_cik = twice.where(k % 4 < 2).select(F.lpad(k.cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Q"), k, F.lit("."), "seq").alias("qid"), F.when(k % 4 == 0, F.concat(F.lit("W"), k)).otherwise("").alias("lei"), "seq")
    leis = c.where(k % 5 < 2).select(k.alias("entity_id"), F.concat(F.lit("G"), k).alias("lei"))
    by_lei = twice.where(k % 5 == 0).select(F.concat(F.lit("G"), k).alias("lei"), F.concat(F.lit("X"), k, F.lit("."), "seq").alias("qid"), "seq")
    return enrich.enriched(entities, ciks, by_cik, leis, by_lei)


def c22_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of classifiers over raw events, done again by half."""
    s = roles.signals(spark, sf_dir)
    rows = lambda df, day: df.select("raw_event_id", F.col("trigger_id").alias("classifier_id"), F.lit("1.0").alias("parser_version"), F.lit(day).alias("processed_at"), (F.col("seq") % 3).alias("signals_emitted"))
    again = rows(s.where("seq % 2 = 0"), "2001-02-02").withColumn("signals_emitted", F.col("signals_emitted") + 10)
    return enrich.booked(rows(s.where("seq % 3 > 0"), "2001-01-01"), again, ["raw_event_id", "classifier_id", "parser_version"], "processed_at")


def a21_fact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on signals, some unknown, with all dimensions; some raw events are unknown."""
    s = roles.signals(spark, sf_dir)
    verdicts = s.select(F.when(F.col("seq") % 10 > 0, F.col("signal_id")).otherwise("none").alias("signal_id"), F.col("seq").alias("ts"), F.when(F.col("seq") % 2 == 0, "up").otherwise("down").alias("verdict"))
    events = s.where("seq % 4 > 0").select("raw_event_id", F.col("status").alias("source_id"))
    return enrich.with_dimensions(verdicts, s, roles.triggers(spark).where("trigger_id <> '5-LOW'"), events)


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.where(k % 4 > 0).select(k.alias("entity_id"), F.concat(F.lit("edited "), "c_name").alias("name"), F.when(k % 2 == 0, "operator").otherwise("seed").alias("origin"))
    seed = c.where(k % 6 != 1).select(k.alias("entity_id"), F.col("c_name").alias("name"))
    edits = c.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), k.alias("entity_id"), F.lit("added").alias("name")).select(
        (F.col("entity_id") * 2 + F.col("i")).alias("seq"), F.when(F.col("entity_id") % 5 < 2, "add").when(F.col("entity_id") % 5 < 4, "remove").otherwise("reset").alias("action"), "entity_id", "name"
    )
    references = table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("entity_id"))
    return enrich.edited(rows, seed, edits, references, "entity_id", ["name"])


def e02_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchlist after adds, removals and resets."""
    return _edits(spark, sf_dir)[0]


def e02_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each edit."""
    return _edits(spark, sf_dir)[1]


QUERIES = {
    q.__name__: q
    for q in (l06_facts, l07_refreshed_facts, l08_candidates, l08_orphans, j13_identifiers, c22_books, a21_fact_tables, e02_edited, e02_audit)
}

_FACTS = """m AS (SELECT o_orderkey AS k, 'sku' || (o_orderkey % 40) || ':t' || o_orderkey AS sku_or_plan, CASE WHEN o_orderkey % 40 % 10 <> 0 THEN 'fam' || (o_orderkey % 40 % 8) END AS product_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'included' ELSE 'addon' END AS included_or_addon, CASE WHEN o_orderkey % 3 = 0 THEN 'base suite' ELSE '' END AS prerequisite, strftime(o_orderdate, '%Y-%m-%d') AS verified_date, o_orderpriority || ' price' AS price,
  CASE o_orderkey % 7 WHEN 1 THEN 'available — Yes, since 2020' WHEN 2 THEN 'not available — no' WHEN 3 THEN 'not available — No (planned)' WHEN 5 THEN 'needs_curation — nobody knows' WHEN 6 THEN 'not available — NO(yet)' END AS gov FROM orders),
f AS (SELECT sku_or_plan || ':' || segment AS fact_id, product_id, sku_or_plan, segment, price_note, included_or_addon, prerequisite, '' AS effective_date, verified_date, 'A' AS source_quality, 'https://prices.example' AS source_url
  FROM (SELECT *, 'commercial' AS segment, price AS price_note FROM m UNION ALL SELECT *, 'gcc_high', gov FROM m WHERE gov IS NOT NULL))"""
_OLD = ", ".join(f"'edited' AS {c}" for c in licences.EDITABLE)
_FROZEN = ", ".join(f"CASE WHEN s.fact_id IS NOT NULL THEN s.{c} ELSE f.{c} END AS {c}" for c in licences.EDITABLE)
_EDITS = """WITH r AS (SELECT c_custkey AS entity_id, c_name, c_custkey % 4 > 0 AS known, c_custkey % 2 = 0 AS own, c_custkey % 6 <> 1 AS seeded, c_custkey % 5 AS a,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0) AS used FROM customer),
j AS (SELECT *, CASE WHEN a < 2 THEN CASE WHEN known THEN 'exists' ELSE 'added' END WHEN NOT known THEN 'unknown'
  WHEN a < 4 THEN CASE WHEN NOT own THEN 'not_operator' WHEN used THEN 'referenced' ELSE 'removed' END WHEN seeded THEN 'reset' ELSE 'not_seed' END AS outcome FROM r)"""

ORACLES = {
    "l06_facts": f"WITH {_FACTS} SELECT * FROM f",
    "l07_refreshed_facts": f"""WITH {_FACTS}, s AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'sku' || (o_orderkey % 40) || ':t' || o_orderkey || ':commercial' WHEN 1 THEN 'gone' || o_orderkey ELSE 'own' || o_orderkey END AS fact_id,
  'old' AS product_id, CASE WHEN o_orderkey % 5 < 2 THEN 'old:plan' END AS sku_or_plan, 'old' AS segment, {_OLD} FROM orders WHERE o_orderkey % 5 IN (0, 2) OR o_orderkey % 5 = 1 AND o_orderkey % 3 = 0)
SELECT coalesce(f.fact_id, s.fact_id) AS fact_id, CASE WHEN f.fact_id IS NULL THEN s.product_id ELSE f.product_id END AS product_id, CASE WHEN f.fact_id IS NULL THEN s.sku_or_plan ELSE f.sku_or_plan END AS sku_or_plan,
 CASE WHEN f.fact_id IS NULL THEN s.segment ELSE f.segment END AS segment, {_FROZEN} FROM f FULL JOIN s ON f.fact_id = s.fact_id""",
    "l08_candidates": """SELECT DISTINCT o_orderpriority || ':n' || n_nationkey AS play_id, o_orderpriority AS trigger_id, 'n' || n_nationkey AS product_id, 'path ' || n_regionkey AS recommended_path,
 'Would path ' || n_regionkey || ' with ' || n_name || ' close a gap?' AS discovery_question, false AS stale FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'old:' || c_custkey, 'old', CAST(c_custkey AS VARCHAR), 'p', 'q', true FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "l08_orphans": "SELECT 'lost' || (o_orderkey % 100) AS fact_id, count(*) AS cited FROM orders GROUP BY 1",
    "j13_identifiers": """WITH e AS (SELECT c_custkey AS k, c_custkey % 3 = 1 AS named, c_custkey % 3 < 2 AND c_custkey % 4 < 2 AS hit, c_custkey % 3 < 2 AND c_custkey % 4 = 0 AS hit_lei FROM customer),
g AS (SELECT *, k % 7 <> 0 AND NOT hit_lei AND k % 5 < 2 AS by_name FROM e), x AS (SELECT *, by_name AND NOT hit AND k % 5 = 0 AS late FROM g)
SELECT k AS entity_id, CASE WHEN named THEN CAST(k AS VARCHAR) ELSE '' END AS cik, CASE WHEN hit_lei THEN 'W' || k WHEN by_name THEN 'G' || k ELSE '' END AS lei, CASE WHEN late THEN 'X' || k || '.1' WHEN hit THEN 'Q' || k || '.1' ELSE '' END AS wikidata_qid,
 concat_ws('+', CASE WHEN named THEN 'sec_cik_lookup' END, CASE WHEN hit THEN 'wikidata_cik' END, CASE WHEN by_name THEN 'gleif_exact_name' END, CASE WHEN late THEN 'wikidata_lei' END) AS method FROM x WHERE named OR hit OR by_name""",
    "c22_books": f"""WITH {SIGNALS} SELECT raw_event_id, trigger_id AS classifier_id, '1.0' AS parser_version, CASE WHEN seq % 2 = 0 THEN '2001-02-02' ELSE '2001-01-01' END AS processed_at,
 CASE WHEN seq % 2 = 0 THEN seq % 3 + 10 ELSE seq % 3 END AS signals_emitted FROM signals WHERE seq % 2 = 0 OR seq % 3 > 0""",
    "a21_fact_tables": f"""WITH {SIGNALS}, {TRIGGER_ROWS} SELECT signal_id, seq AS ts, CASE WHEN seq % 2 = 0 THEN 'up' ELSE 'down' END AS verdict, trigger_id, signal_scope, tier, entity_id, CASE WHEN trigger_id <> '5-LOW' THEN name END AS trigger_name,
 CASE WHEN seq % 4 > 0 THEN status END AS source_id FROM signals JOIN triggers USING (trigger_id) WHERE seq % 10 > 0""",
    "e02_edited": f"""{_EDITS} SELECT entity_id, CASE WHEN NOT known THEN 'added' WHEN outcome = 'reset' THEN c_name ELSE 'edited ' || c_name END AS name, CASE WHEN NOT known OR own THEN 'operator' ELSE 'seed' END AS origin
 FROM j WHERE known AND outcome <> 'removed' OR outcome = 'added'""",
    "e02_audit": f"""{_EDITS} SELECT 2 * entity_id + i AS seq, CASE WHEN a < 2 THEN 'add' WHEN a < 4 THEN 'remove' ELSE 'reset' END AS action, entity_id, CASE WHEN outcome = 'added' AND i = 1 THEN 'exists' ELSE outcome END AS outcome FROM j, (VALUES (0), (1)) AS t (i)""",
}
