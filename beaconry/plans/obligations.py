"""Obligations from regulatory cards of orders; leaks, security press and page changes; texts refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, obligations, page_changes, rules
from ..session import checkpointed, table
from ..sources import normalize
from . import roles
from . import rules as cards
from .classify import OBLIGATIONS
from .roles import SIGNALS, values


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = cards._documents(spark, sf_dir).withColumnRenamed("native_id", "raw_event_id")
    found = classify.identified(rules.regulatory_documents(docs))
    k = F.substring("raw_event_id", 2, 20).cast("bigint")
    return docs, found.select("signal_id", "raw_event_id", "trigger_id", F.when(k % 13 == 0, "retracted").otherwise("active").alias("status"), F.lit(None).cast("string").alias("source_url"), k.alias("k"))


def _considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _signals(spark, sf_dir)
    found = checkpointed(found)  # read twice, and the rules on documents are dear
    old = found.where("k % 10 = 0").select(F.concat(F.lit("obligation:"), "signal_id").alias("obligation_id"))
    return obligations.considered(found, docs, old)


def l01_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New obligations with their products: nations by the standard of their region."""
    n = table(spark, sf_dir, "nation")
    products = n.select(F.format_string("CIP-%03d", "n_regionkey").alias("standard"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("product"))
    return obligations.derived(_considered(spark, sf_dir), products).drop("source_url")


def l01_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signals gave a new obligation, had one, or have no clock."""
    return _considered(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def l04_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored obligations, some with an old rule, some of unknown signals, derived anew."""
    _, found = _signals(spark, sf_dir)
    rule = F.when(F.col("k") % 2 == 0, "subsector_in:old").when(F.col("trigger_id") == "tsa_security_directive", obligations.CLASSES["tsa_security_directive"].rule)
    scope = F.lit(obligations.CLASSES["tsa_security_directive"].affected_scope)
    stored = found.select(F.concat(F.lit("o"), "signal_id").alias("obligation_id"), F.when(F.col("k") % 5 != 0, F.col("signal_id")).alias("signal_id"), rule.alias("applicability_rule"), scope.alias("affected_scope"))
    return obligations.rederived(stored, found).select("obligation_id", "applicability_rule", "affected_scope", "outcome")


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = [(o, r, f"200{i}-0{i + 1}-15" if i else "soon", "p1;p2" if i % 2 == 0 else None) for i, (o, r) in enumerate(OBLIGATIONS)]
    stored = spark.createDataFrame(rows, "obligation_id string, applicability_rule string, effective_date string, mapped_products string")
    return obligations.account_calendar(stored, roles.entities(spark, sf_dir), spark.createDataFrame([("p1", "One")], "product string, name string"), roles.NOW)


def l05_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's obligations, whether they are in effect, and their products by name."""
    return _calendar(spark, sf_dir)[0]


def l05_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can't be read, rules that leave the account out, and all, per account."""
    return _calendar(spark, sf_dir)[1]


def _resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards._orders(spark, sf_dir, {"status": "CASE k % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'none' ELSE 'review' END", "entity_id": "CASE WHEN k % 3 = 0 THEN o_custkey END", "confidence": "CASE k % 4 WHEN 0 THEN 0.4D ELSE 1D END"})


def c05_leak_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as victim listings with and without crew, date and industry."""
    rows = cards._orders(spark, sf_dir, {"crew": "CASE WHEN k % 2 = 0 THEN 'crew' || (k % 6) END", "victim": "CASE WHEN k % 11 <> 0 THEN 'Customer ' || o_custkey ELSE ' ' END", "industry": "CASE WHEN k % 5 < 3 THEN 'Energy & Utilities' ELSE 'Retail' END"})
    return cards._told(rules.leak_listings(rows, _resolutions(spark, sf_dir)), "entity_id", "headline", "tier")


PRESS = """CASE k % 5 WHEN 0 THEN 'Customer ' || o_custkey || ' hit by ransomware' WHEN 1 THEN 'Gang claims to have hacked a utility' WHEN 2 THEN '1234 suffers data breach'
 WHEN 3 THEN 'Customer ' || o_custkey || ' disclosed a data breach; data for sale' ELSE 'New malware found' END"""


def c06_c07_press(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosures and claims in the security press, of two sources."""
    press = cards._orders(spark, sf_dir, {"title": PRESS, "source": "CASE k % 7 WHEN 0 THEN 'the_record' ELSE 'bleepingcomputer' END"})
    return cards._told(rules.press_incidents(rules.press_disclosures(press), _resolutions(spark, sf_dir)), "entity_id", "headline", "tier")


def c10_page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are and with a standard named in their midst; a third hasn't changed, a fifth is new."""
    pages = normalize.page_snapshots(table(spark, sf_dir, "pages").where("url is not null")).join(table(spark, sf_dir, "pages").select("url", "page_id"), "url")
    words, n = F.split("text", " "), F.col("page_id")
    half = F.floor(F.size(words) / 2).cast("int")
    put = F.array(F.lit("see"), F.format_string("CIP-%03d", n % 14), F.lit("now"))
    new = F.array_join(F.concat(F.slice(words, F.lit(1), half), put, F.slice(words, half + 1, F.size(words))), " ")
    rows = pages.select("url", F.lit("2024-02-01").alias("event_date"), F.when(n % 3 == 0, F.col("text")).otherwise(new).alias("text"), F.when(n % 5 != 0, F.col("text")).alias("prev"))
    return page_changes.standard_changes(rows)


def c19_refreshed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of signals taken from a newer version where it says nothing new."""
    s = roles.signals(spark, sf_dir)
    stored = s.select("signal_id", F.when(F.col("seq") % 2 == 0, "1.1").otherwise("1.0").alias("version"), F.when(F.col("seq") % 13 == 0, "dismissed").otherwise(F.col("status")).alias("status"), "headline")
    head = F.concat(F.lit("Reported: "), "headline", F.when(F.col("seq") % 3 == 0, " breached plant").otherwise(""))
    new = s.where("seq % 5 <> 0").select("signal_id", head.alias("headline"), F.col("headline").alias("source"))
    return classify.texts_refreshed(stored, new, "1.1", ["reported"])


QUERIES = {f.__name__: f for f in (
    l01_obligations, l01_outcomes, l04_rederived, l05_calendar, l05_counts, c05_leak_listings, c06_c07_press, c10_page_changes, c19_refreshed_texts,
)}

_TSA, _CIP = obligations.CLASSES["tsa_security_directive"], obligations.CLASSES["nerc_cip_revision"]
_SEEN = f"""WITH s AS (SELECT *, trigger_id || ':' || raw_event_id || ':' || scope AS signal_id, CAST(substr(raw_event_id, 2) AS BIGINT) AS k FROM ({cards.ORACLES["c08_regulatory"]})),
b AS (SELECT * FROM s WHERE k % 13 <> 0 AND trigger_id <> 'nerc_enforcement'), e AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'existing' WHEN scope = 'sector' THEN 'new' ELSE 'skipped_no_clock' END AS outcome FROM b)"""
_FOUND = "(SELECT *, o_orderkey AS k, 'r' || o_orderkey AS raw_event_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 4 WHEN 0 THEN 0.4e0 ELSE 1e0 END AS sure FROM orders)"
_RULES = values([("ob1", "BUILDING"), ("ob1", "MACHINERY"), ("ob2", "HOUSEHOLD"), ("ob5", "FURNITURE")])
_WHEN = values([("ob1", "soon", False, "One;p2"), ("ob2", "2001-02-15", True, None), ("ob5", "2004-05-15", False, "One;p2")])

ORACLES = {
    "l01_obligations": f"""{_SEEN}, t AS (SELECT o_orderkey AS k, {cards.REGULATED['title'].replace('k %', 'o_orderkey %').replace('|| k', '|| o_orderkey').replace('(k', '(o_orderkey')} AS title FROM orders),
p AS (SELECT n_regionkey AS r, string_agg(n_name, ';' ORDER BY n_nationkey) AS products FROM nation GROUP BY 1)
SELECT 'obligation:' || signal_id AS obligation_id, signal_id, CASE trigger_id WHEN 'nerc_cip_revision' THEN 'FERC' ELSE 'TSA' END AS regulator, trim(title) AS rule_name, '2002-01-01' AS effective_date,
 CASE trigger_id WHEN 'nerc_cip_revision' THEN '{_CIP.affected_scope}' ELSE '{_TSA.affected_scope}' END AS affected_scope, CASE trigger_id WHEN 'nerc_cip_revision' THEN '{_CIP.rule}' ELSE '{_TSA.rule}' END AS applicability_rule,
 products AS mapped_products FROM e JOIN t USING (k) LEFT JOIN p ON k % 6 = 0 AND r = k % 9 WHERE outcome = 'new'""",
    "l01_outcomes": f"{_SEEN} SELECT outcome, count(*) AS n FROM e GROUP BY 1",
    "l04_rederived": f"""{_SEEN}, o AS (SELECT DISTINCT ON (signal_id) signal_id, trigger_id, k, k % 5 <> 0 AND trigger_id <> 'nerc_enforcement' AS known, CASE WHEN k % 2 = 0 THEN 'subsector_in:old' WHEN trigger_id = 'tsa_security_directive' THEN '{_TSA.rule}' END AS rule FROM s)
SELECT 'o' || signal_id AS obligation_id, CASE WHEN NOT known THEN rule WHEN trigger_id = 'nerc_cip_revision' THEN '{_CIP.rule}' ELSE '{_TSA.rule}' END AS applicability_rule,
 CASE WHEN known AND trigger_id = 'nerc_cip_revision' THEN '{_CIP.affected_scope}' ELSE '{_TSA.affected_scope}' END AS affected_scope,
 CASE WHEN NOT known THEN 'skipped' WHEN trigger_id = 'tsa_security_directive' AND k % 2 = 1 THEN 'unchanged' ELSE 'rederived' END AS outcome FROM o""",
    "l05_calendar": f"""WITH {roles.ENTITIES}, o (obligation_id, subsector) AS ({_RULES}), w (obligation_id, effective_date, in_effect, product_names) AS ({_WHEN})
SELECT entity_id, obligation_id, effective_date, in_effect, product_names FROM entities JOIN o USING (subsector) JOIN w USING (obligation_id) WHERE NOT (obligation_id = 'ob1' AND entity_id IN (5, 6))""",
    "l05_counts": f"""WITH {roles.ENTITIES} SELECT entity_id, CAST(entity_id IN (5, 6) AND subsector IN ('BUILDING', 'MACHINERY') AS BIGINT) AS excluded, 2 AS unscoped, 5 AS total FROM entities""",
    "c05_leak_listings": f"""WITH c AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'the crew' || (k % 6) || ' ransomware leak site' ELSE 'a ransomware leak site' END AS site, 'Customer ' || o_custkey AS v FROM {_FOUND} WHERE k % 11 <> 0)
SELECT raw_event_id, 'own_incident' AS trigger_id, CAST(o_custkey AS VARCHAR) AS entity_id, 'Listed on ' || site || ' - unverified early warning' AS headline, 'unconfirmed_early_warning' AS tier, least(0.5e0, sure) AS confidence,
 'ransomware.live lists "' || v || '" as a victim on ' || site || ', discovered ' || day || '.' AS evidence, 'victim' AS locators FROM c WHERE k % 3 = 0
UNION ALL SELECT raw_event_id, 'peer_incident', NULL, 'Sector peer ' || v || ' listed on a ransomware leak site - unverified early warning', 'unconfirmed_early_warning', 0.45e0,
 'ransomware.live lists "' || v || '" on a ransomware leak site, discovered ' || day || '. Unverified: no company, regulator, or SEC confirmation.', 'victim' FROM c WHERE k % 3 = 1 AND k % 5 < 3""",
    "c06_c07_press": f"""WITH c AS (SELECT *, 'Customer ' || o_custkey AS v, {PRESS} AS title FROM {_FOUND})
SELECT raw_event_id, 'own_incident' AS trigger_id, CAST(o_custkey AS VARCHAR) AS entity_id, title AS headline, 'corroborated' AS tier, least(0.7e0, sure) AS confidence, title AS evidence, 'title' AS locators FROM c WHERE k % 5 IN (0, 3) AND k % 3 = 0
UNION ALL SELECT raw_event_id, 'peer_incident', NULL, 'Possible sector peer: ' || v || ' disclosed a cybersecurity incident - security-press reported', 'corroborated', 0.6e0,
 'Security-press reporting indicates ' || v || ' disclosed a cybersecurity incident. Industry match is unverified.', 'source' FROM c WHERE k % 5 IN (0, 3) AND k % 3 = 1
UNION ALL SELECT raw_event_id, 'peer_incident', NULL, 'Possible sector peer named in an unverified breach claim - early warning', 'unconfirmed_early_warning', 0.45e0,
 'Security-press reporting references an unverified attacker or leak-site breach claim against an organization.', 'source' FROM c WHERE k % 5 = 1 AND k % 7 <> 0""",
    "c19_refreshed_texts": f"""WITH {SIGNALS}, s AS (SELECT *, seq % 2 = 1 AND seq % 13 <> 0 AND seq % 5 <> 0 AND seq % 3 <> 0 AS go FROM signals)
SELECT signal_id, CASE WHEN go OR seq % 2 = 0 THEN '1.1' ELSE '1.0' END AS version, CASE WHEN seq % 13 = 0 THEN 'dismissed' ELSE status END AS status, CASE WHEN go THEN 'Reported: ' || headline ELSE headline END AS headline FROM s""",
}
