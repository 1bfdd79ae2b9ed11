"""Queries over details that other plans show in part: RSS items, relevance, breakdowns, whole evidence of cases, addresses of vulnerabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, enrich, measure, resolve, rules, scoring
from ..session import table
from ..sources import normalize
from . import roles
from .roles import SCORED

CUTOFF = "1999-08-02"


def s04_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns as RSS items: some without a guid, some with zones, two-digit years or dates that can't be read."""
    k = F.col("conv_id") * 7 + F.col("turn")
    day = F.expr("timestamp '1998-01-01 22:30:00' + make_interval(0, 0, 0, cast((conv_id * 7 + turn) % 2000 as int))")
    date = F.when(k % 11 == 0, "not a date").when(k % 5 == 0, F.date_format(day, "dd MMM yy HH:mm:ss '-0400'")).otherwise(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
    link = F.format_string(" https://press/%d/%d ", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("title"), link.alias("link"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.format_string("g-%d-%d", "conv_id", "turn")).alias("guid"), date.alias("pub_date"))
    return normalize.rss_items(rows, CUTOFF)


def s07_cve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as vulnerabilities with the addresses of their detail pages."""
    one = F.struct(F.format_string("CVE-%d-%d", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_partkey") % 6 != 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("published"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(one.alias("cve"))).alias("vulnerabilities"))
    return normalize.cves(pages.select(F.to_json(F.struct("vulnerabilities")).alias("payload")), "https://cves.example/")


def c09_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents, and which with their language's word for it added, are about pipelines or liquefied gas."""
    word = F.when(F.col("lang") == "en", " A Pipeline.").when(F.col("lang") == "de", " Liquefied  natural gas").when(F.col("lang") == "fr", " LNG").otherwise(" liquefied natural Gas")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", classify.is_pipeline_relevant(F.col("text")).alias("own"), classify.is_pipeline_relevant(F.concat("text", word)).alias("added"))


def a25_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as regulators' papers by source: agency, topic and term together; malformed, undated and earlier ones counted apart."""
    k = F.col("doc_id")
    agencies = F.when(k % 4 == 0, F.array(F.lit("Energy"), F.lit("Transportation Security ADMINISTRATION"))).when(k % 4 == 1, F.array(F.lit("The Transportation Security Administration"))).otherwise(F.array(F.lit("Transportation")))
    title = F.when(k % 3 == 0, "Pipeline matters").when(k % 3 == 1, "Rail").otherwise("LNG Security Directive")
    action = F.when(k % 5 < 3, "Cybersecurity; rule")
    whole = F.to_json(F.struct(agencies.alias("agency_names"), title.alias("title"), F.col("text").alias("abstract"), action.alias("action")))
    payload = F.when(k % 17 == 0, F.concat(F.lit("{not json "), "lang")).when(k % 13 == 0, "[1]").when(k % 19 == 0, "").otherwise(whole)
    day = F.when(k % 7 == 0, "soon").when(k % 9 != 0, F.expr("cast(date_add(date '1999-01-01', cast(doc_id % 600 as int)) as string)"))
    return measure.relevance(table(spark, sf_dir, "documents").select("source", payload.alias("payload"), day.alias("event_date")), "source", CUTOFF)


def p23_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that explains each signal's score and the ceiling of its decay bar; every ninth has a combo, every fiftieth no score."""
    rows = scoring.scored(roles.signals(spark, sf_dir), roles.triggers(spark), roles.entities(spark, sf_dir), roles.WEIGHTS, roles.NOW)
    combo = F.when(F.col("seq") % 9 == 0, 1.25)
    rows = rows.withColumns({"score_combo": combo, "score": F.when(F.col("seq") % 50 != 0, F.col("score") * F.coalesce(combo, F.lit(1.0)))})
    return scoring.score_breakdown(rows).select("signal_id", "breakdown", F.round("ceiling", 6).alias("ceiling"))


def c14_whole_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: cases with their violation category, cited regulations and explained severity as evidence."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    kind = "CASE k % 4 WHEN 0 THEN 'Corrective Action Order' WHEN 1 THEN ' Notice of Probable Violation ' WHEN 2 THEN 'Warning Letter' ELSE 'Other' END"
    cases = o.selectExpr(
        "concat('r', k) AS raw_event_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS event_date", "k AS case_id", f"{kind} AS case_type", "concat('Customer ', o_custkey) AS operator", "CASE WHEN k % 2 = 0 THEN '1/2/01' END AS opened",
        "CASE k % 3 WHEN 0 THEN 'Integrity' WHEN 1 THEN ' ' END AS violation_category", "CASE WHEN k % 5 = 0 THEN concat('49 CFR ', k % 100) END AS cited_regulations",
    )
    found = o.selectExpr("concat('r', k) AS raw_event_id", "'matched' AS status", "o_custkey AS entity_id", "0.9D AS confidence")
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_mktsegment") == "BUILDING", "lng").otherwise("other").alias("subsector"), F.lit(None).cast("bigint").alias("parent_id"))
    tops = resolve.rolled_up(entities, entities.select(F.col("entity_id").alias("child"), F.col("entity_id").alias("parent")).limit(0))
    out = rules.pipeline_cases(cases, found, tops, entities, rules.SEVERITIES)
    return out.select("raw_event_id", "entity_id", "confidence", F.array_join("evidence", "|").alias("evidence"))


def _alias_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' order priorities up to 1998 as their aliases, all orders as edits of them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.where("o_orderdate < timestamp '1998-01-01'").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("alias")).distinct()
    rows = rows.withColumn("origin", F.when(F.col("entity_id") % 2 == 0, "seed").otherwise("operator"))
    action = F.when(k % 3 == 0, "remove").when(k % 29 == 0, "edit").otherwise("add")
    value = F.when(k % 19 == 0, " ").when(k % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    edits = o.select(k.alias("seq"), action.alias("action"), F.when(k % 17 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("entity_id"), value.alias("alias"))
    return enrich.listed_edits(rows, edits, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")), "alias")


def e02_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aliases after adds and removals in order."""
    return _alias_edits(spark, sf_dir)[0]


def e02_alias_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each edit of an alias, with the value before and after."""
    return _alias_edits(spark, sf_dir)[1]


def a13_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals on which judge (by the order's status) and human (by the customer's key) disagree, with their cards, newest first."""
    signals = roles.signals(spark, sf_dir)
    judge, human = F.col("seq") % 5 == 0, F.col("seq") % 3 == 0
    judged = signals.select(F.when(F.col("seq") % 50 == 0, "gone").otherwise(F.col("signal_id")).alias("signal_id"), judge.cast("int").alias("judge_negative"), F.when(human, "not_useful").otherwise("useful").alias("verdict"), (judge != human).alias("disagree"))
    events = signals.where("seq % 4 <> 0").select("raw_event_id", F.col("status").alias("source_id"))
    return enrich.disagreement_list(judged, signals, roles.entities(spark, sf_dir), roles.triggers(spark).where("trigger_id <> '5-LOW'"), events)


def j21_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal with its lines as evidence, and plays with the facts (suppliers) that their JSON lists name."""
    signals, li = roles.signals(spark, sf_dir), table(spark, sf_dir, "lineitem")
    key = F.format_string("s%d", "l_orderkey")
    evidence = li.select(key.alias("signal_id"), (F.col("l_linenumber") % 3).alias("rank"), F.col("l_linenumber").alias("n"), F.format_string("r%d", "l_orderkey").alias("raw_event_id"), F.format_string("part %d", "l_partkey").alias("text"), F.col("l_returnflag").alias("locator"), F.lit("1.0").alias("version"))
    per = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.format_string("f%d", "l_suppkey"))).alias("ids"))
    k = F.col("l_orderkey")
    lists = F.when(k % 10 == 3, "[broken").when(k % 10 == 4, "").otherwise(F.to_json(F.array_append("ids", F.lit("lost"))))
    snapshots = per.select(key.alias("signal_id"), F.explode(F.when(k % 4 == 0, F.array(F.lit("p2"), F.lit("p1"))).when(k % 4 == 1, F.array(F.lit("p3"))).when(k % 4 == 2, F.array(F.lit("old")))).alias("play_id"), lists.alias("fact_ids"), F.lit("2001-01-01").alias("made_on"), F.lit("d").alias("display_text"), F.lit("o").alias("outreach_safe_text"))
    candidates = spark.createDataFrame([("p1", "a", "A", "q"), ("p2", "b", "B", None), ("p3", "c", None, "q")], "play_id string, family string, recommended_path string, discovery_question string")
    products = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "family string, name string")
    facts = table(spark, sf_dir, "supplier").select(F.format_string("f%d", "s_suppkey").alias("fact_id"), F.lit("a").alias("family"), F.lit("s").alias("segment"), F.lit("A").alias("source_quality"), F.col("s_name").alias("source_url"), F.col("s_acctbal").alias("price_note"))
    out = enrich.card_details(signals, evidence, snapshots, candidates, products, facts)
    play = F.transform("snapshots", lambda p: F.concat_ws(":", p["play_id"], p["product"], F.array_join(F.transform(p["facts"], lambda f: F.concat_ws("@", f["fact_id"], f["source_url"])), ",")))
    return out.select("signal_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["n"].cast("string"), e["text"], e["locator"])), ";").alias("evidence"), F.array_join(play, ";").alias("plays"))


QUERIES = {f.__name__: f for f in (s04_rss_items, s07_cve_urls, c09_relevance, a25_relevance, p23_breakdowns, c14_whole_evidence, e02_aliases, e02_alias_audit, a13_work_list, j21_cards)}

_TWO = "printf('%.2f', CAST(round(CAST({} AS DECIMAL(18, 9)), 2) AS DOUBLE))"
_SHOWN = "regexp_replace(" + _TWO + r", '\.?0+$', '')"

_ALIASES = """WITH r AS (SELECT DISTINCT o_custkey AS e, o_orderpriority AS v, CASE WHEN o_custkey % 2 = 0 THEN 'seed' ELSE 'operator' END AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
x AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' WHEN o_orderkey % 29 = 0 THEN 'edit' ELSE 'add' END AS action, CASE WHEN o_orderkey % 17 = 0 THEN -o_custkey ELSE o_custkey END AS e,
 CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END AS v, o_orderkey % 29 = 0 AND o_orderkey % 3 <> 0 AS odd FROM orders),
y AS (SELECT x.*, r.origin, CASE WHEN odd THEN NULL WHEN action = 'remove' OR (x.e >= 0 AND x.v <> '') THEN action END AS does FROM x LEFT JOIN r ON x.e = r.e AND x.v = r.v),
z AS (SELECT *, last_value(does IGNORE NULLS) OVER (PARTITION BY e, v ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y),
t AS (SELECT *, origin IS NOT NULL AND origin = 'seed' OR CASE WHEN before IS NOT NULL THEN before = 'add' ELSE origin IS NOT NULL END AS there FROM z),
a AS (SELECT *, CASE action WHEN 'add' THEN CASE WHEN e < 0 THEN 'unknown_entity' WHEN v = '' THEN 'blank' WHEN there THEN 'exists' ELSE 'added' END
  WHEN 'remove' THEN CASE WHEN NOT there THEN 'unknown' WHEN origin = 'seed' THEN 'not_operator' ELSE 'removed' END ELSE 'bad_action' END AS outcome FROM t)"""

ORACLES = {
    "a13_work_list": f"""WITH {roles.SIGNALS}, {roles.ENTITIES}, {roles.TRIGGER_ROWS},
j AS (SELECT CASE WHEN seq % 50 = 0 THEN 'gone' ELSE signal_id END AS signal_id, CAST(seq % 5 = 0 AS INTEGER) AS judge_negative, CASE WHEN seq % 3 = 0 THEN 'not_useful' ELSE 'useful' END AS verdict FROM signals WHERE (seq % 5 = 0) <> (seq % 3 = 0))
SELECT j.*, headline, event_date, signal_scope, status, s.entity_id, e.name AS entity_name, CASE WHEN s.trigger_id <> '5-LOW' THEN t.name END AS trigger_name, CASE WHEN s.seq % 4 <> 0 THEN status END AS source_id
FROM j LEFT JOIN signals s USING (signal_id) LEFT JOIN entities e ON e.entity_id = s.entity_id LEFT JOIN triggers t ON t.trigger_id = s.trigger_id""",
    "j21_cards": f"""WITH {roles.SIGNALS}, e AS (SELECT l_orderkey AS k, string_agg(l_linenumber || '/part ' || l_partkey || '/' || l_returnflag, ';' ORDER BY l_linenumber % 3, l_linenumber, 'part ' || l_partkey, l_returnflag) AS evidence FROM lineitem GROUP BY 1),
f AS (SELECT k, string_agg('f' || s_suppkey || '@' || s_name, ',' ORDER BY 'f' || s_suppkey) AS facts FROM (SELECT DISTINCT l_orderkey AS k, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey WHERE k % 10 NOT IN (3, 4) GROUP BY k),
x AS (SELECT signal_id, coalesce(evidence, '') AS evidence, CASE WHEN e.k IS NULL THEN NULL ELSE coalesce(facts, '') END AS facts, seq FROM signals LEFT JOIN e ON e.k = seq LEFT JOIN f ON f.k = seq)
SELECT signal_id, evidence, CASE WHEN facts IS NULL OR seq % 4 >= 2 THEN '' WHEN seq % 4 = 1 THEN 'p3:c:' || facts ELSE 'p1:Alpha:' || facts || ';p2:Beta:' || facts END AS plays FROM x""",
    "e02_alias_audit": f"{_ALIASES} SELECT seq, action, e AS entity_id, outcome, CASE WHEN outcome = 'removed' THEN v END AS old_value, CASE WHEN outcome = 'added' THEN v END AS new_value FROM a",
    "e02_aliases": f"""{_ALIASES}, l AS (SELECT e, v, arg_max(outcome, seq) AS last FROM a WHERE outcome IN ('added', 'removed') GROUP BY e, v)
SELECT coalesce(r.e, l.e) AS entity_id, coalesce(r.v, l.v) AS alias, CASE WHEN last IS NULL THEN origin ELSE 'operator' END AS origin FROM r FULL JOIN l ON r.e = l.e AND r.v = l.v WHERE last IS NULL OR last = 'added'""",
    "s04_rss_items": f"""WITH c AS (SELECT *, conv_id * 7 + turn AS k, TIMESTAMP '1998-01-01 22:30:00' + to_days(CAST((conv_id * 7 + turn) % 2000 AS INTEGER)) AS t FROM conversations),
d AS (SELECT *, CASE WHEN k % 11 = 0 THEN '' ELSE strftime(CASE WHEN k % 5 = 0 THEN t + INTERVAL 4 HOUR ELSE t END, '%Y-%m-%d') END AS event_date, 'https://press/' || conv_id || '/' || turn AS link FROM c)
SELECT CASE WHEN k % 3 = 1 THEN 'g-' || conv_id || '-' || turn ELSE link END AS native_id, event_date, text AS title, ' ' || link || ' ' AS url FROM d WHERE event_date = '' OR event_date >= '{CUTOFF}'""",
    "s07_cve_urls": """SELECT 'CVE-' || l_orderkey || '-' || l_linenumber AS native_id, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS event_date,
 'https://cves.example/CVE-' || l_orderkey || '-' || l_linenumber AS url FROM lineitem""",
    "c09_relevance": "SELECT doc_id, regexp_matches(lower(text), 'pipeline|lng|liquefied natural gas') AS own, regexp_matches(lower(text), 'pipeline|lng|liquefied natural gas') OR lang <> 'de' AS added FROM documents",
    "a25_relevance": f"""WITH d AS (SELECT *, doc_id AS k, lower(CASE doc_id % 3 WHEN 0 THEN 'Pipeline matters' WHEN 1 THEN 'Rail' ELSE 'LNG Security Directive' END || ' ' || coalesce(text, '') || CASE WHEN doc_id % 5 < 3 THEN ' Cybersecurity; rule' ELSE '' END) AS t,
 CASE WHEN doc_id % 7 = 0 THEN 'soon' WHEN doc_id % 9 <> 0 THEN strftime(DATE '1999-01-01' + CAST(doc_id % 600 AS INTEGER), '%Y-%m-%d') END AS day FROM documents),
r AS (SELECT *, k % 17 = 0 OR k % 13 = 0 AS bad, k % 17 <> 0 AND k % 13 <> 0 AND k % 19 <> 0 AND k % 4 < 2 AND regexp_matches(t, 'pipeline|lng|liquefied natural gas')
   AND regexp_matches(t, 'security directive|cybersecurity|cyber security|security program|security measures|security requirements') AS rel, coalesce(day <> 'soon', false) AS dated FROM d),
n AS (SELECT source, count(*) AS total, count(*) FILTER (bad) AS malformed, count(*) FILTER (rel AND NOT dated) AS undated_matches, count(*) FILTER (rel AND dated AND day < '{CUTOFF}') AS out_of_window_matches,
 count(*) FILTER (rel AND dated AND day >= '{CUTOFF}') AS match_count FROM r GROUP BY source)
SELECT *, CASE WHEN match_count > 0 THEN 'reuse' WHEN out_of_window_matches > 0 THEN 'widen' ELSE 'none' END AS recommendation FROM n""",
    "p23_breakdowns": f"""WITH {SCORED}, x AS (SELECT *, CASE WHEN seq % 9 = 0 THEN 1.25e0 END AS combo, CASE WHEN seq % 50 <> 0 THEN score_base * score_decay * score_account_fit * score_scope_fit * CASE WHEN seq % 9 = 0 THEN 1.25e0 ELSE 1e0 END END AS s FROM scored)
SELECT signal_id, CASE WHEN s IS NOT NULL THEN 'score ' || {_SHOWN.format("s")} || ' = ' || {_SHOWN.format("score_base")} || ' × ' || {_TWO.format("score_decay")} || ' × ' || {_TWO.format("score_account_fit")} || ' × ' || {_TWO.format("score_scope_fit")}
 || CASE WHEN combo IS NULL THEN ' · no combo applied' ELSE ' × ' || {_TWO.format("combo")} END END AS breakdown,
 round(CASE WHEN score_base * score_account_fit * score_scope_fit > 0 THEN score_base * score_account_fit * score_scope_fit * coalesce(combo, 1e0) END, 6) AS ceiling FROM x""",
    "c14_whole_evidence": """WITH c AS (SELECT o_orderkey AS k, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'Corrective Action Order' WHEN 1 THEN 'Notice of Probable Violation' WHEN 2 THEN 'Warning Letter' END AS t FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
SELECT 'r' || k AS raw_event_id, CAST(o_custkey AS VARCHAR) AS entity_id, CASE k % 4 WHEN 0 THEN 0.85e0 WHEN 1 THEN 0.8e0 ELSE 0.7e0 END AS confidence,
 'CPF ' || k || ': ' || t || ' against Customer ' || o_custkey || CASE WHEN k % 3 = 0 THEN '|Violation category: Integrity' ELSE '' END || CASE WHEN k % 5 = 0 THEN '|Cited regulations: 49 CFR ' || k % 100 ELSE '' END
 || CASE WHEN k % 2 = 0 THEN '|Opened 1/2/01' ELSE '' END || CASE k % 4 WHEN 0 THEN '|""" + rules.SEVERITIES["Corrective Action Order"].replace("'", "''") + """' WHEN 1 THEN '|""" + rules.SEVERITIES["Notice of Probable Violation"].replace("'", "''") + """' ELSE '|""" + rules.SEVERITIES["Warning Letter"].replace("'", "''") + """' END AS evidence FROM c WHERE t IS NOT NULL""",
}
