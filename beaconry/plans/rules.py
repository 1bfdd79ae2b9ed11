"""Rules on orders dressed as press titles, filings, regulators' documents, cases and awards; feeds of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve, rules
from ..session import table
from ..sources import normalize

CUTOFF = "1998-01-01"


def _orders(spark: SparkSession, sf_dir: str, columns: dict[str, str], *own: str) -> DataFrame:
    """Orders as raw_event_id and event_date with the SQL expressions in `columns`, which name the key k."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    return o.select(F.expr("'r' || k").alias("raw_event_id"), F.expr("date_format(o_orderdate, 'yyyy-MM-dd')").alias("event_date"), *own, *(F.expr(e).alias(n) for n, e in columns.items()))


def _told(found: DataFrame, *columns: str) -> DataFrame:
    return found.select("raw_event_id", "trigger_id", *columns, "confidence", F.array_join("evidence", " / ").alias("evidence"), F.array_join("locators", ",").alias("locators"))


TITLE = """CASE k % 8 WHEN 0 THEN 'Customer ' || o_custkey || ' appoints Jane Roe as CISO' WHEN 1 THEN 'Customer ' || o_custkey || ' names A. Poe Chief Technology Officer'
 WHEN 2 THEN 'Dana Doe joins Customer ' || o_custkey || ' as Chief Information Security Officer' WHEN 3 THEN 'Customer ' || o_custkey || ' promotes B. Moe as CSO'
 WHEN 4 THEN 'Customer ' || o_custkey || ' confirms <b>ransomware</b> attack' WHEN 5 THEN 'Customer ' || o_custkey || ' reports breaches of fiduciary duties'
 WHEN 6 THEN 'Customer ' || o_custkey || ' names a CFO, not as CIO' ELSE 'Customer ' || o_custkey || ' discloses a data breach &amp; recovery' END"""
ABOUT = "CASE k % 3 WHEN 0 THEN 'Leads <i>information</i> security.' WHEN 1 THEN 'Leads strategy.' END"


def c01_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers of security and technology in press titles."""
    return _told(rules.appointments(_orders(spark, sf_dir, {"title": TITLE, "description": ABOUT})), "name_hint", "headline")


def c04_company_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that speak of an incident of their own."""
    return _told(rules.company_statements(_orders(spark, sf_dir, {"title": TITLE})), "name_hint", "headline")


FILED = "CASE k % 4 WHEN 0 THEN 'New CISO' WHEN 1 THEN 'chief technology officer named' WHEN 2 THEN 'New CSO' END"
DOCUMENT_NAME = "CASE k % 5 WHEN 0 THEN 'CIO-' || k || '.htm' ELSE 'd' || k || '.htm' END"


def c02_officer_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with the officer item and a title in their documents' names."""
    form, items = "CASE k % 7 WHEN 0 THEN '10-K' ELSE '8-K' END", "CASE k % 3 WHEN 0 THEN array('5.02', '9.01') ELSE array('9.01') END"
    filings = _orders(spark, sf_dir, {"form": form, "items": items, "entity_id": "CASE WHEN k % 11 <> 0 THEN o_custkey END", "doc_description": FILED, "primary_document": DOCUMENT_NAME})
    return _told(rules.officer_filings(filings), "entity_id", "headline")


REGULATED = {
    "title": "CASE k % 6 WHEN 0 THEN 'Reliability Standard CIP-00' || (k % 9) || ' revisions' WHEN 1 THEN 'Acme ' || k || ' Corp.; Notice of Penalty' WHEN 2 THEN 'Pipeline Security Directive ' || k WHEN 3 THEN ' ' WHEN 4 THEN 'Rail security rules' ELSE 'CIP violations, reliability standard ' || k || ' on operators of the bulk electric system and whoever else it may concern, in the second and much longer version of this text' END",
    "abstract": "CASE k % 5 WHEN 0 THEN 'Owners must comply. The reliability standard covers CIP assets! A civil penalty follows.' WHEN 2 THEN 'Rail security for LNG plants. Cybersecurity Requirements apply to all. Comments are welcome.' WHEN 3 THEN 'A settlement of critical infrastructure protection matters.' WHEN 4 THEN '' END",
    "type": "CASE CAST(floor(k / 6) AS BIGINT) % 4 WHEN 0 THEN 'Rule' WHEN 1 THEN 'Proposed Rule' WHEN 2 THEN 'Notice' ELSE '' END",
    "effective_on": "CASE WHEN CAST(floor(k / 24) AS BIGINT) % 2 = 0 THEN '2002-01-01' END",
    "comments_close_on": "CASE WHEN CAST(floor(k / 48) AS BIGINT) % 2 = 0 THEN '2001-12-01' END",
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents in pages of one customer and day."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    agencies = "CASE WHEN k % 7 < 3 THEN array(named_struct('slug', 'federal-energy-regulatory-commission', 'name', 'FERC')) WHEN k % 7 < 6 THEN array(named_struct('slug', 'transportation-security-administration', 'name', 'TSA')) ELSE array(named_struct('slug', 'transportation-security-administration', 'name', 'TSA'), named_struct('slug', 'federal-energy-regulatory-commission', 'name', 'FERC')) END"
    more = {
        "document_number": "'D' || k", "publication_date": "date_format(o_orderdate, 'yyyy-MM-dd')", "html_url": "'https://d/' || k", "agencies": agencies,
        "docket_ids": "CASE WHEN k % 9 = 0 THEN array(' rm21-3') END", "cfr_references": "CASE WHEN k % 11 = 0 THEN array(named_struct('title', 18, 'part', '40')) END",
    }
    doc = F.struct(*(F.expr(e).alias(n) for n, e in (REGULATED | more).items()))
    pages = o.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.collect_list(doc).alias("results"))
    return normalize.documents(pages.select(F.to_json(F.struct("results")).alias("payload")))


def s03_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document of a page."""
    return _documents(spark, sf_dir).select("native_id", "event_date", "url", F.get_json_object("payload", "$.title").alias("title"))


def c08_regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives, revisions and notices from regulators' documents, up to four cards from one."""
    return _told(rules.regulatory_documents(_documents(spark, sf_dir).withColumnRenamed("native_id", "raw_event_id")), "scope", "name_hint", "headline", "event_date")


def c12_decrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled judicial civil cases."""
    case = "to_json(named_struct('CaseNumber', CAST(k AS STRING), 'CaseName', 'CUSTOMER ' || o_custkey || CASE k % 3 WHEN 0 THEN ' (LEAD (A)), ET AL.' ELSE '' END, 'CaseCategoryCode', CASE k % 4 WHEN 0 THEN 'AFR' ELSE 'JDC' END, 'CivilCriminalIndicator', CASE k % 5 WHEN 0 THEN 'CR' ELSE 'CI' END, 'SettlementDate', CASE WHEN k % 7 <> 0 THEN '1/2/2001' END, 'PrimaryLaw', CASE WHEN k % 2 = 0 THEN 'CAA' END))"
    return _told(rules.settled_decrees(_orders(spark, sf_dir, {"payload": case})), "name_hint", "headline")


AGENCY = "CASE k % 4 WHEN 0 THEN 'Department of ENERGY' WHEN 1 THEN 'Department of Homeland Security' WHEN 2 THEN 'Department of State' ELSE 'Other' END"


def c13_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards of the departments and the office that qualify."""
    award = f"to_json(named_struct('Award ID', 'A' || k, 'Recipient Name', CASE WHEN k % 9 <> 0 THEN 'Customer ' || o_custkey ELSE ' ' END, 'Awarding Agency', {AGENCY}, 'Awarding Sub Agency', CASE WHEN k % 5 = 0 THEN 'The Cybersecurity and Infrastructure Security Agency' END, 'Start Date', '2001-01-01', 'Description', CASE WHEN k % 2 = 0 THEN 'Grid' END))"
    return _told(rules.qualifying_awards(_orders(spark, sf_dir, {"payload": award})), "name_hint", "headline")


def c14_pipeline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: cases of operators whose uppermost account is of the trade; every third customer belongs to the one before."""
    c = table(spark, sf_dir, "customer")
    trade = F.when(F.col("c_mktsegment") == "BUILDING", "midstream").when(F.col("c_mktsegment") == "MACHINERY", "lng").otherwise("other")
    entities = c.select(F.col("c_custkey").alias("entity_id"), trade.alias("subsector"), F.lit(None).cast("bigint").alias("parent_id"))
    edges = c.where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("child"), (F.col("c_custkey") - 1).alias("parent"))
    kind = "CASE k % 5 WHEN 0 THEN 'Corrective Action Order' WHEN 1 THEN ' Notice of Probable Violation ' WHEN 2 THEN 'Warning Letter' ELSE 'Other' END"
    cases = _orders(spark, sf_dir, {"case_id": "k", "case_type": kind, "operator": "CASE WHEN k % 13 <> 0 THEN 'Customer ' || o_custkey END", "opened": "CASE WHEN k % 2 = 0 THEN '1/2/01' END"})
    found = _orders(spark, sf_dir, {"status": "CASE k % 4 WHEN 0 THEN 'review' ELSE 'matched' END", "entity_id": "o_custkey", "confidence": "CASE k % 3 WHEN 0 THEN 0.75D ELSE 1D END"})
    return _told(rules.pipeline_cases(cases, found, resolve.rolled_up(entities, edges), entities), "entity_id", "headline")


DEAL_TITLES = "CASE k % 5 WHEN 0 THEN 'Building  acquires Machinery ; BUILDING rises' WHEN 1 THEN 'Automobile stocks: merger ahead' WHEN 2 THEN 'Furniture deal expires' WHEN 3 THEN 'Household Goods of ' || o_custkey || ' to   buy Rebuilding' END"


def c11_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: deals in titles, one card per term named."""
    terms = ["building", "machinery", "automobile", "furniture", "household", "household goods"]
    return _told(rules.deals(_orders(spark, sf_dir, {"title": DEAL_TITLES}), terms), "name_hint", "headline")


def s10_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages and its hash, whole."""
    return normalize.page_snapshots(table(spark, sf_dir, "pages"))


def s16_listing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings, a third of them keyed by a hash of their sorted JSON."""
    own, day = "CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS STRING) ELSE '' END", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    payload = f"to_json(named_struct('victim', CAST(event_id AS STRING), 'id', {own}, 'group', event_type, 'discovered', CASE WHEN event_id % 2 = 0 THEN {day} ELSE '' END, 'attackdate', {day}, 'activity', 'energy'))"
    return normalize.listings(table(spark, sf_dir, "events").select(F.expr(payload).alias("payload")))


def s02_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search answers of two hits, with padded, wordy and missing company codes."""
    code = "CASE p_partkey % 4 WHEN 0 THEN array('000' || p_partkey) WHEN 1 THEN array('x1') WHEN 2 THEN array() ELSE array(CAST(p_partkey AS STRING), '7') END"
    source = f"named_struct('ciks', {code}, 'adsh', '1-' || p_partkey, 'file_date', CASE WHEN p_partkey % 5 <> 0 THEN '2001-02-03' END)"
    hits = f"to_json(named_struct('hits', named_struct('hits', array(named_struct('_id', '0-' || p_partkey || ':a:b.htm', '_source', {source}), named_struct('_id', '9-' || p_size, '_source', {source})))))"
    return normalize.fulltext_hits(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("matched_name"), F.expr(hits).alias("payload"))).drop("matched_name")


def s05_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as advisories whose links have queries, fragments, closing slashes or no path."""
    link = "CASE k % 5 WHEN 0 THEN 'https://c.gov/ics/icsa-' || k || '?utm=1/2' WHEN 1 THEN 'https://c.gov/ics/icsa-' || k || '/#top' WHEN 2 THEN 'https://c.gov' WHEN 3 THEN ' /ics/icsa-' || k || ' ' END"
    day = "CASE WHEN k % 7 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'E, d MMM yy') || ' 12:00:00 +0000' END"
    items = _orders(spark, sf_dir, {"link": link, "guid": "' g' || k", "pub_date": day, "title": "o_orderpriority"})
    return normalize.advisories(items, CUTOFF).select("native_id", "event_date", "title")


def s07_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as vulnerabilities in a page per order."""
    v = "named_struct('cve', named_struct('id', 'CVE-' || l_orderkey || '-' || l_linenumber, 'published', CASE WHEN l_partkey % 6 <> 0 THEN ' ' || date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\") END))"
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(v)).alias("vulnerabilities"))
    return normalize.cves(per.select(F.to_json(F.struct("vulnerabilities")).alias("payload"))).select("native_id", "event_date")


def s12_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of a calendar month, dated by zone or grid."""
    zones = "CASE k % 4 WHEN 0 THEN array(named_struct('isSelected', false, 'eventStartDate', '1999-01-01T00:00'), named_struct('isSelected', true, 'eventStartDate', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\"))) WHEN 1 THEN array(named_struct('isSelected', true, 'eventStartDate', 'tbd'), named_struct('isSelected', false, 'eventStartDate', '1999-06-07T00:00')) END"
    item = f"named_struct('url', CASE WHEN k % 3 = 0 THEN 'https://o/' || k ELSE ' /e/' || k END, 'day', CASE WHEN k % 4 = 2 THEN CAST(day(o_orderdate) AS STRING) WHEN k % 4 = 3 THEN 'tbd' END, 'dateInfoByTimeZone', {zones})"
    rows = _orders(spark, sf_dir, {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "payload": f"to_json(named_struct('allItems', array({item})))"})
    return normalize.calendar(rows, "https://n.com", CUTOFF)


def s15_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of two awards, one without an agency now and then, scoped to customers of one segment."""
    award = lambda n: f"named_struct('Award ID', '{n}' || k, 'Recipient Name', CASE WHEN k % 9 <> 0 THEN ' CUSTOMER ' || o_custkey ELSE ' ' END, 'Awarding Agency', CASE WHEN k % 4 <> {n} THEN 'DOE' END, 'Start Date', CASE WHEN k % 10 <> 0 THEN '2001-01-01' ELSE '' END)"
    pages = _orders(spark, sf_dir, {"payload": f"to_json(named_struct('results', array({award(1)}, {award(2)})))"})
    terms = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.expr("'Customer ' || c_custkey").alias("term"))
    return normalize.awards(pages, terms).select("native_id", "recipient", "agency", "event_date")


QUERIES = {f.__name__: f for f in (
    c01_appointments, c02_officer_filings, c04_company_statements, c08_regulatory, c11_deals, c12_decrees, c13_awards, c14_pipeline_cases,
    s02_fulltext, s03_documents, s05_advisories, s07_cves, s10_page_texts, s12_calendar, s15_awards, s16_listing_keys,
)}

_RAW = "SELECT *, o_orderkey AS k, 'r' || o_orderkey AS raw_event_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
_CLEAN = "trim(regexp_replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_PRESS = f"t AS (SELECT *, {_CLEAN.format(TITLE)} AS t, coalesce({_CLEAN.format(ABOUT)}, '') AS d FROM ({_RAW}))"
_DOCS = ", ".join(f"{e} AS {n}" for n, e in REGULATED.items())
_SENTENCES = "list_filter(string_split(regexp_replace(trim(abstract), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '' AND regexp_matches(x, '{}'))[1:2]"
_SECURE = "(?i)security directive|pipeline security|rail security|surface transportation security|cybersecurity requirements"


def _evidence_sql(pattern: str) -> str:
    found = _SENTENCES.format(pattern)
    return f"""array_to_string([title] || {found} || list_filter(['Effective on ' || effective_on, 'Comments close on ' || comments_close_on], lambda x: x IS NOT NULL), ' / ') AS evidence,
 array_to_string(['title'] || list_transform({found}, lambda x: 'abstract') || list_filter([CASE WHEN effective_on IS NOT NULL THEN 'effective_on' END, CASE WHEN comments_close_on IS NOT NULL THEN 'comments_close_on' END], lambda x: x IS NOT NULL), ',') AS locators"""


_CUT = "CASE WHEN length({0}) > 140 THEN rtrim(substr({0}, 1, 139)) || '…' ELSE {0} END"
_LABEL = "CASE type WHEN 'Rule' THEN ' final rule: ' ELSE ' proposed rule: ' END"

ORACLES = {
    "c01_appointments": f"""WITH {_PRESS}, c AS (SELECT *, CASE k % 8 WHEN 0 THEN 'CISO' WHEN 1 THEN 'Chief Technology Officer' WHEN 2 THEN 'Chief Information Security Officer' WHEN 6 THEN 'CIO'
  WHEN 3 THEN CASE WHEN contains(lower(d), 'information security') THEN 'CSO' END END AS term FROM t)
SELECT raw_event_id, 'leadership_change' AS trigger_id, 'Customer ' || o_custkey AS name_hint, t AS headline, CASE WHEN term IN ('CIO', 'Chief Technology Officer') THEN 0.75e0 ELSE 0.9e0 END AS confidence,
 t || CASE WHEN term = 'CSO' THEN ' / ' || d ELSE '' END AS evidence, CASE WHEN term = 'CSO' THEN 'title,description' ELSE 'title' END AS locators FROM c WHERE term IS NOT NULL""",
    "c04_company_statements": f"""WITH {_PRESS} SELECT raw_event_id, 'own_incident' AS trigger_id, 'Customer ' || o_custkey AS name_hint, t AS headline, 0.85e0 AS confidence, t AS evidence, 'title' AS locators
FROM t WHERE regexp_matches(t, '(confirms|discloses|reports).*(ransomware|data breach)')""",
    "c02_officer_filings": f"""WITH f AS (SELECT *, {FILED} AS a, {DOCUMENT_NAME} AS b FROM ({_RAW}) WHERE k % 3 = 0 AND k % 7 <> 0 AND k % 11 <> 0),
c AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'CISO' WHEN k % 5 = 0 THEN 'CIO' WHEN k % 4 = 1 THEN 'chief technology officer' END AS term FROM f)
SELECT raw_event_id, 'leadership_change' AS trigger_id, CAST(o_custkey AS VARCHAR) AS entity_id, '8-K Item 5.02 leadership change (' || term || ')' AS headline, CASE WHEN term = 'CISO' THEN 0.9e0 ELSE 0.75e0 END AS confidence,
 concat_ws(' / ', CASE WHEN k % 4 IN (0, 1) THEN a END, CASE WHEN k % 5 = 0 THEN b END) AS evidence, concat_ws(',', CASE WHEN k % 4 IN (0, 1) THEN 'doc_description' END, CASE WHEN k % 5 = 0 THEN 'primary_document' END) AS locators FROM c WHERE term IS NOT NULL""",
    "c08_regulatory": f"""WITH d AS (SELECT * REPLACE (trim(title) AS title, coalesce(abstract, '') AS abstract), trim(title) || ' ' || coalesce(abstract, '') AS whole FROM (SELECT k, day AS event_date, 'D' || k AS raw_event_id, {_DOCS} FROM ({_RAW}))),
a AS (SELECT *, k % 7 < 3 OR k % 7 = 6 AS ferc, k % 7 >= 3 AS tsa, CASE WHEN effective_on IS NULL THEN 'regulatory_calendar' ELSE 'sector' END AS scope FROM d
 WHERE title <> '' AND (effective_on IS NOT NULL OR comments_close_on IS NOT NULL OR contains(abstract, 'must comply'))),
n AS (SELECT *, {_evidence_sql('(?i)enforcement|penalt|violation|settlement')} FROM a WHERE ferc AND type = 'Notice' AND regexp_matches(whole, '(?i)penalt|violation|settlement') AND (regexp_matches(whole, '(?i)critical infrastructure protection|reliability standard') OR regexp_matches(whole, '\\bCIP\\b')))
SELECT raw_event_id, 'tsa_security_directive' AS trigger_id, scope, NULL AS name_hint, {_CUT.format(f"('TSA' || {_LABEL} || title)")} AS headline, event_date, 0.8e0 AS confidence, {_evidence_sql(_SECURE)} FROM a
 WHERE tsa AND type LIKE '%Rule' AND regexp_matches(whole, '{_SECURE}') AND regexp_matches(whole, '(?i)pipeline|lng|liquefied natural gas')
UNION ALL SELECT raw_event_id, 'nerc_cip_revision', scope, NULL, {_CUT.format(f"('FERC' || {_LABEL} || title)")}, event_date, 0.8e0, {_evidence_sql('(?i:critical infrastructure protection|reliability standard)|\\bCIP\\b')} FROM a
 WHERE ferc AND type LIKE '%Rule' AND regexp_matches(whole, '(?i)reliability standard') AND (regexp_matches(whole, '(?i)critical infrastructure protection') OR regexp_matches(whole, 'CIP-[0-9][0-9][0-9]') OR k % 9 = 0 OR k % 11 = 0)
UNION ALL SELECT raw_event_id, 'nerc_enforcement', 'sector', NULL, '{rules.NOTICE_HEADLINE}', event_date, 0.8e0, evidence, locators FROM n
UNION ALL SELECT raw_event_id, 'nerc_enforcement', 'account', 'Acme ' || k || ' Corp.', 'FERC enforcement action names Acme ' || k || ' Corp.', event_date, 0.75e0, evidence, locators FROM n WHERE k % 6 = 1""",
    "c12_decrees": f"""SELECT raw_event_id, 'audit_consent_decree' AS trigger_id, 'CUSTOMER ' || o_custkey AS name_hint, 'EPA judicial civil enforcement settlement (' || CASE WHEN k % 2 = 0 THEN 'CAA' ELSE 'environmental' END || '): CUSTOMER ' || o_custkey AS headline, 0.75e0 AS confidence,
 concat_ws(' / ', 'Case ' || k || ': CUSTOMER ' || o_custkey || CASE WHEN k % 3 = 0 THEN ' (LEAD (A)), ET AL.' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'Primary law: CAA' END, 'Settled 1/2/2001', '{rules.DECREE_NOTE}') AS evidence,
 concat_ws(',', 'case_name', CASE WHEN k % 2 = 0 THEN 'primary_law' END, 'settlement_date,classifier_note') AS locators FROM ({_RAW}) WHERE k % 4 <> 0 AND k % 5 <> 0 AND k % 7 <> 0""",
    "c13_awards": f"""WITH a AS (SELECT *, {AGENCY} AS agency FROM ({_RAW})) SELECT raw_event_id, 'capital_project' AS trigger_id, 'Customer ' || o_custkey AS name_hint, 'USAspending capital-project award (' || agency || '): Customer ' || o_custkey AS headline, 0.75e0 AS confidence,
 'Award A' || k || ': ' || CASE WHEN k % 2 = 0 THEN 'Grid' ELSE '(no description provided)' END || ' / Awarding agency: ' || agency || CASE WHEN k % 5 = 0 THEN ' (The Cybersecurity and Infrastructure Security Agency)' ELSE '' END || ' / Award start date: 2001-01-01' AS evidence,
 'description,awarding_agency,start_date' AS locators FROM a WHERE k % 9 <> 0 AND (k % 4 < 2 OR k % 5 = 0)""",
    "c14_pipeline_cases": f"""WITH t AS (SELECT c.c_custkey AS e, coalesce(p.c_mktsegment, c.c_mktsegment) AS s FROM customer c LEFT JOIN customer p ON c.c_custkey % 3 = 1 AND p.c_custkey = c.c_custkey - 1),
c AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Corrective Action Order' WHEN 1 THEN 'Notice of Probable Violation' ELSE 'Warning Letter' END AS kind FROM ({_RAW}) JOIN t ON e = o_custkey WHERE k % 5 < 3 AND k % 13 <> 0 AND k % 4 <> 0 AND s IN ('BUILDING', 'MACHINERY'))
SELECT raw_event_id, 'pipeline_enforcement_action' AS trigger_id, CAST(e AS VARCHAR) AS entity_id, 'PHMSA ' || kind || ': Customer ' || e AS headline, least(CASE k % 5 WHEN 0 THEN 0.85e0 WHEN 1 THEN 0.8e0 ELSE 0.7e0 END, CASE WHEN k % 3 = 0 THEN 0.75e0 ELSE 1e0 END) AS confidence,
 concat_ws(' / ', 'CPF ' || k || ': ' || kind || ' against Customer ' || e, CASE WHEN k % 2 = 0 THEN 'Opened 1/2/01' END, 'Severity: ' || kind) AS evidence, CASE WHEN k % 2 = 0 THEN 'case,opened_date,severity' ELSE 'case,severity' END AS locators FROM c""",
    "c11_deals": f"""WITH a AS (SELECT *, regexp_replace({DEAL_TITLES}, '\\s+', ' ', 'g') AS t FROM ({_RAW}) WHERE k % 5 IN (0, 3)), h AS (SELECT *, unnest(CASE WHEN k % 5 = 0 THEN ['Building', 'Machinery'] ELSE ['Household Goods'] END) AS term FROM a)
SELECT raw_event_id, 'ma_divestiture' AS trigger_id, term AS name_hint, term || ' in M&A coverage: ' || t AS headline, 0.6e0 AS confidence, t AS evidence, 'title' AS locators FROM h""",
    "s10_page_texts": r"""WITH a AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT url, regexp_replace(h, '<[^>]+>', ' ', 'g') AS h FROM a), t AS (SELECT url, trim(regexp_replace(replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT url, text, sha256(coalesce(url, '') || chr(10) || coalesce(text, '')) AS content_hash FROM t""",
    "s16_listing_keys": """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, CAST(event_id AS VARCHAR) AS v FROM events)
SELECT CASE WHEN event_id % 3 <> 0 THEN v ELSE 'h:' || substr(sha256('{"activity":"energy","attackdate":"' || day || '","discovered":"' || CASE WHEN event_id % 2 = 0 THEN day ELSE '' END || '","group":"' || event_type || '","id":"","victim":"' || v || '"}'), 1, 24) END AS native_id,
 day[:10] AS event_date, event_type AS crew, v AS victim, 'energy' AS industry FROM e""",
    "s02_fulltext": """WITH h AS (SELECT *, unnest(['0-' || p_partkey || ':a:b.htm', '9-' || p_size]) AS id FROM part)
SELECT p_partkey AS entity_id, p_partkey || ':' || id AS native_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '2001-02-03' END AS event_date,
 CASE WHEN p_partkey % 4 IN (0, 3) AND p_partkey > 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || p_partkey || '/' || CASE WHEN starts_with(id, '0') THEN '0' || p_partkey || '/a:b.htm' ELSE '9' || p_size || '/' END ELSE '' END AS url FROM h""",
    "s03_documents": f"SELECT 'D' || k AS native_id, day AS event_date, 'https://d/' || k AS url, {REGULATED['title']} AS title FROM ({_RAW})",
    "s05_advisories": f"""SELECT CASE WHEN k % 5 IN (0, 1, 3) THEN 'icsa-' || k ELSE 'g' || k END AS native_id, CASE WHEN k % 7 = 0 THEN '' ELSE day END AS event_date, o_orderpriority AS title FROM ({_RAW}) WHERE k % 7 = 0 OR day >= '{CUTOFF}'""",
    "s07_cves": "SELECT 'CVE-' || l_orderkey || '-' || l_linenumber AS native_id, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS event_date FROM lineitem",
    "s12_calendar": f"""WITH c AS (SELECT *, CASE k % 4 WHEN 1 THEN '1999-06-07' WHEN 3 THEN '' ELSE day END AS event_date FROM ({_RAW}))
SELECT CASE WHEN k % 3 = 0 THEN 'https://o/' || k ELSE '/e/' || k END AS native_id, event_date, CASE WHEN k % 3 = 0 THEN 'https://o/' || k ELSE 'https://n.com/e/' || k END AS url FROM c WHERE event_date = '' OR event_date >= '{CUTOFF}'""",
    "s15_awards": f"""SELECT n || k AS native_id, 'CUSTOMER ' || o_custkey AS recipient, 'DOE' AS agency, '2001-01-01' AS event_date FROM ({_RAW}) JOIN customer ON c_custkey = o_custkey, (VALUES (1), (2)) v(n)
WHERE c_mktsegment = 'BUILDING' AND k % 9 <> 0 AND k % 10 <> 0 AND k % 4 <> n""",
}
