"""Text predicates over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..session import table
from . import roles


def p03_p05_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' first lines as company hints, headlines and cut titles."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select("doc_id", text.plausible_company(title).alias("hint"), text.headline(F.col("source"), F.when(F.col("doc_id") % 2 == 0, "Rule").otherwise(""), title).alias("headline"), text.title_cut(title, 40).alias("cut"))


def p04_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names dressed as case names, cleaned again."""
    name = F.concat(F.upper("p_name"), F.lit(" (LEAD (NATIONAL)) (CASE), ET AL. "))
    return table(spark, sf_dir, "part").select("p_partkey", text.case_name(name).alias("name"))


def p06_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON payloads: snippet, whether it is cut, fields left out."""
    d = table(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit(" "), F.col("lang")).alias("title"), "source", "n_chars"))).otherwise(F.concat(F.lit("not json "), "text"))
    return d.select("doc_id", text.payload_snippet(payload).alias("s")).select("doc_id", "s.*")


def p07_p11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that hold a short word, dockets and standards found in made-up references."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    refs = F.array(F.format_string("Docket Nos. RM%d-1-000 and RM%d-2-000", k % 30, k % 7), F.format_string("RM%d-1-000", k % 30))
    named = F.format_string("see CIP-%03d, CIP-01 and CIP-%03d; CIP-%03d", k % 14, k % 9, k % 14)
    return d.select("doc_id", F.size(text.sentences_with(F.col("text"), r"\bof\b")).alias("sentences"), F.array_join(text.docket_tokens(refs), ",").alias("dockets"), F.array_join(text.standard_ids(named), ",").alias("standards"))


def p08_p09_names_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies named before a semicolon, and turns without certain words."""
    c = table(spark, sf_dir, "conversations")
    title = F.concat(F.substring_index("text", " ", 2), F.when(F.col("turn") % 2 == 0, " Corp.").otherwise(" thing"), F.when(F.col("turn") % 3 != 0, "; notice").otherwise(""))
    return c.select("conv_id", "turn", text.named_company(title).isNotNull().alias("named"), text.terms_absent(F.col("text"), ["the", "de la", "der"]).alias("absent"))


def p12_p15_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that are safe to show, public references of events and keys."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(k % 5 == 0, F.format_string("https://WWW.ransomware.live/id/%d", k)).when(k % 7 == 0, "ftp://x/y").otherwise(F.col("url"))
    scope = F.when(k % 2 == 0, "account").otherwise("sector")
    shown = text.identity_safe_url(url, scope)
    ref = text.event_reference(F.concat(F.lit("src:"), "url"), scope)
    return p.select("page_id", shown.alias("shown"), text.clickable_url(shown).isNotNull().alias("clickable"), ref["ref"].alias("ref"), ref["hashed"].alias("hashed"), text.public_key(k.cast("string")).alias("card"))


def p16_p23_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of scores and counts, and the gate; of P23 neither score breakdown nor decay ceiling."""
    o, k = roles.signals(spark, sf_dir), F.col("seq")
    score = F.when(k % 50 != 0, (k % 600) / 100)
    return o.select("signal_id", text.severity_band(score).alias("severity"), text.density_band(k % 20).alias("density"), text.customer_facing(F.col("tier")).alias("facing"))


def p18_p20_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals inside the trailing two years, undated kept or not, and own industries."""
    s = roles.signals(spark, sf_dir).withColumn("d", F.when(F.col("event_date") == "undated", "").otherwise(F.col("event_date")))
    tag = F.when(F.col("seq") % 3 == 0, "Energy &  Utilities").when(F.col("seq") % 3 == 1, "Oil & Gas").otherwise("Retail")
    cut = str(dates.date(1999, 8, 2))
    since = dates.trailing_cutoff(F.lit(roles.NOW)) == F.lit(cut).cast("date")
    return s.select("signal_id", dates.in_window(F.col("d"), cut, True).alias("kept"), dates.in_window(F.col("d"), cut, False).alias("dated"), text.is_peer_industry(tag).alias("peer"), since.alias("cutoff_holds"))


QUERIES = {f.__name__: f for f in (p03_p05_titles, p04_case_names, p06_snippets, p07_p11_sentences, p08_p09_names_and_terms, p12_p15_references, p16_p23_bands, p18_p20_windows)}

ORACLES = {
    "p03_p05_titles": r"""WITH t AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title FROM documents),
h AS (SELECT *, regexp_replace(title, '^[\s,;:.\-–—]+|[\s,;:.\-–—]+$', '', 'g') AS hint, source || CASE WHEN doc_id % 2 = 0 THEN ' final rule: ' ELSE ' document: ' END || title AS full_title, rtrim(left(title, 39)) AS c FROM t),
x AS (SELECT *, length(c) - length(string_split(c, ' ')[-1]) AS last FROM h)
SELECT doc_id, CASE WHEN length(hint) BETWEEN 2 AND 80 AND len(string_split(trim(regexp_replace(hint, '\s+', ' ', 'g')), ' ')) <= 10 AND regexp_matches(hint, '[A-Za-z]') THEN hint ELSE '' END AS hint,
 CASE WHEN length(full_title) > 140 THEN rtrim(left(full_title, 139)) || '…' ELSE full_title END AS headline,
 CASE WHEN length(title) <= 40 THEN title WHEN last > 0 AND last - 1 >= 20 THEN rtrim(left(c, CAST(last AS INT))) || '…' ELSE c || '…' END AS cut FROM x""",
    "p04_case_names": "SELECT p_partkey, upper(p_name) AS name FROM part",
    "p06_snippets": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE left('not json ' || text, 200) END AS snippet,
CASE WHEN doc_id % 2 = 0 THEN false ELSE length(text) + 9 > 200 END AS truncated, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS omitted FROM documents""",
    "p07_p11_sentences": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '\bof\b')) AS l FROM documents)
SELECT doc_id, least(len(l), 2) AS sentences,
 'RM' || doc_id % 30 || '-1-000,RM' || doc_id % 7 || '-2-000' AS dockets,
 CASE WHEN doc_id % 14 = doc_id % 9 THEN lpad((doc_id % 14)::VARCHAR, 3, '0') ELSE lpad((doc_id % 14)::VARCHAR, 3, '0') || ',' || lpad((doc_id % 9)::VARCHAR, 3, '0') END AS standards FROM s""",
    "p08_p09_names_and_terms": r"""WITH t AS (SELECT conv_id, turn, text, array_to_string(string_split(text, ' ')[1:2], ' ') || CASE WHEN turn % 2 = 0 THEN ' Corp.' ELSE ' thing' END AS n FROM conversations)
SELECT conv_id, turn, turn % 3 <> 0 AND length(trim(n)) <= 80 AND strpos(n, ';') = 0 AND list_has_any(list_transform(regexp_split_to_array(n, '\s+'), lambda x: lower(regexp_replace(x, '[^\pL\pN_]', '', 'g'))),
 ['inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'llc', 'llp', 'lp', 'plc', 'ltd', 'limited', 'holdings', 'holding', 'group']) AS named,
 NOT regexp_matches(text, '(?i)(^|[^\pL\pN_])(the|de la|der)($|[^\pL\pN_])') AS absent FROM t""",
    "p12_p15_references": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'https://WWW.ransomware.live/id/' || page_id ELSE 'https://www.ransomware.live/' END WHEN page_id % 7 = 0 THEN 'ftp://x/y' ELSE url END AS shown,
 page_id % 5 = 0 OR page_id % 7 <> 0 AS clickable, CASE WHEN page_id % 2 = 0 THEN 'src:' || url ELSE left(sha256('src:' || url), 16) END AS ref, page_id % 2 <> 0 AS hashed, left(sha256(page_id::VARCHAR), 16) AS card FROM pages""",
    "p16_p23_bands": f"""WITH {roles.SIGNALS}, s AS (SELECT *, CASE WHEN seq % 50 <> 0 THEN (seq % 600) / 100 END AS score FROM signals)
SELECT signal_id, CASE WHEN score >= 4 THEN 'critical' WHEN score >= 2.75 THEN 'high' WHEN score >= 1.5 THEN 'moderate' ELSE 'low' END AS severity,
 CASE WHEN seq % 20 <= 0 THEN 'd0' WHEN seq % 20 <= 2 THEN 'd1' WHEN seq % 20 <= 6 THEN 'd2' WHEN seq % 20 <= 14 THEN 'd3' ELSE 'd4' END AS density,
 CASE WHEN tier = 'unconfirmed_early_warning' THEN 0 ELSE 1 END AS facing FROM s""",
    "p18_p20_windows": f"""WITH {roles.SIGNALS} SELECT signal_id, event_date = 'undated' OR event_date >= '1999-08-02' AS kept, event_date <> 'undated' AND event_date >= '1999-08-02' AS dated, seq % 3 <> 2 AS peer, true AS cutoff_holds FROM signals""",
}
