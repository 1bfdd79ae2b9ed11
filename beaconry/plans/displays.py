"""Records as shown, over orders dressed as landed regulatory records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import displays
from ..session import table

LONG = "Reliability standards for the protection of critical infrastructure assets, their owners and operators, and revisions thereof, order "


def j26_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display of records that gave no signal; some are page snapshots, some payloads aren't JSON."""
    k = F.col("o_orderkey")
    agencies = F.when(k % 3 == 0, F.array(F.struct(F.lit(" ").alias("name"), F.lit("x").alias("raw_name")), F.struct(F.lit("").alias("name"), F.lit(" Agency ").alias("raw_name"))))
    fields = F.struct(
        F.when(k % 7 < 3, F.concat(F.lit(LONG), k)).when(k % 7 < 5, F.concat(F.lit(" Order "), k)).alias("title"),
        F.when(k % 7 >= 5, F.concat(F.lit("Summary "), k)).alias("summary"),
        F.element_at(F.array(*map(F.lit, ("Rule", "Proposed Rule", "Notice", "Letter", ""))), (k % 5 + 1).cast("int")).alias("type"),
        agencies.alias("agencies"),
        F.when(k % 3 == 1, F.array(F.lit(""), F.lit("Office"))).alias("agency_names"),
        F.when(k % 2 == 0, "2002-01-01").alias("effective_on"),
        F.when(k % 11 == 0, "").alias("comments_close_on"),
    )
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), k).alias("raw_event_id"),
        F.when(k % 10 == 0, displays.SNAPSHOT_SOURCE).otherwise("register").alias("source_id"),
        F.lit("Register").alias("source_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"),
        F.concat(F.lit("https://pages.example/a/"), k, F.lit("/?q=1/2#x")).alias("url"),
        F.when(k % 13 == 0, F.concat(F.lit("not json "), k)).otherwise(F.to_json(fields)).alias("payload"),
    )
    return displays.regulatory_records(rows).select("raw_event_id", "agency", "doc_type_label", "title", "headline", "has_anchor", "effective_on", "comments_close_on", F.size("docket_ids").alias("dockets"))


QUERIES = {"j26_records": j26_records}

ORACLES = {
    "j26_records": f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS page, o_orderkey % 13 = 0 AS broken FROM orders),
a AS (SELECT *, CASE WHEN page THEN 'NERC' WHEN broken THEN 'Register' WHEN k % 3 = 0 THEN 'Agency' WHEN k % 3 = 1 THEN 'Office' ELSE 'Register' END AS agency,
  CASE WHEN page THEN 'page snapshot' WHEN broken THEN 'document' ELSE list_extract(['final rule', 'proposed rule', 'notice', 'Letter', 'document'], k % 5 + 1) END AS doc_type_label,
  CASE WHEN page THEN CAST(k AS VARCHAR) WHEN broken THEN 'not json ' || k WHEN k % 7 < 3 THEN '{LONG}' || k WHEN k % 7 < 5 THEN 'Order ' || k ELSE 'Summary ' || k END AS title,
  CASE WHEN k % 2 = 0 AND NOT broken THEN '2002-01-01' END AS effective_on FROM r),
b AS (SELECT *, 136 - length(agency || ' ' || doc_type_label) AS most FROM a),
c AS (SELECT *, rtrim(left(title, most - 1)) AS cut FROM b), d AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS before FROM c)
SELECT 'r' || k AS raw_event_id, agency, doc_type_label, title, agency || ' ' || doc_type_label || CASE WHEN page THEN ': ' || title ELSE ': "' || CASE WHEN length(title) <= most THEN title
  ELSE CASE WHEN before < length(cut) AND before >= most // 2 THEN rtrim(left(cut, before)) ELSE cut END || '…' END || '"' END AS headline,
 effective_on IS NOT NULL AS has_anchor, effective_on, CAST(NULL AS VARCHAR) AS comments_close_on, 0 AS dockets FROM d""",
}
