"""Feeds made of the driver's tables, normalised and kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import state
from ..sources import normalize
from ..session import table

CUTOFF = "1998-01-01"


def s01_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as parallel arrays, the items one short, back to rows."""
    o = table(spark, sf_dir, "orders")
    form = F.element_at(F.array(*map(F.lit, ("8-K", "10-K", "8-K/A", "4"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    row = F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), form.alias("f"), F.concat(F.lit("5.02, "), "o_orderstatus").alias("i"))
    per = o.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c].cast("string"))
    short = F.slice(part("i"), F.lit(1), F.size("r") - 1)
    payload = F.to_json(F.struct(part("o_orderkey").alias("accessionNumber"), part("d").alias("filingDate"), part("f").alias("form"), short.alias("items"), part("f").alias("primaryDocument")))
    out = normalize.filings(per.select("entity_id", payload.alias("payload")), CUTOFF)
    return out.select("entity_id", "native_id", "event_date", "form", F.array_join("items", "|").alias("items"))


def s06_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders as a catalog per supplier, undated ones kept; `s06_all_lines` takes all lines."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    day = F.when(F.col("l_orderkey") % 20 != 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
    per = li.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.format_string("CVE-%d-%d", "l_orderkey", "l_partkey").alias("cveID"), day.alias("dateAdded"))).alias("vulnerabilities"))
    return normalize.catalog(per.select(F.to_json(F.struct("vulnerabilities")).alias("payload")), "2000-01-01")


def s06_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped lines as a catalog per supplier and order, so that a supplier of many lines has many short payloads."""
    day = F.when(F.col("l_orderkey") % 20 != 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
    line = F.struct(F.format_string("CVE-%d-%d", "l_orderkey", "l_partkey").alias("cveID"), day.alias("dateAdded"))
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.collect_list(line).alias("vulnerabilities"))
    return normalize.catalog(per.select(F.to_json(F.struct("vulnerabilities")).alias("payload")), "2000-01-01")


def s08_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plants, with periods of all precisions and blank keys."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    period = F.when(k % 4 == 0, "2001").when(k % 4 == 1, "2001-07").when(k % 4 == 2, "2001-07-09").otherwise("July")
    payload = F.to_json(F.struct(k.cast("string").alias("plantid"), F.when(k % 9 != 0, F.col("p_brand")).otherwise(" ").alias("generatorid"), period.alias("period")))
    return normalize.capacity(p.select(payload.alias("payload")))


def s09_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: the customer is the url, two date forms, some blank."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    seen = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyyMMddHHmmss")).otherwise("soon")
    url = F.when(k % 10 != 0, F.format_string("http://n/%d", "o_custkey")).otherwise("")
    payload = F.to_json(F.struct(url.alias("url"), F.col("o_orderpriority").alias("title"), seen.alias("seendate")))
    return normalize.news(o.select(k.alias("order"), payload.alias("payload"))).select("native_id", "event_date", "title")


def s13_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as enforcement rows with short US dates."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.cast("string").alias("case_id"), F.when(k % 12 != 0, F.format_string("op %d", "o_custkey")).otherwise(" ").alias("operator"), F.col("o_orderstatus").alias("case_type"), F.when(k % 15 != 0, F.date_format("o_orderdate", "M/d/yy")).otherwise("n/a").alias("opened"))
    return normalize.enforcement(rows, CUTOFF).select("native_id", "event_date", "operator", "case_type")


def s14_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as settled cases, dated by settlement else filing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    payload = F.to_json(F.struct(k.cast("string").alias("CaseNumber"), F.lit("A (B)").alias("CaseName"), F.when(k % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).alias("SettlementDate"), F.when(k % 3 == 0, "02/03/1999").alias("DateFiled")))
    return normalize.settled_cases(o.select(payload.alias("payload")), CUTOFF)


def s10_page_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages: its length, and whether any tag or script is left."""
    out = normalize.page_snapshots(table(spark, sf_dir, "pages").where("url is not null"))
    return out.select("url", (F.length("text") > 0).alias("has_text"), F.col("text").contains("track(").alias("has_script"), F.col("text").rlike("<[a-z]+>").alias("has_tag"))


def s16_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings, a third of them without an id."""
    e = table(spark, sf_dir, "events")
    own = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).otherwise("")
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    payload = F.to_json(F.struct(own.alias("id"), F.col("event_type").alias("group"), F.col("event_id").cast("string").alias("victim"), F.when(F.col("event_id") % 2 == 0, day).otherwise("").alias("discovered"), day.alias("attackdate"), F.lit("energy").alias("activity")))
    return normalize.listings(e.select(payload.alias("payload"))).select(F.when(F.col("native_id").startswith("h:"), F.lit("hashed")).otherwise(F.col("native_id")).alias("native_id"), "event_date", "crew", "victim")


def s19_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of events, a quarter of them without a native id."""
    e = table(spark, sf_dir, "events")
    native = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).otherwise(" ")
    return e.select("event_id", state.event_key(F.col("event_type"), native, F.col("props")).alias("key"))


def _upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "props").alias("key"), "event_id", F.col("value").alias("payload"), F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"))
    old = e.where("event_id % 2 = 0 and event_id < 4000")
    first = F.row_number().over(Window.partitionBy("key").orderBy("event_id")) == 1
    return old.withColumn("r", first).where("r").select("key", "payload", "first_seen", "last_seen"), e.where("event_id >= 2000")


def s20_upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after a batch: known events are only touched, new ones inserted as first met. Its sides are fixed ids; `s20_upsert_all_events` takes all events."""
    old, batch = _upsert_sides(spark, sf_dir)
    return state.upserted(old, batch, "key", "event_id", ["payload", "first_seen"], ["last_seen"])


def s20_upsert_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the first two thirds of the ids after a batch of the last two thirds: every event is on a side, the middle on both."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "props").alias("key"), "event_id", F.col("value").alias("payload"), F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("event_id").alias("_top"))))  # one row
    old = e.where("3 * event_id <= 2 * _top").groupBy("key").agg(F.min_by("payload", "event_id").alias("payload"), F.min("event_id").alias("first_seen"), F.min("event_id").alias("last_seen"))
    return state.upserted(old, e.where("3 * event_id > _top"), "key", "event_id", ["payload", "first_seen"], ["last_seen"])


def s23_refresh_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers reloaded: the segment from the seed, the balance as edited."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.lower("c_mktsegment").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return state.refreshed(old, c.where("c_custkey % 5 <> 0"), "c_custkey", ["c_mktsegment"], ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


def s24_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as list cells of two forms, to rows."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cell = F.when(k % 3 == 0, F.to_json(F.split("p_name", " "))).when(k % 3 == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(";"))).otherwise(F.col("p_name"))
    return state.list_rows(p.withColumn("cell", cell), "p_partkey", "cell", "value")


def s25_fill_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank customer codes filled by balances that are offered only once."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "own").otherwise(" ").alias("code"))
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("string").alias("value"))
    return state.identifiers_filled(c, ids, "c_custkey", "code").withColumn("code", F.coalesce(F.trim("code"), F.lit("")))


def q04_unmet_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q04: lines loaded and lines whose part isn't among the cheap ones, by return flag."""
    kept, lost = state.unmet_parents(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    both = kept.select("l_returnflag", F.lit("loaded").alias("part")).unionByName(lost.select("l_returnflag", F.lit("skipped").alias("part")))
    return both.groupBy("l_returnflag", "part").agg(F.count("*").alias("n"))


def q05_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q05: native ids (props) met more than once in a source."""
    return table(spark, sf_dir, "events").groupBy("event_type", "props").agg(F.count("*").alias("n")).where("n > 1")


QUERIES = {f.__name__: f for f in (s01_filings, s06_all_lines, s08_capacity, s09_news, s13_enforcement, s14_cases, s19_event_keys, s20_upsert_all_events, s23_refresh_config, s24_list_cells, s25_fill_identifiers, q04_unmet_parents, q05_repeated_keys)}

ORACLES = {
    "s01_filings": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back,
 CASE o_orderkey % 4 WHEN 0 THEN '8-K' WHEN 1 THEN '10-K' WHEN 2 THEN '8-K/A' ELSE '4' END AS form FROM orders)
SELECT o_custkey AS entity_id, CAST(o_orderkey AS VARCHAR) AS native_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date, form, '5.02|' || o_orderstatus AS items
FROM o WHERE back > 1 AND form <> '4' AND strftime(o_orderdate, '%Y-%m-%d') >= '{CUTOFF}'""",
    "s06_all_lines": """SELECT 'CVE-' || l_orderkey || '-' || l_partkey AS native_id, CASE WHEN l_orderkey % 20 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS event_date
FROM lineitem WHERE l_orderkey % 20 = 0 OR l_shipdate >= TIMESTAMP '2000-01-01'""",
    "s08_capacity": """WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '2001' WHEN 1 THEN '2001-07' WHEN 2 THEN '2001-07-09' ELSE 'July' END AS period FROM part)
SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_partkey || ':' || p_brand || ':' || period END AS native_id,
 CASE p_partkey % 4 WHEN 0 THEN '2001-01-01' WHEN 1 THEN '2001-07-01' WHEN 2 THEN '2001-07-09' ELSE '' END AS event_date FROM p""",
    "s09_news": """WITH a AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'http://n/' || o_custkey END AS url FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url = '' THEN '#' || o_orderkey ELSE url END ORDER BY o_orderkey) AS r FROM a)
SELECT url AS native_id, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date, o_orderpriority AS title FROM f WHERE r = 1""",
    "s13_enforcement": f"""SELECT CAST(o_orderkey AS VARCHAR) AS native_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date, 'op ' || o_custkey AS operator, o_orderstatus AS case_type
FROM orders WHERE o_orderkey % 12 <> 0 AND o_orderkey % 15 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '{CUTOFF}'""",
    "s14_cases": f"""WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS native_id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN '1999-02-03' ELSE '' END AS event_date FROM orders)
SELECT native_id, event_date, 'A (B)' AS name FROM c WHERE event_date >= '{CUTOFF}'""",
    "s19_event_keys": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ':h:' || substr(sha256(props), 1, 24) ELSE event_type || ':' || event_id END AS key FROM events""",
    "s20_upsert_all_events": """WITH e AS (SELECT event_type || ':' || props AS key, event_id, value, max(event_id) OVER () AS top FROM events),
o AS (SELECT key, arg_min(value, event_id) AS payload, min(event_id) AS f FROM e WHERE 3 * event_id <= 2 * top GROUP BY key),
b AS (SELECT key, arg_min(value, event_id) AS payload, min(event_id) AS f, max(event_id) AS l FROM e WHERE 3 * event_id > top GROUP BY key)
SELECT coalesce(o.key, b.key) AS key, coalesce(o.payload, b.payload) AS payload, coalesce(o.f, b.f) AS first_seen, coalesce(b.l, o.f) AS last_seen FROM o FULL JOIN b ON o.key = b.key""",
    "s23_refresh_config": """WITH o AS (SELECT c_custkey, lower(c_mktsegment) AS s, c_acctbal + 1 AS a FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.s) AS c_mktsegment, round(coalesce(o.a, n.c_acctbal), 2) AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "s24_list_cells": """SELECT DISTINCT p_partkey, unnest(CASE WHEN p_partkey % 3 = 2 THEN [p_name] ELSE string_split(p_name, ' ') END) AS value FROM part""",
    "s25_fill_identifiers": """WITH i AS (SELECT c_custkey, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS v, count(*) OVER (PARTITION BY CAST(floor(c_acctbal) AS BIGINT)) AS n FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN n = 1 THEN v ELSE '' END AS code FROM i""",
    "q04_unmet_parents": """SELECT l_returnflag, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) THEN 'loaded' ELSE 'skipped' END AS part, count(*) AS n FROM lineitem GROUP BY ALL""",
    "q05_repeated_keys": "SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
}
