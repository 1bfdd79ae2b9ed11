"""Work lists, identifiers, provenance and source measurement over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import worklists as w
from ..session import table
from . import roles
from .roles import ENTITIES, SIGNALS


def j09_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per user, the first event's, but none where a customer in debt has one already."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return w.once(e, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), "user_id", "event_id")


def j11_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name meets one id of a registry, in which every seventh name has two."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.upper("c_name"), F.lit(" , "))
    registry = c.select("c_name", k).unionByName(c.where("c_custkey % 7 = 0").select("c_name", (-k).alias("c_custkey"))).toDF("name", "id")
    return w.unique_ids(c.select(k.alias("entity_id"), name.alias("term")), registry)


def j12_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' first candidate of country 1 with their exact name."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    many = c.select(k.alias("entity_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"), "c_name")
    rows = many.select(
        "entity_id",
        "place",
        (F.col("entity_id") * 10 + F.col("place")).alias("id"),
        ((F.col("entity_id") + F.col("place")) % 3).cast("string").alias("country"),
        F.when((F.col("entity_id") + F.col("place")) % 2 == 0, F.lower("c_name")).otherwise(F.concat("c_name", F.lit(" Inc"))).alias("name"),
    )
    return w.accepted(rows, c.select(k.alias("entity_id"), F.col("c_name").alias("term")), "1")


def j14_internal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent edges between customers: each to its key's half, some outside, some to themselves."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    parent = F.when(k % 5 == 0, k).when(k % 7 == 0, -k).otherwise(F.floor(k / 2))
    lei = lambda x: F.concat(F.lit("L"), x.cast("string"))
    return w.internal_edges(c.select(lei(k).alias("child"), lei(parent).alias("parent")), c.select(k.alias("entity_id"), lei(k).alias("lei")))


def j16_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names hold words of a vocabulary."""
    out = w.shape_scan(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["ring", "blue", "anvil", "an"])
    return out.select("p_partkey", F.array_join("shapes", ",").alias("shapes"))


def j32_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facilities, some without a place, with suppliers of their nation as owners."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    places = c.select(k.alias("facility_id"), F.when(k % 9 != 0, (k % 180).cast("double")).alias("lat"), (k % 90).cast("double").alias("lon"))
    owners = c.select(k.alias("facility_id"), F.col("c_nationkey").alias("owner"), ((k % 20) / 20).alias("evidence"))
    return w.owned_facilities(places, owners)


def j35_account_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays (lines) of all active signals of accounts."""
    own = roles.signals(spark, sf_dir).where("status = 'active' and entity_id is not null").select("seq", "signal_id", "entity_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("play"), F.col("l_partkey").alias("product"))
    return own.join(lines, "seq").select("entity_id", "signal_id", "play", "product")


def j36_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as pending reviews, with the candidate customer and the event where known."""
    e = table(spark, sf_dir, "events")
    queue = e.where("event_type = 'error'").select(F.col("event_id").alias("review_id"), "user_id", (F.col("event_id") * 2).alias("raw_event_id"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("candidate"))
    what = e.select(F.col("event_id").alias("raw_event_id"), F.col("event_type").alias("about"))
    return queue.join(who, "user_id", "left").join(what, "raw_event_id", "left").select("review_id", "candidate", "about")


def j37_retiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 changes of tier of each status, and whether they raised the gate."""
    k = F.col("seq")
    rows = roles.signals(spark, sf_dir).select("signal_id", "status", "seq", (k % 2).alias("old_gate"), (k % 3 % 2).alias("new_gate"))
    out = w.newest(rows, ["status"], "seq", "signal_id", 50)
    return out.select("signal_id", "status", "place", ((F.col("old_gate") == 0) & (F.col("new_gate") == 1)).alias("gate_raised"))


def j40_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal as one nested record: its headline, evidence (lines in order) and plays (parts); shown as text."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), "l_linenumber", "l_partkey")
    s = roles.signals(spark, sf_dir).select("seq", "signal_id", "headline")
    out = w.record(s, {"evidence": (lines, ["l_linenumber", "l_partkey"]), "plays": (lines.select("seq", "l_partkey").distinct(), ["l_partkey"])}, "seq")
    text = lambda a, f: F.array_join(F.transform(a, f), ",")
    return out.select(
        "signal_id",
        "headline",
        text("evidence", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))).alias("evidence"),
        text("plays", lambda x: x["l_partkey"].cast("string")).alias("plays"),
    )


def j41_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each event type's rule that looked at a user's events."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("event_id"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("version"), "ts")
    return w.provenance(runs)


def s17_entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of solvent customers: names, and aliases of which some collide or differ by case and marks only."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    entities = c.select(k.alias("entity_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("active"))
    alias = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat(F.col("c_mktsegment"), F.lit(" (US)"))).otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit(' " Co')))
    return w.entity_terms(entities, c.select(k.alias("entity_id"), alias.alias("term")), c.where("c_custkey % 4 = 0").select(k.alias("entity_id"), F.lower("c_name").alias("term")))


def a24_q08_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each trigger's signals fit as a source in a year."""
    s = roles.signals(spark, sf_dir)
    status = F.when(F.col("entity_id").isNull(), "none").when(F.col("tier").isNull(), "review").otherwise("matched")
    day = F.when(F.col("trigger_id") == "5-LOW", "soon").otherwise(F.col("event_date"))
    return w.measured(s, F.try_to_date(day, "yyyy-MM-dd"), "1995-01-01", "1996-06-30", status, ["trigger_id"])


def a26_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type: how many name a number, and how many different ones."""
    e = table(spark, sf_dir, "events").select("event_type", F.regexp_extract_all("props", F.lit(r"\d+"), 0).alias("ids"))
    counts = e.groupBy("event_type").agg(F.count("*").alias("docs"), F.count_if(F.size("ids") > 0).alias("with_ids"))
    ids = e.select("event_type", F.explode("ids").alias("id")).groupBy("event_type").agg(F.countDistinct("id").alias("distinct_ids"))
    return counts.join(ids, "event_type", "left").select("event_type", "docs", "with_ids", F.coalesce("distinct_ids", F.lit(0)).alias("distinct_ids"))


def w10_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the unmatched events of each type the three with the greatest value."""
    e = table(spark, sf_dir, "events").where("user_id % 2 = 1")
    return w.newest(e, ["event_type"], "value", "event_id", 3).select("event_type", "place", "event_id", "value")


def a04_fresh_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, read from the stored aggregate if fresh; four states, of which one is."""
    live = roles.signals(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    stored = live.withColumn("n", F.col("n") + 1)
    now, out = "2024-01-02T12:00:00Z", None
    for case, row in {"fresh": ("2024-01-02T01:00:00Z", "all", "b1"), "old": ("2024-01-01T01:00:00Z", "all", "b1"), "other": ("2024-01-02T01:00:00Z", "some", "b1"), "naive": ("2024-01-02T01:00:00", "all", "b1"), "none": None}.items():
        state = spark.createDataFrame([row] if row else [], "as_of string, filters string, basis string")
        one = w.read_or_recomputed(state, live, stored, "all", "b1", now).withColumn("case", F.lit(case))
        out = one if out is None else out.unionByName(one)
    return out


def l02_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as obligations whose lines name standards (suppliers), with the products (parts) of those in order."""
    lines = table(spark, sf_dir, "lineitem")
    named = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("s")))), lambda x: x["s"]).alias("standards"))
    p = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("standard"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("place"), "s_nationkey")
    p = p.select("standard", "place", ((F.col("s_nationkey") + F.col("place")) % 5).cast("string").alias("product"))
    return w.mapped_products(named, p, "id", "standards")


def e07_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback, by what speaks against appending it."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        k, F.when(k % 11 == 0, "maybe").when(F.col("quality") == 1, "up").otherwise("down").alias("verdict"),
        F.when(k % 3 == 0, "stale").when(k % 3 == 1, "odd").alias("reason_code"),
    )
    return w.feedback(rows, ["stale", "wrong"]).groupBy("verdict", "problem").agg(F.count("*").alias("n"))


def p22_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's badges."""
    s = roles.signals(spark, sf_dir).join(roles.entities(spark, sf_dir).select("entity_id", "coverage_flag"), "entity_id", "left")
    flags = {"unconfirmed": F.col("tier") == "unconfirmed_early_warning", "low coverage": F.col("coverage_flag") == "dark", "segment": ~F.col("signal_scope").isin("account", "sector")}
    return s.select("signal_id", F.array_join(w.badges(flags), ",").alias("badges"))


QUERIES = {
    f.__name__: f
    for f in (
        j09_once, j11_unique_ids, j12_accepted, j14_internal_edges, j16_shapes, j32_owned, j35_account_plays, j36_review_list, j37_retiers, j40_record,
        j41_provenance, s17_entity_terms, a24_q08_fit, a26_references, w10_near_misses, a04_fresh_read, l02_products, e07_feedback, p22_badges,
    )
}

_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

ORACLES = {
    "j09_once": """SELECT user_id, event_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "j11_unique_ids": f"""WITH r AS (SELECT {_PLAIN.format("c_name")} AS n, c_custkey AS id FROM customer UNION ALL SELECT {_PLAIN.format("c_name")}, -c_custkey FROM customer WHERE c_custkey % 7 = 0)
SELECT c_custkey AS entity_id, min(id) AS id FROM customer JOIN r ON n = {_PLAIN.format("c_name")} GROUP BY c_custkey HAVING count(DISTINCT id) = 1""",
    "j12_accepted": """SELECT c_custkey AS entity_id, min(c_custkey * 10 + p) AS id FROM customer, range(1, 5) t(p)
WHERE (c_custkey + p) % 3 = 1 AND (c_custkey + p) % 2 = 0 GROUP BY c_custkey""",
    "j14_internal_edges": """WITH e AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN c_custkey WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey // 2 END AS p FROM customer)
SELECT DISTINCT c AS child_id, p AS parent_id FROM e WHERE p <> c AND p IN (SELECT c_custkey FROM customer)""",
    "j16_shapes": r"""WITH t AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)\bring\b') THEN 'ring' END, CASE WHEN regexp_matches(p_name, '(?i)\bblue\b') THEN 'blue' END,
 CASE WHEN regexp_matches(p_name, '(?i)\banvil\b') THEN 'anvil' END, CASE WHEN regexp_matches(p_name, '(?i)\ban\b') THEN 'an' END], lambda x: x IS NOT NULL), ',') AS shapes FROM part) SELECT * FROM t WHERE shapes <> ''""",
    "j32_owned": """SELECT c_custkey AS facility_id, CAST(c_custkey % 180 AS DOUBLE) AS lat, CAST(c_custkey % 90 AS DOUBLE) AS lon, c_nationkey AS owner, (c_custkey % 20) / 20 AS evidence
FROM customer WHERE c_custkey % 9 <> 0 AND (c_custkey % 20) / 20 >= 0.85""",
    "j35_account_plays": f"""WITH {SIGNALS} SELECT entity_id, signal_id, l_linenumber AS play, l_partkey AS product FROM signals JOIN lineitem ON l_orderkey = seq WHERE status = 'active' AND entity_id IS NOT NULL""",
    "j36_review_list": """SELECT q.event_id AS review_id, c_name AS candidate, e.event_type AS about FROM events q LEFT JOIN customer ON c_custkey = q.user_id LEFT JOIN events e ON e.event_id = q.event_id * 2
WHERE q.event_type = 'error'""",
    "j37_retiers": f"""WITH {SIGNALS}, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY seq DESC) AS place FROM signals)
SELECT signal_id, status, CAST(place AS INT) AS place, seq % 2 = 0 AND seq % 3 % 2 = 1 AS gate_raised FROM n WHERE place <= 50""",
    "j40_record": f"""WITH {SIGNALS}, e AS (SELECT l_orderkey AS seq, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS evidence FROM lineitem GROUP BY 1),
p AS (SELECT seq, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS plays FROM (SELECT DISTINCT l_orderkey AS seq, l_partkey FROM lineitem) GROUP BY seq)
SELECT signal_id, headline, coalesce(evidence, '') AS evidence, coalesce(plays, '') AS plays FROM signals LEFT JOIN e USING (seq) LEFT JOIN p USING (seq)""",
    "j41_provenance": """SELECT user_id AS event_id, event_type AS classifier, arg_max(event_type || '/' || (event_id % 7), (ts, event_id % 7)) AS version FROM events GROUP BY ALL""",
    "s17_entity_terms": r"""WITH t AS (SELECT c_custkey AS e, c_name AS term FROM customer WHERE c_acctbal >= 0 UNION ALL
 SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_mktsegment || ' (US)' ELSE '"' || c_mktsegment || ' " Co' END FROM customer WHERE c_acctbal >= 0),
k AS (SELECT t.* FROM t JOIN customer ON c_custkey = e WHERE NOT (e % 4 = 0 AND lower(term) = lower(c_name))),
p AS (SELECT e, term, regexp_replace(trim(regexp_replace(regexp_replace(term, '\([^)]*\)', '', 'g'), '["()]', '', 'g')), '\s+', ' ', 'g') AS phrase FROM k)
SELECT e AS entity_id, phrase FROM p WHERE phrase <> '' QUALIFY row_number() OVER (PARTITION BY lower(phrase) ORDER BY e, term) = 1""",
    "a24_q08_fit": f"""WITH {SIGNALS}, d AS (SELECT trigger_id, try_cast(CASE WHEN trigger_id <> '5-LOW' THEN event_date END AS DATE) AS day,
 CASE WHEN entity_id IS NULL THEN 'none' WHEN tier IS NULL THEN 'review' ELSE 'matched' END AS status FROM signals),
c AS (SELECT trigger_id, count(*) AS total, count(*) FILTER (day IS NULL) AS undated, count(*) FILTER (day NOT BETWEEN DATE '1995-01-01' AND DATE '1996-06-30') AS out_of_window,
 count(*) FILTER (day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND status = 'matched') AS matched, count(*) FILTER (day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND status = 'review') AS review,
 count(*) FILTER (day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND status = 'none') AS "none" FROM d GROUP BY trigger_id)
SELECT *, CASE WHEN undated = total THEN 'unparseable' WHEN matched >= 25 THEN 'build' WHEN matched > 0 THEN 'watch' ELSE 'skip' END AS recommendation FROM c""",
    "a26_references": r"""WITH e AS (SELECT event_type, regexp_extract_all(props, '\d+') AS ids FROM events), i AS (SELECT event_type, count(DISTINCT id) AS n FROM (SELECT event_type, unnest(ids) AS id FROM e) GROUP BY 1)
SELECT event_type, count(*) AS docs, count(*) FILTER (len(ids) > 0) AS with_ids, coalesce(any_value(n), 0) AS distinct_ids FROM e LEFT JOIN i USING (event_type) GROUP BY event_type""",
    "w10_near_misses": """SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) AS INT) AS place, event_id, value FROM events WHERE user_id % 2 = 1 QUALIFY place <= 3""",
    "a04_fresh_read": f"""WITH {SIGNALS}, n AS (SELECT status, count(*) AS n FROM signals GROUP BY status),
c ("case", reason) AS (VALUES ('fresh', ''), ('old', 'expired'), ('other', 'filter mismatch'), ('naive', 'unreadable'), ('none', 'missing'))
SELECT status, CASE WHEN reason = '' THEN n + 1 ELSE n END AS n, reason, "case" FROM n, c""",
    "l02_products": """WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS i, l_suppkey AS k FROM lineitem), p AS (SELECT s_suppkey AS k, place, CAST((s_nationkey + place) % 5 AS VARCHAR) AS product FROM supplier, range(2) t(place) WHERE s_suppkey % 3 <> 0),
f AS (SELECT id, product, min((i, place)) AS spot FROM s JOIN p USING (k) GROUP BY ALL)
SELECT id, products FROM (SELECT DISTINCT id FROM s) LEFT JOIN (SELECT id, string_agg(product, ';' ORDER BY spot, product) AS products FROM f GROUP BY id) USING (id)""",
    "e07_feedback": """WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN quality = 1 THEN 'up' ELSE 'down' END AS verdict, CASE doc_id % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'odd' END AS r FROM labels)
SELECT verdict, CASE WHEN verdict = 'maybe' THEN 'unknown verdict' WHEN verdict = 'down' AND r IS NULL THEN 'a reason is needed' WHEN verdict = 'down' AND r <> 'stale' THEN 'unknown reason'
 WHEN verdict = 'up' AND r IS NOT NULL THEN 'no reason is wanted' ELSE '' END AS problem, count(*) AS n FROM f GROUP BY ALL""",
    "p22_badges": f"""WITH {SIGNALS}, {ENTITIES} SELECT signal_id, array_to_string(list_filter([CASE WHEN tier = 'unconfirmed_early_warning' THEN 'unconfirmed' END, CASE WHEN coverage_flag = 'dark' THEN 'low coverage' END,
 CASE WHEN signal_scope NOT IN ('account', 'sector') THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS badges FROM signals LEFT JOIN entities USING (entity_id)""",
}
