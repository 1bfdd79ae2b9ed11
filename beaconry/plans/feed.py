"""Feeds, health, duplicates, samples and activity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_of
from ..operators import activity, feed, scoring
from ..session import table
from . import roles
from .roles import NOW, SIGNALS


def w01_recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of active cards after a key, newest first."""
    rows = roles.signals(spark, sf_dir).where("status = 'active' and signal_scope in ('account', 'parent') and event_date <> 'undated'")
    return feed.recent_page(rows, after=("2001-06-01", "s5"), limit=50).select("signal_id", "event_date")


def j20_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals with what a card shows of trigger, entity and event."""
    rows = roles.signals(spark, sf_dir).where("status = 'active'")
    out = rows.join(F.broadcast(roles.triggers(spark).select("trigger_id", F.col("name").alias("trigger_name"))), "trigger_id").join(roles.entities(spark, sf_dir), "entity_id", "left")
    return out.select("signal_id", "trigger_name", "name", "subsector", "headline", "event_date")


def w04_w05_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source (event type) and user the last and last good run, and the state."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), (F.col("user_id") % 20).alias("host"), F.col("ts").alias("started"), F.col("event_id").alias("run_id"), "value")
    health = feed.run_health(runs, ["source_id", "host"], F.col("value") < 20, ["started", "run_id"], ["run_id", "started", "value"])
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp("last.started")
    state = feed.source_state(F.col("host") != 3, F.col("last").isNotNull(), F.col("last.value") >= 20, age, F.lit(86400))
    return health.select("source_id", "host", F.col("last.run_id").alias("last_run"), F.col("last_ok.run_id").alias("last_ok_run"), "runs", "errors", state.alias("state"))


def s22_batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen, new and failed events per source and day."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = rows.groupBy("event_type", "props").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    marked = rows.join(first, ["event_type", "props"]).withColumn("new", F.col("event_id") == F.col("f.event_id"))
    return marked.groupBy(F.col("event_type").alias("source_id"), "day").agg(F.count("*").alias("seen"), F.count_if("new").alias("new"), F.count_if(F.col("value") > 50).alias("errors"))


def j22_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one entity and trigger within three days."""
    rows = roles.signals(spark, sf_dir).withColumn("day", day_of(F.col("event_date")))
    return feed.near_in_time(rows, 3).select("a", "b", F.col("gap").cast("bigint").alias("gap"))


def j23_same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text, each with its group's first."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return feed.same_content(docs)


def j24_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal pairs by date or by equal headline within an entity."""
    rows = roles.signals(spark, sf_dir).withColumn("day", day_of(F.col("event_date")))
    equal = feed.same_content(rows.where("entity_id is not null").select(F.col("signal_id").alias("id"), F.sha2(F.concat_ws("|", F.col("entity_id").cast("string"), "trigger_id", "tier"), 256).alias("content_hash")))
    return feed.duplicate_candidates(feed.near_in_time(rows, 3), equal).select("a", "b", "bases", F.col("gap").cast("bigint").alias("gap"), "rank")


def j25_non_graduated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders processed (returned lines) from which no active signal came."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seq")).distinct()
    active = roles.signals(spark, sf_dir).where("status = 'active'").select("seq")
    return lines.join(active, "seq", "left_anti").select("seq")


def j30_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nation and region read both ways."""
    edges = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    down = edges.select(F.col("r_name").alias("of"), F.lit("child").alias("kind"), F.col("n_name").alias("other"))
    return down.unionByName(edges.select(F.col("n_name").alias("of"), F.lit("parent").alias("kind"), F.col("r_name").alias("other")))


def j31_account_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with its counts of signals by status."""
    counts = roles.signals(spark, sf_dir).groupBy("entity_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "decayed").alias("decayed"), F.max("event_date").alias("last"))
    return roles.entities(spark, sf_dir).join(counts, "entity_id", "left").select("entity_id", "name", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("decayed", F.lit(0)).alias("decayed"), "last")


def j38_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that point at each nation, by table."""
    cells = [(t, c) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    parts = [table(spark, sf_dir, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).withColumn("of", F.lit(t)) for t, c in cells]
    return parts[0].unionByName(parts[1]).groupBy("nation").pivot("of", ["customer", "supplier"]).agg(F.first("n")).na.fill(0)


def j42_previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's and type's value strictly before, to the millisecond."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return feed.previous_by(rows, "k", "at", "value", "previous").select("event_id", F.round("previous", 6).alias("previous"))


def w08_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents that no label covers yet, one of each source in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return feed.round_robin_sample(rows, "source", "doc_id", 7, 40).select("doc_id", "source", "turn")


def w09_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best account cards and the newest eight sector and calendar cards."""
    rows = scoring.scored(roles.signals(spark, sf_dir).where("status = 'active'"), roles.triggers(spark), roles.entities(spark, sf_dir), roles.WEIGHTS, NOW)
    score = F.round("score", 6)
    best = rows.where("signal_scope in ('account', 'parent')").orderBy(F.desc(score), F.desc("event_date"), F.desc("signal_id")).limit(8).select(F.lit("account").alias("section"), "signal_id")
    parts = [best]
    for scope in ("sector", "regulatory_calendar"):
        part = rows.where((F.col("signal_scope") == scope) & (F.col("event_date") != "undated"))
        parts.append(part.orderBy(F.desc("event_date"), F.desc("signal_id")).limit(8).select(F.lit(scope).alias("section"), "signal_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def w12_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active signal with its place in its account's timeline."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy(F.desc("event_date"), F.desc("signal_id"))
    return roles.signals(spark, sf_dir).where("status = 'active' and entity_id is not null").select("signal_id", "entity_id", F.row_number().over(w).alias("place"))


def a01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals by trigger, scope and tier."""
    return feed.counts_by(roles.signals(spark, sf_dir).where("status = 'active'"), ["trigger_id", "signal_scope", "tier"])


def a03_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03 in part: a fingerprint of counts by status, without the max edit id."""
    per = roles.signals(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    line = F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string")))))
    return per.agg(F.substring(F.sha2(line, 256), 1, 16).alias("basis"))


def a05_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 in part: signals, entities and date span per trigger, without pending depth and edit count; a span needs two distinct dates."""
    rows = roles.signals(spark, sf_dir).where("event_date <> 'undated'")
    per = rows.groupBy("trigger_id", "signal_scope").agg(F.count("*").alias("signals"), F.count_distinct("entity_id").alias("entities"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    return per.where("first <> last")


def a05_many_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with at least two distinct active triggers."""
    per = roles.signals(spark, sf_dir).where("status = 'active' and entity_id is not null").groupBy("entity_id").agg(F.count_distinct("trigger_id").alias("triggers"))
    return per.where("triggers >= 2")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings: the user's group is the crew, the payload's number the victim, the type the industry."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.format_string("crew%d", F.col("user_id")).alias("crew"), F.concat(F.lit("  Firm "), k, F.lit(" ")).alias("victim"), F.col("event_type").alias("industry"), F.to_date("ts").alias("day"))


def a06_crews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crews by volume; those with fewer than 60 distinct victims stay unnamed."""
    return activity.by_crew(_listings(spark, sf_dir), 60)


def a06_w07_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries ranked, own ones marked."""
    return activity.by_industry(_listings(spark, sf_dir), F.col("industry").isin("error", "purchase"))


def a07_a08_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal halves of the covered days compared."""
    daily = _listings(spark, sf_dir).groupBy("day").agg(F.count("*").alias("total"), F.count_if(F.col("industry") == "error").alias("peer"))
    return activity.halves(daily)


QUERIES = {
    f.__name__: f
    for f in (
        w01_recent_page, j20_card_rows, w04_w05_source_health, s22_batch_ledger, j22_near_pairs, j23_same_content, j24_duplicate_candidates, j25_non_graduated,
        j30_relationships, j31_account_headers, j38_reference_counts, j42_previous_value, w08_stratified_sample, w09_digest, w12_timelines, a01_counts, a03_basis,
        a05_probe, a05_many_triggers, a06_crews, a06_w07_industries, a07_a08_baseline,
    )
}

_NEAR = """day AS (SELECT *, try_cast(event_date AS DATE) AS d FROM signals),
near AS (SELECT least(x.signal_id, y.signal_id) AS a, greatest(x.signal_id, y.signal_id) AS b, abs(date_diff('day', x.d, y.d)) AS gap
 FROM day x JOIN day y ON x.entity_id = y.entity_id AND x.trigger_id = y.trigger_id AND x.signal_id < y.signal_id AND abs(date_diff('day', x.d, y.d)) <= 3)"""
_LISTINGS = "listings AS (SELECT 'crew' || user_id AS crew, json_extract_string(props, '$.k') AS victim, event_type AS industry, CAST(ts AS DATE) AS day FROM events)"

ORACLES = {
    "w01_recent_page": f"""WITH {SIGNALS} SELECT signal_id, event_date FROM signals WHERE status = 'active' AND signal_scope IN ('account', 'parent') AND event_date <> 'undated'
AND (event_date < '2001-06-01' OR (event_date = '2001-06-01' AND signal_id < 's5')) ORDER BY event_date DESC, signal_id DESC LIMIT 51""",
    "j20_card_rows": f"""WITH {SIGNALS}, {roles.ENTITIES}, {roles.TRIGGER_ROWS} SELECT signal_id, t.name AS trigger_name, e.name, subsector, headline, event_date
FROM signals s JOIN triggers t USING (trigger_id) LEFT JOIN entities e ON e.entity_id = s.entity_id WHERE status = 'active'""",
    "w04_w05_source_health": """WITH r AS (SELECT event_type AS source_id, user_id % 20 AS host, ts, event_id, value FROM events),
h AS (SELECT source_id, host, arg_max(event_id, (ts, event_id)) AS last_run, arg_max(event_id, (ts, event_id)) FILTER (value < 20) AS last_ok_run, arg_max(value, (ts, event_id)) AS v,
 max(ts) AS t, count(*) AS runs, count(*) FILTER (NOT value < 20) AS errors FROM r GROUP BY ALL)
SELECT source_id, host, last_run, last_ok_run, runs, errors, CASE WHEN host = 3 THEN 'disabled' WHEN v >= 20 THEN 'error'
 WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(t)) > 86400 THEN 'stale' ELSE 'ok' END AS state FROM h""",
    "s22_batch_ledger": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY event_type, props ORDER BY ts, event_id) = 1 AS new FROM events)
SELECT event_type AS source_id, CAST(ts AS DATE) AS day, count(*) AS seen, count(*) FILTER (new) AS new, count(*) FILTER (value > 50) AS errors FROM m GROUP BY ALL""",
    "j22_near_pairs": f"WITH {SIGNALS}, {_NEAR} SELECT a, b, gap FROM near",
    "j23_same_content": "WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS a FROM documents) SELECT a, doc_id AS b FROM f WHERE a <> doc_id",
    "j24_duplicate_candidates": f"""WITH {SIGNALS}, {_NEAR}, g AS (SELECT signal_id, min(signal_id) OVER (PARTITION BY entity_id, trigger_id, tier) AS a FROM signals WHERE entity_id IS NOT NULL),
p AS (SELECT a, b, 'near_date' AS basis, gap, 1 AS rank FROM near UNION ALL SELECT a, signal_id, 'same_content', NULL, 0 FROM g WHERE a <> signal_id)
SELECT a, b, string_agg(DISTINCT basis, '+' ORDER BY basis) AS bases, min(gap) AS gap, min(rank) AS rank FROM p GROUP BY a, b""",
    "j25_non_graduated": f"WITH {SIGNALS} SELECT DISTINCT l_orderkey AS seq FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT seq FROM signals WHERE status = 'active')",
    "j30_relationships": """SELECT r_name AS of, 'child' AS kind, n_name AS other FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'parent', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "j31_account_headers": f"""WITH {SIGNALS}, {roles.ENTITIES}, c AS (SELECT entity_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'decayed') AS decayed, max(event_date) AS last FROM signals GROUP BY entity_id)
SELECT e.entity_id, name, coalesce(active, 0) AS active, coalesce(decayed, 0) AS decayed, last FROM entities e LEFT JOIN c ON c.entity_id = e.entity_id""",
    "j38_reference_counts": """SELECT nation, count(*) FILTER (t = 'customer') AS customer, count(*) FILTER (t = 'supplier') AS supplier FROM (
SELECT c_nationkey AS nation, 'customer' AS t FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY nation""",
    "j42_previous_value": """SELECT event_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS previous FROM events""",
    "w08_stratified_sample": """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || '|7')) AS turn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 40""",
    "w09_digest": f"""WITH {roles.SCORED}, a AS (SELECT *, round(score_base * score_decay * score_account_fit * score_scope_fit, 6) AS score FROM scored WHERE status = 'active')
(SELECT 'account' AS section, signal_id FROM a WHERE signal_scope IN ('account', 'parent') ORDER BY score DESC, event_date DESC, signal_id DESC LIMIT 8)
UNION ALL (SELECT 'sector', signal_id FROM a WHERE signal_scope = 'sector' AND event_date <> 'undated' ORDER BY event_date DESC, signal_id DESC LIMIT 8)
UNION ALL (SELECT 'regulatory_calendar', signal_id FROM a WHERE signal_scope = 'regulatory_calendar' AND event_date <> 'undated' ORDER BY event_date DESC, signal_id DESC LIMIT 8)""",
    "w12_timelines": f"WITH {SIGNALS} SELECT signal_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, signal_id DESC) AS place FROM signals WHERE status = 'active' AND entity_id IS NOT NULL",
    "a01_counts": f"""WITH {SIGNALS}, t AS (SELECT unnest([{{'d': 'trigger_id', 'k': trigger_id}}, {{'d': 'signal_scope', 'k': signal_scope}}, {{'d': 'tier', 'k': tier}}]) AS x FROM signals WHERE status = 'active')
SELECT x.d AS dimension, x.k AS key, count(*) AS count FROM t WHERE x.k IS NOT NULL GROUP BY ALL""",
    "a03_basis": f"WITH {SIGNALS}, p AS (SELECT status || ':' || count(*) AS line FROM signals GROUP BY status) SELECT substr(sha256(string_agg(line, ',' ORDER BY line)), 1, 16) AS basis FROM p",
    "a05_probe": f"""WITH {SIGNALS} SELECT trigger_id, signal_scope, count(*) AS signals, count(DISTINCT entity_id) AS entities, min(event_date) AS first, max(event_date) AS last
FROM signals WHERE event_date <> 'undated' GROUP BY ALL HAVING min(event_date) <> max(event_date)""",
    "a05_many_triggers": f"WITH {SIGNALS} SELECT entity_id, count(DISTINCT trigger_id) AS triggers FROM signals WHERE status = 'active' AND entity_id IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT trigger_id) >= 2",
    "a06_crews": f"""WITH {_LISTINGS}, p AS (SELECT crew, count(*) AS listings, count(DISTINCT victim) AS victims FROM listings GROUP BY crew)
SELECT crew, listings, 1::BIGINT AS crews FROM p WHERE victims >= 60 UNION ALL SELECT '(withheld)', CAST(sum(listings) AS BIGINT), count(*) FROM p WHERE victims < 60 HAVING count(*) > 0""",
    "a06_w07_industries": f"""WITH {_LISTINGS} SELECT industry, count(*) AS listings, row_number() OVER (ORDER BY count(*) DESC, industry) AS rank, industry IN ('error', 'purchase') AS peer
FROM listings WHERE industry <> '' GROUP BY industry""",
    "a07_a08_baseline": f"""WITH {_LISTINGS}, d AS (SELECT day, count(*) AS total, count(*) FILTER (industry = 'error') AS peer FROM listings GROUP BY day),
n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
s AS (SELECT *, CASE WHEN n - 2 >= 2 AND i BETWEEN 1 AND (n - 2) // 2 THEN 'prior' WHEN n - 2 >= 2 AND i >= n - 1 - (n - 2) // 2 AND i <= n - 2 THEN 'current' END AS side FROM n),
a AS (SELECT count(*) AS covered_days, count(*) FILTER (side = 'prior') AS half_days, CAST(coalesce(sum(total) FILTER (side = 'prior'), 0) AS BIGINT) AS prior_total, CAST(coalesce(sum(peer) FILTER (side = 'prior'), 0) AS BIGINT) AS prior_peer,
 CAST(coalesce(sum(total) FILTER (side = 'current'), 0) AS BIGINT) AS current_total, CAST(coalesce(sum(peer) FILTER (side = 'current'), 0) AS BIGINT) AS current_peer FROM s)
SELECT *, half_days > 0 AS available, half_days > 0 AND prior_peer + current_peer > 0 AS subject_available,
 CASE WHEN half_days > 0 THEN current_total - prior_total END AS total_delta, CASE WHEN half_days > 0 THEN current_peer - prior_peer END AS peer_delta FROM a""",
}
