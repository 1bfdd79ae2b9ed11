"""Changes and measurements over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, measure
from ..session import table
from . import roles
from .roles import SIGNALS, values


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    state = c.select("c_custkey", "c_mktsegment", "c_nationkey")
    edits = c.select(
        F.when(k % 10 == 9, -k).otherwise(k).alias("c_custkey"),
        F.when(k % 3 == 0, "c_mktsegment").when(k % 3 == 1, "c_nationkey").otherwise("c_name").alias("field"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, "BUILDING").otherwise("")).otherwise((k % 40).cast("string")).alias("new_value"),
        k.alias("ts"),
    )
    rules = {"c_mktsegment": F.col("new_value") != "", "c_nationkey": F.expr("try_cast(new_value AS int)").between(0, 24)}
    return changes.edited(state, edits, "c_custkey", rules)


def e01_q07_edited_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after a batch of edits."""
    return _edits(spark, sf_dir)[0]


def e01_q07_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits' trail by field and outcome."""
    return _edits(spark, sf_dir)[1].groupBy("field", "outcome").agg(F.count("*").alias("n"))


def e08_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a review queue after decisions, with null candidates among them."""
    e = table(spark, sf_dir, "events")
    queue = e.select(F.col("event_id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("candidate"), F.lit("pending").alias("disposition"))
    decisions = e.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("candidate"), (F.col("event_id") % 3 == 0).alias("accept"))
    return changes.disposed(queue, decisions)


def q06_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q06: blank or missing fields of every seventh signal; `q06_all_signals` checks all, and the whole contract."""
    return changes.contract_violations(roles.signals(spark, sf_dir).where("seq % 7 = 0"), ["headline", "signal_scope", "tier", "entity_id"], "signal_id")


def q06_all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q06: blank or missing fields that every signal must carry: url, headline, snippet, scope, trigger and quality (tier)."""
    s, k = roles.signals(spark, sf_dir), F.col("seq")
    cells = {"url": F.when(k % 10 != 0, F.format_string("http://o/%d", k)), "snippet": F.when(k % 13 != 0, F.col("raw_event_id")).otherwise(" ")}
    return changes.contract_violations(s.withColumns(cells), ["url", "headline", "snippet", "signal_scope", "trigger_id", "tier"], "signal_id")


def a22_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as goldens that pin two checks, against labels as verdicts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("golden_id"), F.create_map(F.lit("quality"), F.lit("1"), F.lit("toxic"), F.lit("0")).alias("expected"))
    lab = table(spark, sf_dir, "labels").where("doc_id % 9 <> 0 or quality = 1")
    cells = F.array(F.struct(F.lit("quality").alias("check_type"), F.col("quality").cast("string").alias("result")), F.struct(F.lit("toxic").alias("check_type"), F.col("toxic").cast("string").alias("result")))
    verdicts = lab.select(F.col("doc_id").alias("golden_id"), F.explode(cells).alias("c")).select("golden_id", "c.*")
    return measure.goldens_met(d, verdicts)


def a23_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How wordy documents of each language are."""
    return measure.richness(table(spark, sf_dir, "documents"), "lang", "text", 60)


PRICES = [("en", "1995-01-01", 3.0, 15.0), ("en", "2024-01-15", 1.0, 5.0), ("de", "2024-01-10", 2.0, 8.0)]


def a27_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judging documents costs at each day's price; without a price in force none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    calls = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), day.alias("day"), F.col("n_chars").alias("chars"), F.lit(500).alias("max_out"))
    prices = spark.createDataFrame(PRICES, "model string, start string, per_million_in double, per_million_out double").withColumn("start", F.col("start").cast("date"))
    return measure.price_at(calls, prices).select("doc_id", "cost")


BOXES = [("west", 0.0, 0.0, 40.0, 50.0), ("west_coast", 0.0, 10.0, 9.0, 30.0), ("east", 35.0, 0.0, 80.0, 60.0)]


def j33_j34_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at places made of their keys, by the smallest region around them: how many, and their signals."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    points = c.select(k.alias("entity_id"), (k % 97).cast("double").alias("x"), (k % 61).cast("double").alias("y"))
    at = measure.located(points, spark.createDataFrame(BOXES, "region string, x0 double, y0 double, x1 double, y1 double"))
    counts = roles.signals(spark, sf_dir).where("status = 'active'").groupBy("entity_id").agg(F.count("*").alias("n"))
    return at.join(counts, "entity_id", "left").groupBy("region").agg(F.count("*").alias("owners"), F.coalesce(F.sum("n"), F.lit(0)).alias("signals"))


def j17_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist terms in part names, the longer before the shorter."""
    titles = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("  and "), F.initcap("p_name")).alias("title"))
    return measure.term_hits(titles, "p_partkey", "title", ["blue", "blue anvil", "ring", "red widget"]).select("p_partkey", F.array_join("terms", ",").alias("terms"))


QUERIES = {f.__name__: f for f in (e01_q07_edited_state, e01_q07_trail, e08_triage, q06_all_signals, a22_goldens, a23_richness, a27_cost, j33_j34_regions, j17_term_hits)}

_EDITS = """e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 9 THEN -c_custkey ELSE c_custkey END AS key, CASE c_custkey % 3 WHEN 0 THEN 'c_mktsegment' WHEN 1 THEN 'c_nationkey' ELSE 'c_name' END AS field,
 CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE '' END ELSE CAST(c_custkey % 40 AS VARCHAR) END AS v, c_mktsegment, c_nationkey FROM customer),
o AS (SELECT *, CASE WHEN key < 0 THEN 'unknown key' WHEN field = 'c_name' THEN 'unknown field' WHEN field = 'c_mktsegment' AND v = '' THEN 'invalid value' WHEN field = 'c_nationkey' AND CAST(v AS INT) > 24 THEN 'invalid value'
 WHEN v = CASE WHEN field = 'c_mktsegment' THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END THEN 'no change' ELSE 'applied' END AS outcome
 FROM (SELECT k, key, field, CASE WHEN field = 'c_name' THEN '' ELSE v END AS v, c_mktsegment, c_nationkey FROM e))"""

ORACLES = {
    "e01_q07_edited_state": f"""WITH {_EDITS} SELECT k AS c_custkey, CASE WHEN outcome = 'applied' AND field = 'c_mktsegment' THEN v ELSE c_mktsegment END AS c_mktsegment,
 CASE WHEN outcome = 'applied' AND field = 'c_nationkey' THEN CAST(v AS INT) ELSE c_nationkey END AS c_nationkey FROM o""",
    "e01_q07_trail": f"WITH {_EDITS} SELECT field, outcome, count(*) AS n FROM o GROUP BY ALL",
    "e08_triage": """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS candidate, CASE WHEN event_id % 2 <> 0 THEN 'pending' WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS disposition FROM events""",
    "q06_all_signals": f"""WITH {SIGNALS}, c AS (SELECT signal_id, unnest([CASE WHEN seq % 10 = 0 THEN 'url' END, CASE WHEN trim(coalesce(headline, '')) = '' THEN 'headline' END, CASE WHEN seq % 13 = 0 THEN 'snippet' END,
 CASE WHEN trim(coalesce(signal_scope, '')) = '' THEN 'signal_scope' END, CASE WHEN trim(coalesce(trigger_id, '')) = '' THEN 'trigger_id' END, CASE WHEN tier IS NULL THEN 'tier' END]) AS field FROM signals)
SELECT signal_id, field FROM c WHERE field IS NOT NULL""",
    "a22_goldens": """SELECT d.doc_id AS golden_id, coalesce(l.quality = 1 AND l.toxic = 0, false) AS met, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 0 END AS errors
FROM documents d LEFT JOIN (SELECT * FROM labels WHERE doc_id % 9 <> 0 OR quality = 1) l ON d.doc_id = l.doc_id""",
    "a23_richness": r"""WITH n AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT lang, count(*) AS rows, round(avg(n), 6) AS mean_words, median(n) AS median_words, round(count(*) FILTER (n < 60) / count(*), 6) AS short_share FROM n GROUP BY lang""",
    "a27_cost": f"""WITH c AS (SELECT doc_id, lang, n_chars, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS day FROM documents), p (model, start, i, o) AS ({values(PRICES)}),
m AS (SELECT doc_id, arg_max(i, CAST(start AS DATE)) AS i, arg_max(o, CAST(start AS DATE)) AS o FROM c JOIN p ON model = lang AND CAST(start AS DATE) <= day GROUP BY doc_id)
SELECT c.doc_id, round((n_chars / 4 * i + 500 * o) / 1e6, 9) AS cost FROM c LEFT JOIN m ON c.doc_id = m.doc_id""",
    "j33_j34_regions": f"""WITH {SIGNALS}, b (region, x0, y0, x1, y1) AS ({values(BOXES)}), p AS (SELECT c_custkey AS id, c_custkey % 97 AS x, c_custkey % 61 AS y FROM customer),
l AS (SELECT id, arg_min(region, (x1 - x0) * (y1 - y0)) AS region FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id),
n AS (SELECT entity_id, count(*) AS n FROM signals WHERE status = 'active' GROUP BY entity_id)
SELECT region, count(*) AS owners, CAST(coalesce(sum(n), 0) AS BIGINT) AS signals FROM l LEFT JOIN n ON id = entity_id GROUP BY region""",
    "j17_term_hits": """WITH t AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_name = 'blue anvil' THEN 'blue anvil' WHEN starts_with(p_name, 'blue ') THEN 'blue' WHEN p_name = 'red widget' THEN 'red widget' END,
 CASE WHEN ends_with(p_name, ' ring') THEN 'ring' END], lambda x: x IS NOT NULL), ',') AS terms FROM part) SELECT * FROM t WHERE terms <> ''""",
}
