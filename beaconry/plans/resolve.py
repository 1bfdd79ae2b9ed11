"""Names resolved against a watchlist made of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized_name
from ..operators import resolve as ops
from ..session import table


def _watchlist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands with one part name each as entities, a second one as alias, and a few names as collisions."""
    parts = table(spark, sf_dir, "part")
    entities = parts.groupBy("p_brand").agg(F.min("p_name").alias("name"), F.max("p_name").alias("alias"), F.min("p_partkey").alias("key"))
    entities = entities.select(F.col("p_brand").alias("entity_id"), F.concat("name", F.lit(" Holdings, Inc.")).alias("name"), "alias", F.lpad(F.col("key").cast("string"), 10, "0").alias("cik"), F.upper("p_brand").alias("ticker"), F.lit("").alias("lei"))
    aliases = entities.select("entity_id", "alias")
    collisions = entities.where(F.col("entity_id").endswith("7")).select("entity_id", F.col("alias").alias("term"))
    return entities.drop("alias"), aliases, collisions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    typo = F.regexp_replace("p_name", "(..)$", "$1e")
    name = F.when(key % 5 == 0, typo).when(key % 5 == 1, F.concat(F.upper("p_name"), F.lit(" CORP."))).when(key % 11 == 0, "").otherwise(F.col("p_name"))
    return parts.select(
        key.alias("event_id"),
        F.when(key % 7 == 0, key.cast("string")).alias("cik"),
        F.when(key % 13 == 0, F.lower("p_brand")).alias("ticker"),
        F.lit(None).cast("string").alias("lei"),
        name.alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("the "), F.col("p_name"), F.lit(" & blue anvil; small ring"))).alias("context"),
    )


def j07_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's disguised name through the whole cascade. Held against plain code in the tests."""
    out = ops.resolved(_events(spark, sf_dir), *_watchlist(spark, sf_dir))
    return out.select("event_id", "status", "entity_id", "method", "confidence", F.array_join("candidates", ",").alias("candidates"))


def j08_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left for a reviewer, one row per candidate."""
    return ops.review_rows(ops.resolved(_events(spark, sf_dir), *_watchlist(spark, sf_dir)))


def j08_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what was decided, one row per matched event. Held against known events in the tests."""
    events = _events(spark, sf_dir)
    return ops.decision_log(ops.resolved(events, *_watchlist(spark, sf_dir)), events, "1.0", "classification", "2024-01-01T00:00:00Z")


def j02_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events known by cik or ticker."""
    return ops.by_identifier(_events(spark, sf_dir), _watchlist(spark, sf_dir)[0])


def p01_normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names of all customers and parts, with corporate words added."""
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" & Sons Co., Ltd.")).alias("name"))
    names = names.unionByName(table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" Group")).alias("name"))).unionByName(table(spark, sf_dir, "nation").select(F.lit("Holdings Group, LLC").alias("name")))
    return names.select(normalized_name(F.col("name")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def j10_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer rolled up over edges key -> key / 3, with a cycle among the first and gaps in the watchlist."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("entity_id"), F.lit(None).cast("bigint").alias("parent_id"))
    edges = rows.select(F.col("entity_id").alias("child"), F.floor(F.col("entity_id") / 3).alias("parent")).where("child > 3")
    return ops.rolled_up(rows, edges)


def j15_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' market segments and part names that share a word of four letters or more, most shared first."""
    a = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("w")).where(F.length("w") >= 4)
    pairs = a.alias("x").join(a.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.p_name") < F.col("y.p_name")))
    return pairs.groupBy(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b")).agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_set("x.w")), ",").alias("words"))


QUERIES = {f.__name__: f for f in (j07_resolve_names, j08_review_rows, j08_decisions, j02_identifiers, p01_normalized_names, j10_rollup, j15_token_overlap)}

ORACLES = {
    "j02_identifiers": """WITH w AS (SELECT p_brand AS entity_id, min(p_partkey) AS key FROM part GROUP BY p_brand)
SELECT p_partkey AS event_id, coalesce(c.entity_id, p_brand) AS entity_id, CASE WHEN c.entity_id IS NOT NULL THEN 'cik' ELSE 'ticker' END AS method
FROM part LEFT JOIN w c ON p_partkey % 7 = 0 AND c.key = p_partkey AND p_partkey > 0 WHERE c.entity_id IS NOT NULL OR p_partkey % 13 = 0""",
    "p01_normalized_names": r"""WITH n AS (SELECT 'The ' || p_name || ' & Sons Co., Ltd.' AS name FROM part UNION ALL SELECT c_name || ' Group' FROM customer UNION ALL SELECT 'Holdings Group, LLC' FROM nation),
s AS (SELECT trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM n)
SELECT trim(regexp_replace(name, '((^|\s)(inc|incorporated|corp|corporation|co|company|llc|llp|lp|plc|ltd|limited|holdings|holding|group))+$', '')) AS name, count(*) AS n FROM s GROUP BY 1""",
    "j10_rollup": """WITH RECURSIVE e AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 9),
up AS (SELECT id, id // 3 AS p FROM e WHERE id > 3 AND id // 3 IN (SELECT id FROM e)),
r AS (SELECT id AS entity_id, id AS top, 0 AS d FROM e UNION ALL SELECT entity_id, up.p, d + 1 FROM r JOIN up ON r.top = up.id WHERE d < 10)
SELECT entity_id, arg_max(top, d) AS top FROM r GROUP BY entity_id""",
    "j15_token_overlap": """WITH a AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM part), b AS (SELECT * FROM a WHERE length(w) >= 4)
SELECT x.p_name AS a, y.p_name AS b, count(*) AS shared, string_agg(DISTINCT x.w, ',' ORDER BY x.w) AS words FROM b x JOIN b y ON x.w = y.w AND x.p_name < y.p_name GROUP BY ALL""",
}
