"""The operators as registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, hard_negatives, mixing, near_dedup, phrases, quality, sharding, token_records, toxicity, url_filter, vectors, warc
from .common import table

SHARDS = 8
MIX_EXPONENT = 0.9

RULES = [
    url_filter.Rule("org", "/", False),
    url_filter.Rule("example.org", "/es/", True),
    url_filter.Rule("example.org", "/en/1", True),
    url_filter.Rule("com", "/fr/", False),
    url_filter.Rule("com", "/de/", True),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wu-Manber search of all documents for all benchmark windows of 13 words."""
    out, name = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = F.col(name)
    return out.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        decontaminate.n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(found).alias("contaminated"),
    )


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a WARC record per page in Zstandard archives and reads all of them back."""
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizes all documents into checksummed records with an offset index and reads the records back."""
    import public_tokenizers

    return token_records.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's five nearest among all others, by balanced posting lists."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(rows, rows.where("vec_id % 50 = 0"), k=5)


def op5_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents for toxicity after a noisy channel has restored disguised words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups all documents whose sets of two-word shingles are 0.8 alike or more."""
    return near_dedup.grouped(table(spark, sf_dir, "documents"), k=2, threshold=80)


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all page urls by the rules, held in a Bloom filter cascade."""
    out = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules all documents so that sources, weighted by their size to the power 0.9, interleave by Pfair."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mixed(docs, mixing.temperature_weights(docs, MIX_EXPONENT)).drop("n_chars")


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a linear scorer trained on the posteriors of weak labellers."""
    out, name = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(name).alias("score"), (F.col(name) >= 0.5).alias("kept"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into eight shards by a consistent-hash ring whose shards take no more rows than the mean."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op11_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts by locally consistent parsing."""
    return phrases.fingerprinted(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters interact in all 120 orders, from a stream over all files of the documents."""
    docs, labels = filter_audit.streamed(spark, f"{sf_dir}/documents.parquet"), table(spark, sf_dir, "labels")
    return filter_audit.audited(docs, labels, texts=table(spark, sf_dir, "documents").count())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all others, scored exactly by subset-sum tables."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_token_records": op3_token_records,
    "op4_posting_lists": op4_posting_lists,
    "op5_deobfuscated_toxicity": op5_deobfuscated_toxicity,
    "op6_url_cascade": op6_url_cascade,
    "op7_bbit_minhash": op7_bbit_minhash,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_weak_quality": op9_weak_quality,
    "op10_bounded_ring": op10_bounded_ring,
    "op11_phrase_fingerprints": op11_phrase_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS k
      FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, p.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos) p
        JOIN win ON win.k = p.k AND win.g = p.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op7_bbit_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
        UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT pairs.b, r.c FROM r JOIN pairs ON r.d = pairs.a WHERE r.c < pairs.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(c) AS c FROM r GROUP BY d) USING (doc_id)""",
    "op6_url_cascade": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
v AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r (rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM v JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN m USING (page_id)""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS m
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, m, count(*) AS n FROM f GROUP BY ALL),
x (a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
e AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
y AS (SELECT part, filter_order, step, good, toxic, n, m[filter_order[step]] AS fails,
             len([z FOR z IN string_split(filter_order[1:step - 1], '') IF m[z]]) > 0 AS gone,
             len([z FOR z IN map_values(m) IF z]) AS many
      FROM c, e),
g AS (SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM y GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM g""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10""",
}
