"""Precision reports over labels as feedback and documents as what was rated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import precision as ops
from ..session import table

DIMENSIONS = ["trigger_id", "source_id", "signal_scope"]


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    key = F.col("doc_id")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        key.alias("signal_id"),
        F.col("lang").alias("trigger_id"),
        F.col("source").alias("source_id"),
        F.when(key % 3 == 0, "account").when(key % 3 == 1, "parent").otherwise("sector").alias("signal_scope"),
        F.when(key % 5 == 0, "unconfirmed_early_warning").when(key % 5 == 1, "confirmed").alias("tier"),
        F.when(key % 7 != 0, key % 50).alias("entity_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int")).alias("day"),
        "quality", "toxic", "n_chars",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts a signal, a later one for every fourth."""
    rows = _rated(spark, sf_dir)
    key = F.col("signal_id")
    first = rows.withColumn("verdict", F.when(F.col("quality") == 1, F.when(key % 9 == 0, "converted").otherwise("useful")).otherwise("not_useful")).withColumn("seq", F.lit(1))
    second = rows.where(key % 4 == 0).withColumn("verdict", F.when(F.col("toxic") == 1, "not_useful").otherwise("useful")).withColumn("seq", F.lit(2))
    code = F.when(F.col("toxic") == 1, "toxic").when(key % 3 == 0, "wrong_entity").when(key % 3 == 1, "stale").otherwise("")
    return first.unionByName(second).withColumn("reason_code", F.when(F.col("verdict") == "not_useful", code)).withColumn("ts", F.col("day"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks a signal."""
    checks = F.array(
        F.struct(F.lit("entity_match").alias("check_type"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("result")),
        F.struct(F.lit("evidence_support").alias("check_type"), F.when(F.col("n_chars") < 100, "unclear").when(F.col("n_chars") < 600, "fail").otherwise("pass").alias("result")),
        F.struct(F.lit("tone").alias("check_type"), F.lit("pass").alias("result")),
    )
    return _rated(spark, sf_dir).withColumn("c", F.explode(checks)).select("*", "c.check_type", "c.result").drop("c")


def a09_useful_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Useful rate overall and by trigger, source and scope."""
    return ops.useful_rate(feedback(spark, sf_dir), DIMENSIONS)


def a10_auto_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: accuracy of the automatic checks by dimension."""
    return ops.auto_accuracy(audit(spark, sf_dir), DIMENSIONS)


def a11_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons given with negative verdicts."""
    return ops.reason_codes(feedback(spark, sf_dir))


def a12_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often judge and human disagree, overall and by source."""
    return ops.disagreement(audit(spark, sf_dir).where("check_type <> 'tone'"), feedback(spark, sf_dir), ["source_id"])


def a13_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals they disagree on."""
    rows = ops.judged(audit(spark, sf_dir).where("check_type <> 'tone'"), feedback(spark, sf_dir))
    return rows.where("disagree").select("signal_id", "judge_negative", "verdict")


def a14_gate_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account gate per trigger."""
    return ops.gate_one(feedback(spark, sf_dir), audit(spark, sf_dir), ["en", "de"])


def a15_a16_gate_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to cut, and where judge and human disagree too much to say."""
    return ops.gate_two(feedback(spark, sf_dir), a12_disagreement(spark, sf_dir), below=0.85)


def a17_spot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the signals audited in each month, how many a human reviewed, and how many should be."""
    a = audit(spark, sf_dir).select(F.date_format("day", "yyyy-MM").alias("month"), "signal_id").distinct()
    f = feedback(spark, sf_dir).where("seq = 2").select(F.date_format("day", "yyyy-MM").alias("month"), "signal_id", F.lit(1).alias("seen")).distinct()
    per = a.join(f, ["month", "signal_id"], "left").groupBy("month").agg(F.count("*").alias("audited"), F.count("seen").alias("reviewed"))
    return per.withColumn("target", ops.spot_check_target(F.col("audited")).cast("bigint")).withColumn("met", F.col("reviewed") >= F.col("target"))


def a18_w06_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 with W06: per trigger its cards, rated cards (latest feedback), useful rate and mean decay."""
    latest = feedback(spark, sf_dir).groupBy("signal_id").agg(F.max_by("verdict", F.struct("ts", "seq")).alias("verdict"))
    rows = _rated(spark, sf_dir).join(latest, "signal_id", "left")
    decay = F.pow(F.lit(0.5), F.datediff(F.lit("2024-03-01").cast("date"), "day") / 30)
    useful = F.count_if(F.col("verdict").isin(ops.POSITIVE))
    return rows.groupBy("trigger_id").agg(F.count("*").alias("cards"), F.count("verdict").alias("rated"), ops.rate(useful, F.count("verdict")).alias("useful_rate"), F.round(F.avg(decay), 6).alias("mean_decay"))


def a19_month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of one calendar month, by verdict."""
    rows = feedback(spark, sf_dir).where(F.date_trunc("month", "day") == F.lit("2024-02-01").cast("timestamp"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.max(F.last_day("day")).alias("month_end"))


def a20_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections in one tall table, each figure with its sample size."""
    f, a = feedback(spark, sf_dir), audit(spark, sf_dir)
    useful = ops.useful_rate(f, DIMENSIONS).select(F.lit("useful_rate").alias("section"), "dimension", "value", F.col("rate").alias("figure"), F.col("total").alias("n"))
    accuracy = ops.auto_accuracy(a, DIMENSIONS).select(F.lit("auto_accuracy").alias("section"), "dimension", "value", F.col("accuracy").alias("figure"), F.col("scored").alias("n"))
    return useful.unionByName(accuracy)


QUERIES = {f.__name__: f for f in (a09_useful_rate, a10_auto_accuracy, a11_reason_codes, a12_disagreement, a13_disagreements, a14_gate_one, a15_a16_gate_two, a17_spot_checks, a18_w06_half_life, a19_month_window, a20_report)}

_RATED = """rated AS (SELECT l.doc_id AS signal_id, lang AS trigger_id, source AS source_id,
  CASE l.doc_id % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'parent' ELSE 'sector' END AS signal_scope,
  CASE l.doc_id % 5 WHEN 0 THEN 'unconfirmed_early_warning' WHEN 1 THEN 'confirmed' END AS tier,
  CASE WHEN l.doc_id % 7 <> 0 THEN l.doc_id % 50 END AS entity_id, DATE '2024-01-01' + CAST(l.doc_id % 60 AS INT) AS day, quality, toxic, n_chars
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
fb0 AS (SELECT *, CASE WHEN quality = 1 THEN CASE WHEN signal_id % 9 = 0 THEN 'converted' ELSE 'useful' END ELSE 'not_useful' END AS verdict, 1 AS seq FROM rated
 UNION ALL SELECT *, CASE WHEN toxic = 1 THEN 'not_useful' ELSE 'useful' END, 2 FROM rated WHERE signal_id % 4 = 0),
feedback AS (SELECT *, CASE WHEN verdict = 'not_useful' THEN CASE WHEN toxic = 1 THEN 'toxic' WHEN signal_id % 3 = 0 THEN 'wrong_entity' WHEN signal_id % 3 = 1 THEN 'stale' ELSE '' END END AS reason_code FROM fb0),
audit AS (SELECT *, 'entity_match' AS check_type, CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS result FROM rated
 UNION ALL SELECT *, 'evidence_support', CASE WHEN n_chars < 100 THEN 'unclear' WHEN n_chars < 600 THEN 'fail' ELSE 'pass' END FROM rated
 UNION ALL SELECT *, 'tone', 'pass' FROM rated)"""


def _tall(source: str, dimensions: list[str], measures: str) -> str:
    parts = [f"SELECT 'overall' AS dimension, 'overall' AS value, {measures} FROM {source} HAVING count(*) > 0"]
    parts += [f"SELECT '{d}', coalesce(CAST({d} AS VARCHAR), 'none'), {measures} FROM {source} GROUP BY 2" for d in dimensions]
    return " UNION ALL ".join(parts)


_USEFUL = "count(*) FILTER (verdict IN ('useful', 'converted'))"
_SCORED = "scored AS (SELECT * FROM audit WHERE check_type IN ('entity_match', 'evidence_support') AND result IN ('pass', 'fail'))"
_CORRECT = "count(*) FILTER (result = 'pass')"
_JUDGED = f"""{_SCORED}, judge AS (SELECT signal_id, max((result = 'fail')::INT) AS judge_negative, any_value(source_id) AS source_id FROM scored GROUP BY signal_id),
human AS (SELECT signal_id, arg_max(verdict, (day, seq)) AS verdict FROM feedback GROUP BY signal_id),
judged AS (SELECT signal_id, source_id, judge_negative, verdict, judge_negative <> (verdict = 'not_useful')::INT AS disagree FROM judge JOIN human USING (signal_id))"""
_DISAGREE = _tall("judged", ["source_id"], "count(*) FILTER (disagree) AS disagree, count(*) AS comparable, round(count(*) FILTER (disagree) / count(*), 6) AS rate")

ORACLES = {
    "a09_useful_rate": f"WITH {_RATED} " + _tall("feedback", DIMENSIONS, f"{_USEFUL} AS useful, count(*) AS total, round({_USEFUL} / count(*), 6) AS rate"),
    "a10_auto_accuracy": f"WITH {_RATED}, {_SCORED} " + _tall("scored", DIMENSIONS, f"{_CORRECT} AS correct, count(*) AS scored, round({_CORRECT} / count(*), 6) AS accuracy"),
    "a11_reason_codes": f"WITH {_RATED} SELECT reason_code, count(*) AS count FROM feedback WHERE verdict = 'not_useful' AND reason_code <> '' GROUP BY reason_code",
    "a12_disagreement": f"WITH {_RATED}, {_JUDGED} {_DISAGREE}",
    "a13_disagreements": f"WITH {_RATED}, {_JUDGED} SELECT signal_id, judge_negative, verdict FROM judged WHERE disagree",
    "a14_gate_one": f"""WITH {_RATED}, {_SCORED},
f AS (SELECT trigger_id, count(*) AS rated, round({_USEFUL} / count(*), 6) AS useful_rate, date_diff('day', min(day), max(day)) AS span_days FROM feedback
 WHERE trigger_id IN ('en', 'de') AND signal_scope IN ('account', 'parent') AND entity_id IS NOT NULL AND coalesce(tier, '') <> 'unconfirmed_early_warning' GROUP BY trigger_id),
a AS (SELECT trigger_id, count(*) AS scored, round({_CORRECT} / count(*), 6) AS accuracy FROM scored
 WHERE trigger_id IN ('en', 'de') AND signal_scope IN ('account', 'parent') AND entity_id IS NOT NULL AND coalesce(tier, '') <> 'unconfirmed_early_warning' GROUP BY trigger_id),
j AS (SELECT trigger_id, coalesce(rated, 0) AS rated, useful_rate, coalesce(span_days, 0) AS span_days, coalesce(scored, 0) AS scored, accuracy FROM f FULL JOIN a USING (trigger_id)),
r AS (SELECT *, concat_ws(',', CASE WHEN rated < 20 THEN 'too_few_rated' END, CASE WHEN span_days < 30 THEN 'too_short' END,
 CASE WHEN NOT coalesce(useful_rate, -1) >= 0.6 THEN 'useful_rate' END, CASE WHEN NOT coalesce(accuracy, -1) >= 0.8 THEN 'accuracy' END) AS reasons FROM j)
SELECT *, reasons = '' AS open FROM r""",
    "a15_a16_gate_two": f"""WITH {_RATED}, {_JUDGED}, p AS (SELECT source_id, count(*) AS n, round({_USEFUL} / count(*), 6) AS precision FROM feedback GROUP BY source_id),
d AS (SELECT source_id, count(*) AS comparable, round(count(*) FILTER (disagree) / count(*), 6) AS disagreement FROM judged GROUP BY source_id)
SELECT p.source_id, n, precision, n >= 20 AND precision < 0.85 AS recommend, comparable, disagreement,
 CASE WHEN coalesce(comparable, 0) = 0 THEN 'na' WHEN comparable < 20 THEN 'below_floor' WHEN disagreement > 0.2 THEN 'withheld' ELSE 'ok' END AS overlay
FROM p LEFT JOIN d USING (source_id)""",
    "a17_spot_checks": f"""WITH {_RATED}, a AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month, signal_id FROM audit),
f AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month, signal_id, 1 AS seen FROM feedback WHERE seq = 2),
p AS (SELECT month, count(*) AS audited, count(seen) AS reviewed FROM a LEFT JOIN f USING (month, signal_id) GROUP BY month)
SELECT *, CAST(greatest(5, least(10, ceil(audited * 0.2e0))) AS BIGINT) AS target, reviewed >= greatest(5, least(10, ceil(audited * 0.2e0))) AS met FROM p""",
    "a18_w06_half_life": f"""WITH {_RATED}, l AS (SELECT signal_id, arg_max(verdict, (day, seq)) AS verdict FROM feedback GROUP BY signal_id)
SELECT trigger_id, count(*) AS cards, count(verdict) AS rated, round({_USEFUL} / count(verdict), 6) AS useful_rate,
 round(avg(pow(0.5e0, date_diff('day', day, DATE '2024-03-01') / 30)), 6) AS mean_decay FROM rated LEFT JOIN l USING (signal_id) GROUP BY trigger_id""",
    "a19_month_window": f"WITH {_RATED} SELECT verdict, count(*) AS n, max(last_day(day)) AS month_end FROM feedback WHERE day >= DATE '2024-02-01' AND day < DATE '2024-03-01' GROUP BY verdict",
    "a20_report": f"WITH {_RATED}, {_SCORED}, u AS ({_tall('feedback', DIMENSIONS, f'round({_USEFUL} / count(*), 6) AS figure, count(*) AS n')}), c AS ({_tall('scored', DIMENSIONS, f'round({_CORRECT} / count(*), 6) AS figure, count(*) AS n')}) SELECT 'useful_rate' AS section, * FROM u UNION ALL SELECT 'auto_accuracy', * FROM c",
}
