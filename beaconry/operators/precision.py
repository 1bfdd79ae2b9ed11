"""Usefulness and accuracy, always with their sample sizes; rates over nothing are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = ["useful", "converted"], ["not_useful"]
ACCURACY_CHECKS = ["entity_match", "evidence_support"]
ACCOUNT_SCOPES = ["account", "parent"]


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def tall(rows: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """dimension, value and measures: per value of each dimension, and overall."""
    cells = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("overall").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dimensions))
    return rows.withColumn("_cell", F.explode(cells)).groupBy("_cell.dimension", "_cell.value").agg(*(m.alias(k) for k, m in measures.items()))


def useful_rate(feedback: DataFrame, dimensions: list[str]) -> DataFrame:
    """Useful and rated rows, and their rate, overall and by dimension."""
    rated = feedback.where(F.col("verdict").isin(POSITIVE + NEGATIVE))
    useful = F.count_if(F.col("verdict").isin(POSITIVE))
    return tall(rated, dimensions, {"useful": useful, "total": F.count("*"), "rate": rate(useful, F.count("*"))})


def auto_accuracy(audit: DataFrame, dimensions: list[str]) -> DataFrame:
    """Passed of passed and failed on the two checks that tell accuracy."""
    scored = audit.where(F.col("check_type").isin(ACCURACY_CHECKS) & F.col("result").isin("pass", "fail"))
    correct = F.count_if(F.col("result") == "pass")
    return tall(scored, dimensions, {"correct": correct, "scored": F.count("*"), "accuracy": rate(correct, F.count("*"))})


def reason_codes(feedback: DataFrame) -> DataFrame:
    """How often each reason is given with a negative verdict."""
    rows = feedback.where(F.col("verdict").isin(NEGATIVE) & (F.coalesce("reason_code", F.lit("")) != ""))
    return rows.groupBy("reason_code").agg(F.count("*").alias("count"))


def judged(audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Signals that both judge and human have seen: the judge is negative if any check failed, the human by the last verdict."""
    judge = audit.where(F.col("result").isin("pass", "fail")).groupBy("signal_id").agg(F.max((F.col("result") == "fail").cast("int")).alias("judge_negative"), F.first("source_id").alias("source_id"))
    human = feedback.where(F.col("verdict").isin(POSITIVE + NEGATIVE)).groupBy("signal_id").agg(F.max_by("verdict", F.struct("ts", "seq")).alias("verdict"))
    both = judge.join(human, "signal_id").withColumn("human_negative", F.col("verdict").isin(NEGATIVE).cast("int"))
    return both.withColumn("disagree", F.col("judge_negative") != F.col("human_negative"))


def disagreement(audit: DataFrame, feedback: DataFrame, dimensions: list[str]) -> DataFrame:
    n = F.count_if("disagree")
    return tall(judged(audit, feedback), dimensions, {"disagree": n, "comparable": F.count("*"), "rate": rate(n, F.count("*"))})


def gate_one(feedback: DataFrame, audit: DataFrame, triggers: list[str], least_rate: float = 0.6, least_accuracy: float = 0.8, least_days: int = 30, least_rated: int = 20) -> DataFrame:
    """Per primary trigger over account cards: figures, the reasons that hold the gate shut, and whether it is open."""
    own = F.col("signal_scope").isin(ACCOUNT_SCOPES) & F.col("entity_id").isNotNull() & (F.coalesce("tier", F.lit("")) != "unconfirmed_early_warning") & F.col("trigger_id").isin(triggers)
    rated = feedback.where(own & F.col("verdict").isin(POSITIVE + NEGATIVE)).groupBy("trigger_id")
    f = rated.agg(F.count("*").alias("rated"), rate(F.count_if(F.col("verdict").isin(POSITIVE)), F.count("*")).alias("useful_rate"), (F.datediff(F.max("day"), F.min("day"))).alias("span_days"))
    scored = audit.where(own & F.col("check_type").isin(ACCURACY_CHECKS) & F.col("result").isin("pass", "fail")).groupBy("trigger_id")
    a = scored.agg(F.count("*").alias("scored"), rate(F.count_if(F.col("result") == "pass"), F.count("*")).alias("accuracy"))
    every = f.join(a, "trigger_id", "full_outer").na.fill(0, ["rated", "scored", "span_days"])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rated") < least_rated, "too_few_rated"),
            F.when(F.col("span_days") < least_days, "too_short"),
            F.when(~(F.coalesce("useful_rate", F.lit(-1.0)) >= least_rate), "useful_rate"),
            F.when(~(F.coalesce("accuracy", F.lit(-1.0)) >= least_accuracy), "accuracy"),
        )
    )
    return every.withColumn("reasons", F.array_join(reasons, ",")).withColumn("open", F.col("reasons") == "")


def gate_two(feedback: DataFrame, disagreements: DataFrame, below: float = 0.4, least: int = 20, most_disagreement: float = 0.2) -> DataFrame:
    """Per source: whether to recommend a cut, and whether judge and human agree enough to say so."""
    rows = feedback.where(F.col("verdict").isin(POSITIVE + NEGATIVE)).groupBy("source_id")
    per = rows.agg(F.count("*").alias("n"), rate(F.count_if(F.col("verdict").isin(POSITIVE)), F.count("*")).alias("precision"))
    rec = per.withColumn("recommend", (F.col("n") >= least) & (F.col("precision") < below))
    by = disagreements.where("dimension = 'source_id'").select(F.col("value").alias("source_id"), "comparable", F.col("rate").alias("disagreement"))
    out = rec.join(by, "source_id", "left")
    state = F.when(F.coalesce("comparable", F.lit(0)) == 0, "na").when(F.col("comparable") < least, "below_floor").when(F.col("disagreement") > most_disagreement, "withheld").otherwise("ok")
    return out.withColumn("overlay", state)


def spot_check_target(audited: Column, share: float = 0.2, least: int = 5, most: int = 10) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(audited * share)))
