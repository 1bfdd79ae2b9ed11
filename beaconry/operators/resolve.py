"""Entity resolution: identifiers, collision guard, exact names, then fuzzy names with lossless blocking.

All joins are by key; Spark broadcasts a side only if its statistics are below its own limit.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.text import normalized_name
from ..session import checkpointed

REVIEW, MATCH = 0.75, 0.90
NEAREST_NAMES = 8
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of a to b; not symmetric."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def names_of(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id and term: normalised names and aliases of active entities, each once, none blank."""
    both = entities.select("entity_id", "name").unionByName(aliases.select("entity_id", F.col("alias").alias("name")).join(entities.select("entity_id"), "entity_id", "left_semi"))
    return both.select("entity_id", normalized_name(F.col("name")).alias("term")).where("term <> ''").distinct()


def by_identifier(events: DataFrame, entities: DataFrame) -> DataFrame:
    """event_id, entity_id and method for events whose cik, ticker or lei is known, tried in that order.

    Leading zeros of a cik and the letter case of a ticker don't matter; of entities that share one the largest id counts.
    """
    keys = {
        "cik": (F.regexp_replace(F.trim("cik"), "^0+", ""), F.regexp_replace(F.trim("cik"), "^0+", "")),
        "ticker": (F.upper(F.trim("ticker")), F.upper(F.trim("ticker"))),
        "lei": (F.trim("lei"), F.trim("lei")),
    }
    rows = events.select("event_id", *(F.nullif(event, F.lit("")).alias(k) for k, (event, _) in keys.items()))
    found = []
    for k, (_, own) in keys.items():
        dim = entities.select(F.nullif(own, F.lit("")).alias(k), "entity_id").where(F.col(k).isNotNull()).groupBy(k).agg(F.max("entity_id").alias(f"by_{k}"))
        rows = rows.join(dim, k, "left")
        found.append(F.when(F.col(f"by_{k}").isNotNull(), F.struct(F.col(f"by_{k}").alias("entity_id"), F.lit(k).alias("method"))))
    return rows.withColumn("hit", F.coalesce(*found)).where("hit is not null").select("event_id", "hit.entity_id", "hit.method")


def _with_context(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """For (event_id, n, context, entity_id): the smallest other term of the entity that the context contains."""
    other = terms.select("entity_id", F.col("term").alias("other"))
    inside = (F.col("context") != "") & (F.col("other") != F.col("n")) & F.col("context").contains(F.col("other"))
    joined = rows.join(other, "entity_id", "left").withColumn("seen", F.when(inside, F.col("other")))
    return joined.groupBy("event_id", "entity_id").agg(F.min("seen").alias("confirmed_by"))


def _decide(rows: DataFrame, terms: DataFrame, unclear: str, single: bool) -> DataFrame:
    """One row per event over its candidate entities, by what the context confirms."""
    per = _with_context(rows, terms).groupBy("event_id").agg(
        F.count("*").alias("n"),
        F.count("confirmed_by").alias("sure"),
        F.min("entity_id").alias("only"),
        F.min(F.when(F.col("confirmed_by").isNotNull(), F.col("entity_id"))).alias("entity"),
        F.array_sort(F.collect_list("entity_id")).alias("every"),
        F.array_sort(F.collect_list(F.when(F.col("confirmed_by").isNotNull(), F.col("entity_id")))).alias("confirmed"),
    )
    exact = (F.col("n") == 1) if single else F.lit(False)
    one, many = F.col("sure") == 1, F.col("sure") > 1
    return per.select(
        "event_id",
        F.when(exact | one, "matched").otherwise("review").alias("status"),
        F.when(exact, F.col("only")).when(one, F.col("entity")).alias("entity_id"),
        F.when(exact, "name").when(one, "name+context").when(many, "ambiguous_context").otherwise(unclear).alias("method"),
        F.when(exact, 1.0).when(one, 0.95).otherwise(REVIEW).alias("confidence"),
        F.when(exact, F.array("only")).when(one, F.array("entity")).when(many, F.col("confirmed")).otherwise(F.col("every")).alias("candidates"),
    )


def letter_counts(text: Column) -> Column:
    """How often each letter, digit and blank occurs; other signs are counted together."""
    own = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in ALPHABET]
    rest = F.length(F.translate(text, ALPHABET, ""))
    return F.array(*own, rest)


def fuzzy(names: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per name n: the best of the eight nearest terms by entity, matched or for review.

    Two exact upper bounds of the ratio, by lengths and by shared letters, decide which pairs are compared at all, and names are
    joined by length bands, so a name meets only terms of a length that could reach the cut.
    """
    a = names.select("n").distinct().select("n", F.length("n").alias("la"), letter_counts(F.col("n")).alias("ca"))
    b = terms.select("term").distinct().select("term", F.length("term").alias("lb"), letter_counts(F.col("term")).alias("cb"))
    # 2 min / (la + lb) >= 0.75 means 0.6 la <= lb <= la / 0.6.
    lengths = F.sequence(F.ceil(F.col("la") * REVIEW / (2 - REVIEW)).cast("int"), F.floor(F.col("la") * (2 - REVIEW) / REVIEW).cast("int"))
    pairs = a.withColumn("lb", F.explode(lengths)).join(b, "lb")
    shared = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = pairs.where(2 * shared >= REVIEW * (F.col("la") + F.col("lb"))).withColumn("back", ratio("term", "n")).where(F.col("back") >= REVIEW)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("back"), F.desc("term")))).where(F.col("r") <= NEAREST_NAMES)
    per = top.withColumn("score", ratio("n", "term")).join(terms, "term").groupBy("n", "entity_id").agg(F.max("score").alias("score")).where("score > 0")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("entity_id").alias("e"))))
    out = per.groupBy("n").agg(best.alias("b"))
    first, second = -F.get("b", 0)["s"], -F.get("b", 1)["s"]
    sure = (first >= MATCH) & ~F.coalesce(second >= MATCH, F.lit(False))
    return out.select(
        "n",
        F.when(sure, "matched").otherwise("review").alias("status"),
        F.when(sure, F.get("b", 0)["e"]).alias("entity_id"),
        F.when(sure, "fuzzy").otherwise("fuzzy_below_threshold").alias("method"),
        F.round(first, 4).alias("confidence"),
        F.when(sure, F.array(F.get("b", 0)["e"])).otherwise(F.transform("b", lambda x: x["e"])).alias("candidates"),
    )


def resolved(events: DataFrame, entities: DataFrame, aliases: DataFrame, collisions: DataFrame) -> DataFrame:
    """One row per event: status (matched, review, none), entity_id, method, confidence and candidates.

    `events` has event_id, cik, ticker, lei, name and context; `entities` entity_id, name, cik, ticker, lei, and maybe active: those that aren't
    (false or null) take no part. Each step sees only
    what the one before left: identifiers, terms that collide, exact names, fuzzy names. Fuzzy names are resolved once each.
    """
    entities = entities.where("active") if "active" in entities.columns else entities
    terms = names_of(entities, aliases)
    guard = collisions.join(entities.select("entity_id"), "entity_id", "left_semi").select("entity_id", normalized_name(F.col("term")).alias("term")).where("term <> ''").distinct()
    known = by_identifier(events, entities)
    first = known.select("event_id", F.lit("matched").alias("status"), "entity_id", "method", F.lit(1.0).alias("confidence"), F.array("entity_id").alias("candidates"))
    rest = events.join(known.select("event_id"), "event_id", "left_anti").select("event_id", normalized_name(F.col("name")).alias("n"), normalized_name(F.col("context")).alias("context"))
    named = rest.where("n <> ''")
    colliding = named.join(guard, named["n"] == guard["term"]).select("event_id", "n", "context", "entity_id")
    second = _decide(colliding, terms, "collision_term", single=False)
    free = named.join(guard.select("term").distinct(), F.col("n") == F.col("term"), "left_anti")
    exact = free.join(terms, free["n"] == terms["term"]).select("event_id", "n", "context", "entity_id")
    third = _decide(exact, terms, "ambiguous_name", single=True)
    unknown = free.join(terms.select("term").distinct(), F.col("n") == F.col("term"), "left_anti").select("event_id", "n")
    fourth = unknown.join(fuzzy(unknown, terms), "n").drop("n")
    found = first.unionByName(second).unionByName(third).unionByName(fourth.select(first.columns))
    return events.select("event_id").join(found, "event_id", "left").withColumns({"status": F.coalesce("status", F.lit("none")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def review_rows(resolutions: DataFrame) -> DataFrame:
    """One row per candidate of what needs a reviewer."""
    return resolutions.where("status = 'review'").select("event_id", F.explode("candidates").alias("candidate"), F.col("method").alias("reason"), "confidence")


def rolled_up(entities: DataFrame, edges: DataFrame, steps: int = 1) -> DataFrame:
    """entity_id and top: the uppermost active ancestor. The first parent by id counts, else the entity's own hint.

    The way up stops at a parent that isn't in `entities`, and in a cycle at its first node that is met: an entity in a cycle is its own
    top. Pointers are doubled, so a way of n steps takes some log2(n) rounds, checkpointed every `steps`; entities that have arrived rest.
    """
    parents = edges.groupBy(F.col("child").alias("entity_id")).agg(F.min("parent").alias("edge"))
    up = entities.join(parents, "entity_id", "left").select("entity_id", F.coalesce("edge", "parent_id").alias("to"))
    up = up.join(entities.select(F.col("entity_id").alias("to")).distinct(), "to", "left_semi").select("entity_id", "to").dropDuplicates(["entity_id"])
    nodes = entities.select("entity_id").distinct()
    n = nodes.count()
    start = checkpointed(nodes.join(up, "entity_id", "left").select("entity_id", F.coalesce("to", "entity_id").alias("to"), F.col("to").isNull().alias("done")))
    tops = _doubled(start, n, steps)
    lost = tops.where("not done")
    if lost.isEmpty():
        return tops.select("entity_id", F.col("to").alias("top"))
    # After n steps and more only nodes of cycles are pointed to. They are tops themselves, and those that lead to them stop there.
    cycles = checkpointed(lost.select(F.col("to").alias("entity_id")).distinct().withColumn("_c", F.lit(True)))
    again = start.join(cycles, "entity_id", "left")
    again = again.select("entity_id", F.when(F.col("_c"), F.col("entity_id")).otherwise(F.col("to")).alias("to"), (F.col("done") | F.coalesce("_c", F.lit(False))).alias("done"))
    return _doubled(checkpointed(again), n, steps).select("entity_id", F.col("to").alias("top"))


def _doubled(start: DataFrame, n: int, steps: int) -> DataFrame:
    """Pointers (entity_id, to, done) after doubling until all are done, or for so many rounds that n steps are passed. Done nodes point to themselves at first."""
    rows = start
    for k in range(1, n.bit_length() + 2):
        active = rows.where("not done")
        if active.isEmpty():
            break
        there = rows.select(F.col("entity_id").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        moved = active.select("entity_id", "to").join(there, "to").select("entity_id", F.col("_to").alias("to"), F.col("_done").alias("done"))
        rows = rows.where("done").unionByName(moved)
        rows = rows if k % steps else checkpointed(rows)
    return checkpointed(rows)


def decision_log(resolutions: DataFrame, events: DataFrame, version: str, decided_by: str, ts: str) -> DataFrame:
    """One row per matched event as it was decided: event_id, entity_id, method, confidence, matched_terms, rejected_terms, decision, decided_by, ts and version.

    matched_terms is a JSON array of what was matched: the identifier as the event has it, else the normalised name. No terms are rejected
    by a match, so rejected_terms is empty. What needs review or found nobody isn't decided and has no row.
    """
    own = events.select("event_id", *(F.trim(c).alias(f"_{c}") for c in ("cik", "ticker", "lei")), normalized_name(F.col("name")).alias("_name"))
    rows = resolutions.where("status = 'matched'").join(own, "event_id")
    term = F.col("_name")
    for c in ("cik", "ticker", "lei"):
        term = F.when(F.col("method") == c, F.col(f"_{c}")).otherwise(term)
    return rows.select(
        "event_id", "entity_id", "method", "confidence", F.to_json(F.array(term)).alias("matched_terms"), F.lit("[]").alias("rejected_terms"),
        F.lit("auto").alias("decision"), F.lit(decided_by).alias("decided_by"), F.lit(ts).alias("ts"), F.lit(version).alias("version"),
    )
