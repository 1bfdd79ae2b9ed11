"""Rules that turn events into candidate signals, and the bookkeeping around them.

A rule is a plain function DataFrame -> DataFrame whose output has CANDIDATE columns; it is applied with df.transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = ["raw_event_id", "trigger_id", "scope", "entity_id", "event_date", "headline", "evidence", "confidence", "order"]
INCIDENT_ITEM, OFFICER_ITEM = "1.05", "5.02"
SCOPES_WITH_ENTITY = ["account", "parent"]


def checked(candidates: DataFrame) -> DataFrame:
    """Candidates with exactly the agreed columns, in order."""
    missing = [c for c in CANDIDATE if c not in candidates.columns]
    if missing:
        raise ValueError(f"a rule's output lacks {missing}")
    return candidates.select(CANDIDATE)


def incident_filings(filings: DataFrame) -> DataFrame:
    """Filings with the incident item: the company's own card, and one for its peers."""
    both = F.array(
        F.struct(F.lit("own_incident").alias("trigger_id"), F.lit("account").alias("scope"), F.col("entity_id"), F.lit(0.9).alias("confidence"), F.lit(0).alias("order")),
        F.struct(F.lit("peer_incident").alias("trigger_id"), F.lit("sector").alias("scope"), F.lit(None).cast("bigint").alias("entity_id"), F.lit(0.8).alias("confidence"), F.lit(1).alias("order")),
    )
    rows = filings.where(F.array_contains("items", INCIDENT_ITEM)).withColumn("c", F.explode(both))
    evidence = F.array(F.concat(F.lit("Item 1.05 in "), "form"))
    return checked(rows.select("raw_event_id", "c.*", "event_date", F.concat(F.col("form"), F.lit(" reports an incident")).alias("headline"), evidence.alias("evidence")))


def is_pipeline_relevant(text: Column) -> Column:
    return F.lower(text).rlike("pipeline|lng|liquefied natural gas")


def admitted(candidates: DataFrame, triggers: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with `dropped`: null if admitted, else why not. `triggers` has trigger_id and scopes (array)."""
    rows = candidates.join(F.broadcast(triggers.select("trigger_id", "scopes")), "trigger_id", "left")
    rows = rows.join(entities.select("entity_id", F.lit(True).alias("_active")), "entity_id", "left")
    evidence = F.filter("evidence", lambda e: F.trim(F.coalesce(e, F.lit(""))) != "")
    why = (
        F.when(F.col("scopes").isNull(), "unknown_trigger")
        .when(~F.array_contains("scopes", F.col("scope")), "scope_not_allowed")
        .when(F.size(evidence) == 0, "no_evidence")
        .when(F.col("scope").isin(SCOPES_WITH_ENTITY) & F.col("entity_id").isNull(), "no_entity")
        .when(F.col("scope").isin(SCOPES_WITH_ENTITY) & F.col("_active").isNull(), "inactive_entity")
    )
    return rows.withColumn("dropped", why).drop("scopes", "_active")


def identified(candidates: DataFrame) -> DataFrame:
    """Candidates with their deterministic signal_id; of several with one id the first by order stays."""
    who = F.coalesce(F.col("entity_id").cast("string"), F.col("scope"))
    rows = candidates.withColumn("signal_id", F.concat_ws(":", "trigger_id", "raw_event_id", who))
    first = F.row_number().over(Window.partitionBy("signal_id").orderBy("order", "headline"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def evidence_rows(signals: DataFrame, rank: int, version: str) -> DataFrame:
    """One row per piece of evidence, with its place."""
    return signals.select("signal_id", F.posexplode("evidence").alias("n", "text")).withColumns({"rank": F.lit(rank), "version": F.lit(version)})


def novel_tokens(authored: Column, source: Column, vocabulary: list[str]) -> Column:
    """Tokens of three letters and more that neither the source text nor the rule's own words have; the last may be cut short."""
    tokens = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w]+"), lambda t: F.length(t) >= 3))
    known = F.array_union(tokens(source), F.array(*map(F.lit, vocabulary)))
    mine = tokens(authored)
    last = F.element_at(mine, F.greatest(F.size(mine), F.lit(1)))
    new = F.array_except(mine, known)
    return F.filter(new, lambda t: ~((t == last) & F.exists(known, lambda k: k.startswith(t))))


def texts_refreshed(state: DataFrame, candidates: DataFrame, version: str, vocabulary: list[str]) -> DataFrame:
    """Stored signals (signal_id, version, status, headline) with the headline and version of a newer rule's candidate (signal_id, headline, source).

    Dismissed rows stay, as do those whose new headline has a word that neither the source text nor the vocabulary has.
    """
    new = candidates.select("signal_id", F.col("headline").alias("_h"), F.col("source").alias("_s"))
    rows = state.join(new, "signal_id", "left")
    sound = F.size(novel_tokens(F.col("_h"), F.col("_s"), vocabulary)) == 0
    go = F.coalesce(F.col("_h").isNotNull() & ~F.col("version").eqNullSafe(F.lit(version)) & ~F.col("status").eqNullSafe(F.lit("dismissed")) & sound, F.lit(False))
    out = {"headline": F.when(go, F.col("_h")).otherwise(F.col("headline")), "version": F.when(go, version).otherwise(F.col("version"))}
    return rows.withColumns(out).drop("_h", "_s")


def merged(rows: DataFrame) -> DataFrame:
    """`rows`, to be joined by sorting and merging: for sides that grow with the input, which a broadcast would take whole through the driver."""
    return rows.hint("merge")


def reconciled(state: DataFrame, processed: DataFrame, emitted: DataFrame) -> DataFrame:
    """Statuses after a run: what its processed events no longer give is retracted, what they give again restored.

    Dismissed rows are never touched. `state` has signal_id, raw_event_id and status.
    """
    p = processed.select("raw_event_id").distinct().withColumn("_p", F.lit(True))
    e = emitted.select("signal_id").distinct().withColumn("_e", F.lit(True))
    rows = state.join(merged(p), "raw_event_id", "left").join(merged(e), "signal_id", "left")
    status = (
        F.when((F.col("status") == "retracted") & F.col("_e"), "active")
        .when(F.col("_p") & F.col("_e").isNull() & ~F.col("status").isin("dismissed", "retracted"), "retracted")
        .otherwise(F.col("status"))
    )
    return rows.withColumn("status", status).drop("_p", "_e")


def unprocessed(events: DataFrame, ledger: DataFrame, classifier: str, version: str) -> DataFrame:
    """Events that this version of this classifier hasn't seen."""
    done = ledger.where((F.col("classifier") == classifier) & (F.col("version") == version)).select("raw_event_id")
    return events.join(done, "raw_event_id", "left_anti")
