"""Identifiers looked up through registries, run bookkeeping, resolved dimensions and audited configuration edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def _first(hits: DataFrame, key: str, order: str) -> DataFrame:
    """Per key its first hit, all other columns kept."""
    rest = [c for c in hits.columns if c not in (key, order)]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("h")).select(key, *(F.col(f"h.{c}").alias(c) for c in rest))


def enriched(entities: DataFrame, ciks: DataFrame, by_cik: DataFrame, leis: DataFrame, by_lei: DataFrame) -> DataFrame:
    """entity_id, cik, lei, wikidata_qid found for entities, and `method`, the trail of registries that gave them.

    `entities` has entity_id, cik and lei, blank where unknown. `ciks` (entity_id, cik) and `leis` (entity_id, lei) are accepted
    by name; `by_cik` (cik of ten digits, qid, lei, seq) and `by_lei` (lei, qid, seq) may repeat a key, whose first hit counts.
    A found cik serves the lookup by cik; names give a lei only where neither the entity nor that lookup has one; a lei found
    without a qid is looked up last. Entities for which nothing is found give no row.
    """
    accepted = lambda df, c: _first(df.withColumn("_o", F.col(c)), "entity_id", "_o").withColumnRenamed(c, f"_{c}")
    rows = entities.select("entity_id", "cik", "lei").join(accepted(ciks, "cik"), "entity_id", "left")
    named = _blank(F.col("cik")) & F.col("_cik").isNotNull()
    known = F.coalesce("_found", F.nullif(F.trim("cik"), F.lit("")))
    rows = rows.withColumn("_found", F.when(named, F.col("_cik"))).withColumn("_key", F.when(F.length(known) < 10, F.lpad(known, 10, "0")).otherwise(known))
    hits = _first(by_cik, "cik", "seq").select(F.col("cik").alias("_key"), F.col("qid").alias("_qid"), F.nullif("lei", F.lit("")).alias("_lei_hit"), F.lit(True).alias("_hit"))
    rows = rows.join(hits, "_key", "left").join(accepted(leis, "lei"), "entity_id", "left")
    by_name = _blank(F.col("lei")) & F.col("_lei_hit").isNull() & F.col("_lei").isNotNull()
    rows = rows.withColumn("_by_name", F.when(by_name, F.col("_lei"))).withColumn("_any", F.coalesce("_lei_hit", "_by_name"))
    last = _first(by_lei, "lei", "seq").select(F.col("lei").alias("_any"), F.col("qid").alias("_last"))
    rows = rows.join(last, "_any", "left").withColumn("_late", F.when(_blank(F.col("_qid")), F.col("_last")))
    trail = F.concat_ws(
        "+",
        F.when(F.col("_found").isNotNull(), "sec_cik_lookup"),
        F.when(F.col("_hit"), "wikidata_cik"),
        F.when(F.col("_by_name").isNotNull(), "gleif_exact_name"),
        F.when(F.col("_late").isNotNull(), "wikidata_lei"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    out = rows.select("entity_id", text(F.col("_found")).alias("cik"), text(F.col("_any")).alias("lei"), text(F.coalesce("_late", "_qid")).alias("wikidata_qid"), trail.alias("method"))
    return out.where("method <> ''")


def booked(books: DataFrame, runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Bookkeeping after a batch of runs: one row a key, of a known key the batch's last row (by `order`) replaces all else."""
    rest = [c for c in books.columns if c not in keys]
    both = books.withColumn("_new", F.lit(0)).unionByName(runs.select(books.columns).withColumn("_new", F.lit(1)))
    last = both.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def with_dimensions(rows: DataFrame, signals: DataFrame, triggers: DataFrame, events: DataFrame) -> DataFrame:
    """Feedback or audit rows with their signal's dimensions, the trigger's name and the raw event's source.

    Rows without a known signal go; an unknown trigger or event leaves its column null. Every row stays its own.
    """
    s = signals.select("signal_id", "trigger_id", "raw_event_id", "signal_scope", "tier", "entity_id")
    t = triggers.select("trigger_id", F.col("name").alias("trigger_name"))
    return rows.join(s, "signal_id").join(t, "trigger_id", "left").join(events.select("raw_event_id", "source_id"), "raw_event_id", "left").drop("raw_event_id")


def edited(rows: DataFrame, seed: DataFrame, edits: DataFrame, references: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Configuration after edits, and the audit: each edit with its `outcome`.

    `rows` has the key, the fields and `origin` (seed or operator), `edits` seq, action (add, remove or reset), the key and the
    fields, `references` the key. All edits are judged against `rows`: an added key must be new (of several adds the first
    counts; else `exists`); only an operator's rows are removed, and none that is referenced (`not_operator`, `referenced`);
    a reset takes the seed's fields (`not_seed` without them). An edit of an unknown key is `unknown`, one without a key `bad_key`,
    one without a known action `bad_action`. Repeated removals and resets of a key do the same thing once.
    """
    known = rows.select(key, "origin", F.lit(True).alias("_known"))
    seeds = seed.select(key, F.struct(*fields).alias("_seed"), F.lit(True).alias("_seeded"))
    used = references.select(key).distinct().withColumn("_used", F.lit(True))
    first = edits.where("action = 'add'").groupBy(key).agg(F.min("seq").alias("_first"))
    judged = edits.join(known, key, "left").join(seeds.select(key, "_seeded"), key, "left").join(used, key, "left").join(first, key, "left")
    action, known_, own = F.col("action"), F.col("_known").isNotNull(), F.col("origin") == "operator"
    outcome = (
        F.when(F.col(key).isNull(), "bad_key")
        .when(action == "add", F.when(known_ | (F.col("seq") != F.col("_first")), "exists").otherwise("added"))
        .when(~action.isin("remove", "reset") | action.isNull(), "bad_action")
        .when(~known_, "unknown")
        .when(action == "remove", F.when(~F.coalesce(own, F.lit(False)), "not_operator").when(F.col("_used"), "referenced").otherwise("removed"))
        .otherwise(F.when(F.col("_seeded"), "reset").otherwise("not_seed"))
    )
    audit = judged.select("seq", "action", key, *fields, outcome.alias("outcome"))
    gone = audit.where("outcome = 'removed'").select(key)
    back = audit.where("outcome = 'reset'").select(key).distinct().join(seeds, key).drop("_seeded")
    kept = rows.join(gone, key, "left_anti").join(back, key, "left")
    kept = kept.select(key, *(F.when(F.col("_seed").isNotNull(), F.col(f"_seed.{c}")).otherwise(F.col(c)).alias(c) for c in fields), "origin")
    added = audit.where("outcome = 'added'").select(key, *fields, F.lit("operator").alias("origin"))
    return kept.unionByName(added), audit.select("seq", "action", key, "outcome")


def listed_edits(rows: DataFrame, edits: DataFrame, entities: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """An entity's list (its aliases or collision terms) after edits in order of seq, and the audit: each edit with its `outcome`.

    `rows` has entity_id, the value and origin (seed or operator), each pair once; `edits` seq (unique), action (add or remove), entity_id and the
    value; `entities` entity_id. An added value is trimmed, and goes to known entities only (`unknown_entity`, `blank`, `exists`, else `added`).
    Only what is there (`unknown`) and is an operator's (`not_operator`) is `removed`. Another action is `bad_action`. The audit has the value before
    and after: old_value and new_value, both null if nothing changed.
    """
    known = entities.select("entity_id").distinct().withColumn("_known", F.lit(True))
    start = rows.select("entity_id", F.col(value).alias("_v"), F.col("origin").alias("_origin"))
    e = edits.withColumn("_v", F.when(F.col("action") == "add", F.trim(F.coalesce(value, F.lit("")))).otherwise(F.col(value)))
    e = e.join(known, "entity_id", "left").join(start, ["entity_id", "_v"], "left")
    counts = ((F.col("action") == "add") & F.col("_known").isNotNull() & (F.col("_v") != "")) | (F.col("action") == "remove")
    e = e.withColumn("_does", F.when(F.coalesce(counts, F.lit(False)), F.col("action")))
    # What the last edit of the pair that counted did tells whether it is there; a seed's value is never gone.
    before = Window.partitionBy("entity_id", "_v").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_does", ignorenulls=True).over(before)
    seed = F.coalesce(F.col("_origin") == "seed", F.lit(False))
    there = seed | F.when(last.isNotNull(), last == "add").otherwise(F.col("_origin").isNotNull())
    e = e.withColumn("_there", there)
    outcome = (
        F.when(F.col("action") == "add", F.when(F.col("_known").isNull(), "unknown_entity").when(F.col("_v") == "", "blank").when(F.col("_there"), "exists").otherwise("added"))
        .when(F.col("action") == "remove", F.when(~F.col("_there"), "unknown").when(seed, "not_operator").otherwise("removed"))
        .otherwise("bad_action")
    )
    audit = e.withColumn("outcome", outcome)
    changed = audit.where("outcome in ('added', 'removed')").groupBy("entity_id", "_v").agg(F.max_by("outcome", "seq").alias("_last"))
    after = start.join(changed, ["entity_id", "_v"], "full_outer").where(F.col("_last").isNull() | (F.col("_last") == "added"))
    after = after.select("entity_id", F.col("_v").alias(value), F.when(F.col("_last").isNull(), F.col("_origin")).otherwise("operator").alias("origin"))
    told = audit.select("seq", "action", "entity_id", "outcome", F.when(F.col("outcome") == "removed", F.col("_v")).alias("old_value"), F.when(F.col("outcome") == "added", F.col("_v")).alias("new_value"))
    return after, told


def disagreement_list(judged: DataFrame, signals: DataFrame, entities: DataFrame, triggers: DataFrame, events: DataFrame) -> DataFrame:
    """What judge and human disagree on (`judged` with signal_id, judge_negative, verdict and disagree), with the card's columns, newest first.

    A signal that isn't known keeps its row, with null columns; an undated one comes last. Nothing is changed by it: someone has to look.
    """
    card = signals.select("signal_id", "headline", "event_date", "signal_scope", "status", "entity_id", "trigger_id", "raw_event_id").dropDuplicates(["signal_id"])
    rows = judged.where("disagree").select("signal_id", "judge_negative", "verdict").join(card, "signal_id", "left")
    rows = rows.join(entities.select("entity_id", F.col("name").alias("entity_name")), "entity_id", "left")
    rows = rows.join(triggers.select("trigger_id", F.col("name").alias("trigger_name")), "trigger_id", "left").join(events.select("raw_event_id", "source_id"), "raw_event_id", "left")
    columns = ["signal_id", "judge_negative", "verdict", "headline", "event_date", "signal_scope", "status", "entity_id", "entity_name", "trigger_name", "source_id"]
    return rows.select(columns).orderBy(F.desc(F.coalesce("event_date", F.lit(""))), F.desc("signal_id"))


def card_details(signals: DataFrame, evidence: DataFrame, snapshots: DataFrame, candidates: DataFrame, products: DataFrame, facts: DataFrame) -> DataFrame:
    """`signals` with `evidence` and `snapshots` as sorted arrays of structs, empty where there are none.

    `evidence` (signal_id, rank, n, raw_event_id, text, locator, version) is in order of rank, then n. `snapshots` (signal_id, play_id, fact_ids as a JSON array, made_on,
    display_text, outreach_safe_text) is in order of play_id, each with its candidate's family, path and question, its product's name (else the
    family) and its facts by id: unknown ids and unreadable lists have none, and no fact brings its price along. A snapshot whose candidate is gone is left out.
    """
    told = ["rank", "n", "raw_event_id", "text", "locator", "version"]
    said = evidence.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("evidence"))
    keys = snapshots.select("signal_id", "play_id", "fact_ids").distinct()
    ids = keys.select("signal_id", "play_id", F.explode(F.array_distinct(F.from_json("fact_ids", "array<string>"))).alias("fact_id"))
    shown = ["fact_id", "family", "segment", "source_quality", "source_url"]
    cited = ids.join(facts.select(shown), "fact_id").groupBy("signal_id", "play_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("facts"))
    none = F.array().cast(cited.schema["facts"].dataType)
    plays = snapshots.join(candidates.select("play_id", "family", "recommended_path", "discovery_question"), "play_id").join(products.select("family", "name"), "family", "left")
    plays = plays.join(cited, ["signal_id", "play_id"], "left").withColumns({"facts": F.coalesce("facts", none), "product": F.coalesce("name", "family")})
    held = ["play_id", "family", "product", "recommended_path", "discovery_question", "display_text", "outreach_safe_text", "made_on", "facts"]
    made = plays.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct(*held))).alias("snapshots"))
    out = signals.join(said, "signal_id", "left").join(made, "signal_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c, df in {"evidence": said, "snapshots": made}.items()})
