"""Decay scores, rule combinations and status changes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..functions.text import terms_absent

DECAYED_BELOW = 1.0


def weight(weights: dict[tuple[str, str], float], kind: str, key: Column) -> Column:
    """A configured weight, as a chain over the few keys of its kind; 1 where there is none."""
    out = F.lit(1.0)
    for (k, name), w in weights.items():
        if k == kind:
            out = F.when(key == name, F.lit(float(w))).otherwise(out)
    return out


def account_fit(weights: dict[tuple[str, str], float], scope: Column, entity: Column, subsector: Column, richness: Column, coverage: Column) -> Column:
    """How well a row fits an account. Calendar rows swap richness for applicability, by subsector, else the default."""
    default = weight(weights, "applicability", F.lit("default"))
    named = [name for kind, name in weights if kind == "applicability"]
    applicable = F.when(subsector.isin(named), weight(weights, "applicability", subsector)).otherwise(default) if named else default
    calendar = scope == "regulatory_calendar"
    with_entity = weight(weights, "subsector", subsector) * F.when(calendar, applicable).otherwise(weight(weights, "richness", richness)) * weight(weights, "coverage", coverage)
    return F.when(entity.isNotNull(), with_entity).when(calendar, default).otherwise(1.0)


def scored(signals: DataFrame, triggers: DataFrame, entities: DataFrame, weights: dict, now: date, combos: DataFrame | None = None) -> DataFrame:
    """Every signal with a known trigger, with its score and the factors that multiply to it.

    `weights` and `triggers` are configuration (tens of rows); `combos` has entity_id and multiplier. A
    half-life of null or zero counts as one day.
    """
    rows = signals.join(F.broadcast(triggers.select("trigger_id", "base_strength", "half_life")), "trigger_id")
    rows = rows.join(entities.select("entity_id", "subsector", "richness", "coverage_flag"), "entity_id", "left")
    if combos is not None:
        rows = rows.join(combos.select("entity_id", F.col("multiplier").alias("score_combo")), "entity_id", "left")
    else:
        rows = rows.withColumn("score_combo", F.lit(None).cast("double"))
    half = F.when(F.coalesce("half_life", F.lit(0)) == 0, 1).otherwise(F.col("half_life"))
    return rows.withColumns(
        {
            "score_base": F.col("base_strength").cast("double"),
            "score_decay": F.pow(F.lit(0.5), age_days(F.col("event_date"), now) / half),
            "score_account_fit": account_fit(weights, F.col("signal_scope"), F.col("entity_id"), F.col("subsector"), F.col("richness"), F.col("coverage_flag")),
            "score_scope_fit": weight(weights, "scope", F.col("signal_scope")),
        }
    ).withColumn("score", F.col("score_base") * F.col("score_decay") * F.col("score_account_fit") * F.col("score_scope_fit") * F.coalesce("score_combo", F.lit(1.0)))


def rescored(signals: DataFrame, *args, **options) -> DataFrame:
    """Active signals scored anew, those below the threshold decayed; all others as they are, with their stored score."""
    active = scored(signals.where("status = 'active'").drop("score"), *args, **options)
    active = active.withColumn("status", F.when(F.col("score") < DECAYED_BELOW, "decayed").otherwise("active"))
    stored = F.col("score") if "score" in signals.columns else F.lit(None).cast("double").alias("score")
    rest = signals.where("status <> 'active'").select("signal_id", "status", stored)
    return active.select("signal_id", "status", "score").unionByName(rest)


def config_token(*lines: DataFrame) -> DataFrame:
    """One row: a token of configuration lines (one string column each), whatever their order. Configuration is small."""
    every = lines[0].toDF("line")
    for x in lines[1:]:
        every = every.unionByName(x.toDF("line"))
    whole = F.concat_ws("\n", F.sort_array(F.collect_list("line")))
    return every.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("token"))


def rule_clauses(rules: DataFrame) -> DataFrame:
    """rule_id, multiplier, kind and terms of each clause of each rule that reads right; malformed rules give none."""
    parts = F.transform(F.split("logic_expr", " AND "), lambda x: F.trim(x))
    kind = lambda c: F.substring_index(c, ":", 1)
    clauses = F.transform(parts, lambda c: F.struct(kind(c).alias("kind"), F.transform(F.split(F.substring(c, F.length(kind(c)) + 2, F.length(c)), ","), lambda x: F.trim(x)).alias("terms")))
    rows = rules.withColumn("c", clauses).withColumn("mult", F.try_to_number(F.col("multiplier").cast("string"), F.lit("99999.99999")).cast("double"))
    return rows.where(~has_faults(F.col("c")) & (F.col("mult") > 0)).select("rule_id", F.col("mult").alias("multiplier"), "c")


def has_faults(clauses: Column) -> Column:
    """Unknown kinds, empty terms, an obligation other than any, two triggers, or a keyword before any trigger."""
    known = F.forall(clauses, lambda c: c["kind"].isin("trigger_any", "obligation", "not_keyword") & F.forall(c["terms"], lambda t: t != ""))
    kinds = F.transform(clauses, lambda c: c["kind"])
    at = lambda k: F.array_position(kinds, k)
    any_obligation = F.forall(clauses, lambda c: (c["kind"] != "obligation") | (F.array_join(c["terms"], ",") == "any"))
    return ~(known & any_obligation & (F.size(F.filter(kinds, lambda k: k == "trigger_any")) <= 1) & ((at("not_keyword") == 0) | ((at("trigger_any") > 0) & (at("trigger_any") < at("not_keyword")))))


def combo_multipliers(signals: DataFrame, obligated: DataFrame, rules: list[dict]) -> DataFrame:
    """entity_id and the product of the multipliers of all rules that fire for it; entities without any are absent.

    `rules` are clauses read by rule_clauses(), a handful: each is a dict of rule_id, multiplier, triggers, needs_obligation
    and absent (keywords that no matching signal's text may have). `obligated` has the entity_ids under an obligation.
    """
    active = signals.where("status = 'active' and entity_id is not null")
    flags = {}
    for i, r in enumerate(rules):
        hit = F.col("trigger_id").isin(r["triggers"]) if r["triggers"] else F.lit(True)
        flags[f"hit{i}"] = F.max(hit.cast("int"))
        clear = terms_absent(F.col("text"), r["absent"]) if r["absent"] else F.lit(True)
        flags[f"clear{i}"] = F.min(F.when(hit, clear.cast("int")).otherwise(1))
    per = active.groupBy("entity_id").agg(*(v.alias(k) for k, v in flags.items()))
    per = per.join(obligated.select("entity_id", F.lit(1).alias("obligated")).distinct(), "entity_id", "left")
    product, fired = F.lit(1.0), F.lit(False)
    for i, r in enumerate(rules):
        fires = (F.col(f"hit{i}") == 1) & (F.col(f"clear{i}") == 1)
        fires = fires & F.col("obligated").isNotNull() if r["needs_obligation"] else fires
        product, fired = product * F.when(fires, float(r["multiplier"])).otherwise(1.0), fired | fires
    return per.where(fired).select("entity_id", product.alias("multiplier"))


def superseded(signals: DataFrame, kinds: DataFrame) -> DataFrame:
    """Signals with status superseded where a later final rule of the same trigger shares a docket with an active proposal.

    `kinds` has signal_id, kind (Proposed Rule, Rule) and dockets.
    """
    rows = signals.join(kinds, "signal_id").select("signal_id", "trigger_id", "event_date", "status", "kind", F.explode("dockets").alias("docket"))
    finals = rows.where("kind = 'Rule'").groupBy("trigger_id", "docket").agg(F.max("event_date").alias("last"))
    gone = rows.where("kind = 'Proposed Rule' and status = 'active'").join(finals, ["trigger_id", "docket"]).where("last > event_date").select("signal_id").distinct()
    out = signals.join(gone.withColumn("_gone", F.lit(True)), "signal_id", "left")
    return out.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).drop("_gone")


def retiered(signals: DataFrame, edits: DataFrame, tiers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Operator changes of incident tiers: the new state, and one trail row per edit with its outcome.

    Edits (signal_id, new_tier, reason, ts) must name a known tier and an incident; equal tiers change nothing;
    raising the customer gate needs a reason. Of several edits of one signal the first by ts counts.
    """
    gate = lambda t: F.when(t == "unconfirmed_early_warning", 0).otherwise(1)
    rows = edits.join(signals.select("signal_id", F.col("tier").alias("old_tier")), "signal_id", "left")
    outcome = (
        F.when(~F.col("new_tier").isin(tiers), "unknown tier")
        .when(F.col("old_tier").isNull(), "not an incident")
        .when(F.col("old_tier") == F.col("new_tier"), "no change")
        .when((gate(F.col("new_tier")) > gate(F.col("old_tier"))) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason needed")
        .otherwise("applied")
    )
    trail = rows.withColumn("outcome", outcome)
    first = trail.where("outcome = 'applied'").groupBy("signal_id").agg(F.min_by("new_tier", F.struct("ts", "new_tier")).alias("_tier"))
    state = signals.join(first, "signal_id", "left").withColumn("tier", F.coalesce("_tier", "tier")).drop("_tier")
    return state, trail


def two_places(value: Column) -> Column:
    """Two places, halves up; what stands beyond nine places is noise of the factors' order."""
    return F.format_string("%.2f", F.round(value.cast("double"), 9))


def shown_score(score: Column) -> Column:
    """Two places at most, without idle zeros; 'unscored' if null."""
    return F.when(score.isNull(), "unscored").otherwise(F.regexp_replace(two_places(score), r"\.?0+$", ""))


def score_breakdown(rows: DataFrame) -> DataFrame:
    """`rows` (score, score_base, score_decay, score_account_fit, score_scope_fit, score_combo) with `breakdown` and `ceiling`.

    The line names the factors whose product the score is; null until the row is scored. A null combo reads 'no combo applied', never as
    a factor of one. The ceiling is the score without decay: what is unknown but for the base counts as one; null without a base and if it isn't above 0.
    """
    factors = ["score_decay", "score_account_fit", "score_scope_fit"]
    known = F.col("score").isNotNull() & F.col("score_base").isNotNull()
    for c in factors:
        known &= F.col(c).isNotNull()
    two = lambda c: two_places(F.col(c))
    line = F.concat(F.lit("score "), shown_score(F.col("score")), F.lit(" = "), shown_score(F.col("score_base")), *(x for c in factors for x in (F.lit(" × "), two(c))))
    last = F.when(F.col("score_combo").isNull(), " · no combo applied").otherwise(F.concat(F.lit(" × "), two("score_combo")))
    ceiling = F.col("score_base").cast("double")
    for c in ("score_account_fit", "score_scope_fit", "score_combo"):
        ceiling = ceiling * F.coalesce(F.col(c).cast("double"), F.lit(1.0))
    return rows.withColumns({"breakdown": F.when(known, F.concat(line, last)), "ceiling": F.when(ceiling > 0, ceiling)})
