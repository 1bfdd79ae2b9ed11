"""Obligations derived from regulatory signals, derived anew, and listed per account."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of
from . import worklists
from .derive import rule_scopes
from .rules import DOCUMENT, ENERGY_AGENCY, TRANSPORT_AGENCY, blank


class Applicability(NamedTuple):
    agency: str
    affected_scope: str
    subsectors: list[str]
    excluded: list[str]

    @property
    def rule(self) -> str:
        """The stored predicate; without exclusions it has no such clause."""
        return "subsector_in:" + ";".join(self.subsectors) + ("|exclude_entities:" + ";".join(self.excluded) if self.excluded else "")


# Whom a trigger's obligations bind.
CLASSES = {
    "nerc_cip_revision": Applicability(
        ENERGY_AGENCY,
        "NERC-registered Bulk Electric System owners and operators (registration not verified per account)",
        ["coop_distribution", "coop_gt", "coop_transmission", "federal", "federal_pma", "ipp", "iou_electric", "muni_public", "public", "renewables", "rto_iso", "state_authority", "state_owned"],
        ["E0155", "E0156", "E0158", "E0159", "E0160", "E0161", "E0164"],
    ),
    "tsa_security_directive": Applicability(
        TRANSPORT_AGENCY, "TSA-designated critical pipeline and LNG owners and operators (designation not verified per account)", ["lng", "midstream"], []
    ),
}


def _of_class(trigger: Column, classes: dict[str, Applicability], part) -> Column:
    out = F.lit(None).cast("string")
    for name, c in classes.items():
        out = F.when(trigger == name, part(c)).otherwise(out)
    return out


def considered(signals: DataFrame, documents: DataFrame, existing: DataFrame, classes: dict[str, Applicability] = CLASSES) -> DataFrame:
    """Active signals of the classes with their `outcome`: new, existing or skipped_no_clock, and what their obligation holds.

    `signals` has signal_id, raw_event_id, trigger_id, status and source_url; `documents` raw_event_id and a JSON payload. An
    obligation needs a date in effect, a title and the agency's own name in the payload.
    """
    rows = signals.where((F.col("status") == "active") & F.col("trigger_id").isin(list(classes)))
    rows = rows.join(documents.select("raw_event_id", F.from_json("payload", DOCUMENT).alias("p")), "raw_event_id", "left")
    rows = rows.withColumn("obligation_id", F.concat(F.lit("obligation:"), "signal_id")).join(existing.select("obligation_id", F.lit(True).alias("_old")), "obligation_id", "left")
    slug = _of_class(F.col("trigger_id"), classes, lambda c: c.agency)
    name = F.get_json_object(F.get(F.filter("p.agencies", lambda a: F.get_json_object(a, "$.slug") == slug), F.lit(0)), "$.name")
    whole = F.concat_ws(" ", "p.title", "p.abstract")
    out = rows.select(
        "obligation_id",
        "signal_id",
        "source_url",
        "_old",
        F.nullif(name, F.lit("")).alias("regulator"),
        F.nullif(blank(F.col("p.title")), F.lit("")).alias("rule_name"),
        F.nullif("p.effective_on", F.lit("")).alias("effective_date"),
        _of_class(F.col("trigger_id"), classes, lambda c: c.affected_scope).alias("affected_scope"),
        _of_class(F.col("trigger_id"), classes, lambda c: c.rule).alias("applicability_rule"),
        F.array_distinct(F.regexp_extract_all(whole, F.lit(r"\b(CIP-\d{3})\b"), 1)).alias("standards"),
    )
    whole_row = F.col("regulator").isNotNull() & F.col("rule_name").isNotNull() & F.col("effective_date").isNotNull()
    return out.withColumn("outcome", F.when(F.col("_old"), "existing").when(whole_row, "new").otherwise("skipped_no_clock")).drop("_old")


def derived(rows: DataFrame, products: DataFrame) -> DataFrame:
    """The new obligations of `considered` with the products (standard, place, product) of every standard they name, null for none."""
    new = rows.where("outcome = 'new'")
    mapped = worklists.mapped_products(new, products, "obligation_id", "standards").select("obligation_id", F.nullif("products", F.lit("")).alias("mapped_products"))
    return new.join(mapped, "obligation_id", "left").drop("outcome", "standards")


def rederived(obligations: DataFrame, signals: DataFrame, classes: dict[str, Applicability] = CLASSES) -> DataFrame:
    """Stored obligations with what the code alone decides derived anew, and `outcome`: rederived, unchanged or skipped (no known trigger)."""
    rows = obligations.join(signals.select("signal_id", "trigger_id"), "signal_id", "left")
    rule, scope = (_of_class(F.col("trigger_id"), classes, part) for part in (lambda c: c.rule, lambda c: c.affected_scope))
    same = rule.eqNullSafe(F.col("applicability_rule")) & scope.eqNullSafe(F.col("affected_scope"))
    rows = rows.withColumn("outcome", F.when(rule.isNull(), "skipped").when(same, "unchanged").otherwise("rederived"))
    return rows.withColumns({"applicability_rule": F.coalesce(rule, "applicability_rule"), "affected_scope": F.coalesce(scope, "affected_scope")}).drop("trigger_id")


def account_calendar(obligations: DataFrame, entities: DataFrame, names: DataFrame, today: date) -> tuple[DataFrame, DataFrame]:
    """Obligations that apply to each account (in_effect, product_names), and per account how many don't, and why.

    `obligations` has obligation_id, applicability_rule, effective_date and mapped_products; a product without a name (product,
    name) is shown by its id. The second frame has unscoped (rules that can't be read), excluded (the subsector fits, the
    account is left out) and total for every account.
    """
    ids = obligations.select("obligation_id", F.posexplode(F.filter(F.split("mapped_products", ";"), lambda x: x != "")).alias("_i", "product"))
    shown = ids.join(names.select("product", "name"), "product", "left").withColumn("name", F.coalesce("name", "product"))
    shown = shown.groupBy("obligation_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_i", "name"))).getField("name"), ";").alias("product_names"))
    scopes = rule_scopes(obligations)
    by = scopes.select("obligation_id", "excluded", F.explode(F.array_distinct("subsectors")).alias("subsector"))
    pairs = entities.select("entity_id", F.trim("subsector").alias("subsector")).join(by, "subsector")
    pairs = pairs.withColumn("_out", F.array_contains("excluded", F.col("entity_id").cast("string")))
    full = obligations.select("obligation_id", "effective_date", F.coalesce(day_of(F.col("effective_date")) <= F.lit(today), F.lit(False)).alias("in_effect"))
    rows = pairs.where("not _out").select("entity_id", "obligation_id").join(full, "obligation_id").join(shown, "obligation_id", "left")
    totals = scopes.agg(F.count_if(F.size("subsectors") <= 0).alias("unscoped"), F.count("*").alias("total"))
    out = pairs.where("_out").groupBy("entity_id").agg(F.count("*").alias("excluded"))
    counts = entities.select("entity_id").join(out, "entity_id", "left").na.fill(0, ["excluded"]).crossJoin(F.broadcast(totals))  # one row
    return rows, counts
