"""Batches of change requests, applied with an audit trail; checks that rows keep their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edited(state: DataFrame, edits: DataFrame, key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """New state and one trail row per edit (key, field, new_value, ts) with its old value and outcome.

    `rules` says for each editable field whether new_value (text) is valid. Unknown keys and fields and invalid values
    are refused, equal values change nothing; of several edits of one cell the last by ts counts.
    """
    cells = F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.col(f).cast("string") for f in rules)))
    rows = edits.join(state.select(key, cells.alias("_cells")), key, "left")
    valid = F.lit(False)
    for field, rule in rules.items():
        valid = F.when(F.col("field") == field, F.coalesce(rule, F.lit(False))).otherwise(valid)
    old = F.try_element_at("_cells", F.col("field"))
    outcome = (
        F.when(F.col("_cells").isNull(), "unknown key")
        .when(~F.col("field").isin(list(rules)), "unknown field")
        .when(~valid, "invalid value")
        .when(old.eqNullSafe(F.col("new_value")), "no change")
        .otherwise("applied")
    )
    trail = rows.withColumn("old_value", old).withColumn("outcome", outcome).drop("_cells")
    last = trail.where("outcome = 'applied'").groupBy(key).pivot("field", list(rules)).agg(F.max_by("new_value", F.struct("ts", "new_value")))
    out = state.join(last.select(key, *(F.col(f).alias(f"_n_{f}") for f in rules)), key, "left")
    types = dict(state.dtypes)
    return out.withColumns({f: F.coalesce(F.expr(f"try_cast(_n_{f} AS {types[f]})"), F.col(f)) for f in rules}).drop(*(f"_n_{f}" for f in rules)), trail


def disposed(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """A review queue after decisions (event_id, candidate, accept): every row with that event and candidate, null or not.

    Of several decisions on one, the last counts if they have a column `decided_at`, else an acceptance does.
    """
    order = F.struct("decided_at", "accept") if "decided_at" in decisions.columns else F.col("accept")
    d = decisions.groupBy(F.col("event_id").alias("_e"), F.col("candidate").alias("_c")).agg(F.max_by("accept", order).alias("accept"))
    rows = queue.join(d, (F.col("event_id") == F.col("_e")) & F.col("candidate").eqNullSafe(F.col("_c")), "left")
    return rows.withColumn("disposition", F.when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise(F.col("disposition"))).drop("_e", "_c", "accept")


def contract_violations(rows: DataFrame, needed: list[str], key: str) -> DataFrame:
    """One row per blank or missing needed field."""
    cells = F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in needed))
    return rows.select(key, F.explode(F.array_compact(cells)).alias("field"))
