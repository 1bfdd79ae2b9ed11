"""Work lists, identifier acceptance, provenance and source measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(name: Column) -> Column:
    """A name for exact comparison: lower case, marks as blanks, blanks squeezed."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def once(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by `order` of each key that `existing` doesn't have yet. Rows with a null key are left out."""
    new = rows.where(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r"))
    return first.select(key, "_r.*").select(rows.columns)


def unique_ids(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """entity_id and id where the entity's terms meet exactly one id of the registry (name, id), by plain names."""
    t = terms.select("entity_id", plain(F.col("term")).alias("_n")).where("_n <> ''").distinct()
    hits = t.join(registry.select(plain(F.col("name")).alias("_n"), "id"), "_n").groupBy("entity_id")
    return hits.agg(F.min("id").alias("id"), F.max("id").alias("_m")).where(F.col("id") == F.col("_m")).select("entity_id", "id")


def accepted(candidates: DataFrame, terms: DataFrame, country: str) -> DataFrame:
    """entity_id and the id of its first candidate (by `place`) of the country whose plain name is one of the entity's terms."""
    t = terms.select("entity_id", plain(F.col("term")).alias("_n")).distinct()
    fits = candidates.where(F.col("country") == country).withColumn("_n", plain(F.col("name"))).join(t, ["entity_id", "_n"])
    return fits.groupBy("entity_id").agg(F.min_by("id", F.struct("place", "id")).alias("id"))


def internal_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Parent edges (child, parent by external id) whose ends are both known, without self edges, as entity ids."""
    ends = lambda name: entities.select(F.col("lei").alias(name), F.col("entity_id").alias(f"{name}_id"))
    both = edges.join(ends("child"), "child").join(ends("parent"), "parent")
    return both.where("child_id <> parent_id").select("child_id", "parent_id").distinct()


def shape_scan(names: DataFrame, name: str, vocabulary: list[str]) -> DataFrame:
    """Names that hold words of a short, fixed vocabulary, with the words found, in its order."""
    found = F.array_compact(F.array(*(F.when(F.col(name).rlike(rf"(?iU)\b\Q{w}\E\b"), w) for w in vocabulary)))
    return names.withColumn("shapes", found).where(F.size("shapes") > 0)


def owned_facilities(facilities: DataFrame, owners: DataFrame, least: float = 0.85) -> DataFrame:
    """Facilities with coordinates, and their owners, where the owner's evidence reaches `least`."""
    known = facilities.where("lat is not null and lon is not null")
    return known.join(owners.where(F.col("evidence") >= least), "facility_id")


def record(signals: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """Each signal with its parts as sorted arrays of structs, empty where it has none. `parts`: name: (rows, columns in order)."""
    out = signals
    for name, (rows, columns) in parts.items():
        nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def provenance(runs: DataFrame) -> DataFrame:
    """Per event and classifier (the version's part before the slash) its newest version."""
    name = F.split("version", "/")[0]
    return runs.groupBy("event_id", name.alias("classifier")).agg(F.max_by("version", F.struct("ts", "version")).alias("version"))


def entity_terms(entities: DataFrame, aliases: DataFrame, collisions: DataFrame) -> DataFrame:
    """entity_id and phrase: names and aliases of active entities without their own collision terms, parentheses and quotes.

    Of phrases that are equal without regard to case, the first by entity and term stays.
    """
    active = entities.where("active").select("entity_id", F.col("name").alias("term"))
    terms = active.unionByName(aliases.join(active.select("entity_id"), "entity_id", "left_semi").select("entity_id", "term"))
    barred = collisions.select("entity_id", F.lower("term").alias("_low"))
    terms = terms.withColumn("_low", F.lower("term")).join(barred, ["entity_id", "_low"], "left_anti")
    phrase = F.btrim(F.regexp_replace(F.regexp_replace("term", r"\([^)]*\)", ""), r'["()]', ""))
    terms = terms.withColumn("phrase", F.regexp_replace(phrase, r"\s+", " ")).where("phrase <> ''")
    return terms.groupBy(F.lower("phrase").alias("_low")).agg(F.min_by(F.struct("entity_id", "phrase"), F.struct("entity_id", "term")).alias("f")).select("f.*")


def measured(rows: DataFrame, day: Column, start: str, end: str, status: Column, by: list[str]) -> DataFrame:
    """How well a source fits: counts by window and resolution, and what they recommend. Undated rows aren't zero hits."""
    date = day.cast("date")
    inside = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    count = lambda c: F.count_if(c)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        count(date.isNull()).alias("undated"),
        count(~inside).alias("out_of_window"),
        *(count(inside & (status == s)).alias(s) for s in ("matched", "review", "none")),
    )
    verdict = (
        F.when(F.col("undated") == F.col("total"), "unparseable")
        .when(F.col("matched") >= 25, "build")
        .when(F.col("matched") > 0, "watch")
        .otherwise("skip")
    )
    return out.withColumn("recommendation", verdict)


def badges(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in flags.items())))


def staleness(filters: str, basis: str | None, now: str, most_hours: float = 26.0) -> Column:
    """Why a stored aggregate with a state row (filters, basis, as_of) may not be served; '' if it may. A missing row has null filters."""
    stamp, at = F.expr("try_cast(as_of AS timestamp)"), F.lit(now).cast("timestamp")
    age = (F.unix_timestamp(at) - F.unix_timestamp(stamp)) / 3600
    return (
        F.when(F.col("filters").isNull(), "missing")
        .when(F.col("filters") != filters, "filter mismatch")
        .when(~F.col("basis").eqNullSafe(F.lit(basis)), "basis changed")
        .when(stamp.isNull() | ~F.col("as_of").rlike(r"(Z|[+-]\d\d:?\d\d)$"), "unreadable")
        .when((age > most_hours) | (age < 0), "expired")
        .otherwise("")
    )


def read_or_recomputed(state: DataFrame, live: DataFrame, stored: DataFrame, filters: str, basis: str | None, now: str, most_hours: float = 26.0) -> DataFrame:
    """The stored aggregate if its state row is fresh, else the live one, with the reason ('' if stored).

    The state row is read first, so only one of the two is in the plan.
    """
    one = live.sparkSession.range(1).join(state.limit(1), F.lit(True), "left")
    why = one.select(staleness(filters, basis, now, most_hours).alias("reason")).first()["reason"]
    return (live if why else stored).withColumn("reason", F.lit(why))


def mapped_products(obligations: DataFrame, products: DataFrame, key: str, standards: str) -> DataFrame:
    """Per obligation the distinct products of its named standards, in the standards' and then the products' order, by ';'."""
    named = obligations.select(key, F.posexplode(standards).alias("_i", "standard"))
    met = named.join(products, "standard").groupBy(key, "product").agg(F.min(F.struct("_i", "place")).alias("_at"))
    joined = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "product"))).alias("_p"))
    return obligations.select(key).join(joined, key, "left").select(key, F.array_join(F.col("_p.product"), ";").alias("products"))


def feedback(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """Feedback rows (verdict, reason_code) with `problem`: '' if they may be appended."""
    down = F.col("verdict") == "down"
    problem = (
        F.when(~F.coalesce(F.col("verdict").isin("up", "down"), F.lit(False)), "unknown verdict")
        .when(down & F.col("reason_code").isNull(), "a reason is needed")
        .when(down & ~F.col("reason_code").isin(*reasons), "unknown reason")
        .when(~down & F.col("reason_code").isNotNull(), "no reason is wanted")
        .otherwise("")
    )
    return rows.withColumn("problem", problem)


def newest(rows: DataFrame, by: list[str], at: str, tie: str, n: int) -> DataFrame:
    """The newest `n` rows of each group, numbered from 1: a report's limit."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("place", place).where(F.col("place") <= n)
