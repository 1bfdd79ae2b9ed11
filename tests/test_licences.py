"""Licence facts, identifier chains, books and edits on awkward rows."""

import pytest
from pyspark.sql import functions as F

from beaconry.operators import enrich, licences

MATRIX = "product_id string, tier string, included_or_addon string, addon_price_note string, gcc_high string, source_quality string, verified_date string, source_url string"


def matrix(spark, *rows):
    return spark.createDataFrame([(p, t, None, "5", g, None, None, None) for p, t, g in rows], MATRIX)


def tables(spark):
    return spark.createDataFrame([("a", "fam"), ("suite", None)], "sku string, family string"), spark.createDataFrame([], "tier string, prerequisite string")


def test_facts(spark):
    got = {r["fact_id"]: (r["product_id"], r["price_note"]) for r in licences.facts(matrix(spark, ("a", "1", " YES \n"), ("suite", "1", "Noway"), ("a", "2", "\t")), *tables(spark)).collect()}
    assert got == {
        "a:1:commercial": ("fam", "5"),
        "a:1:gcc_high": ("fam", "available — YES"),
        "suite:1:commercial": (None, "5"),
        "suite:1:gcc_high": (None, "needs_curation — Noway"),
        "a:2:commercial": ("fam", "5"),
    }
    assert licences.facts(matrix(spark), *tables(spark)).collect() == []


def test_an_unmapped_sku_ends_the_job(spark):
    with pytest.raises(Exception, match="no family for the sku other"):
        licences.facts(matrix(spark, ("other", "1", None)), *tables(spark)).collect()


def test_a_family_without_a_path_ends_the_job(spark):
    empty = spark.createDataFrame([], "play_id string, trigger_id string, product_id string, recommended_path string, discovery_question string")
    pairs = spark.createDataFrame([("t", "f"), ("t", "f")], "trigger_id string, product_id string")
    names = spark.createDataFrame([("f", "Name")], "product_id string, name string")
    paths = names.select("product_id", F.lit("p").alias("recommended_path"))
    one = licences.refreshed_candidates(empty, pairs, paths, names, empty, "%s %s").collect()
    assert [(r["play_id"], r["discovery_question"], r["stale"]) for r in one] == [("t:f", "p Name", False)]
    with pytest.raises(Exception, match="no path for the family f"):
        licences.refreshed_candidates(empty, pairs, paths.where("false"), names, empty, "%s %s").collect()


def test_identifiers(spark):
    entities = spark.createDataFrame([(1, "12", None), (2, None, " "), (3, "12345678901", "L"), (4, " ", None)], "entity_id long, cik string, lei string")
    ciks = spark.createDataFrame([(1, "99"), (2, "7"), (2, "8")], "entity_id long, cik string")
    by_cik = spark.createDataFrame([("0000000012", "Q2", "W", 2), ("0000000012", "Q1", "", 1), ("12345678901", "Q3", None, 1)], "cik string, qid string, lei string, seq int")
    leis = spark.createDataFrame([(1, "G1"), (2, "G2"), (3, "G3")], "entity_id long, lei string")
    by_lei = spark.createDataFrame([("G1", "X1", 1), ("G2", "X2", 1)], "lei string, qid string, seq int")
    got = {tuple(r) for r in enrich.enriched(entities, ciks, by_cik, leis, by_lei).collect()}
    assert got == {
        (1, "", "G1", "Q1", "wikidata_cik+gleif_exact_name"),
        (2, "7", "G2", "X2", "sec_cik_lookup+gleif_exact_name+wikidata_lei"),
        (3, "", "", "Q3", "wikidata_cik"),
    }


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a", "operator"), (2, "b", "seed"), (3, "c", None)], "k long, name string, origin string")
    seed = spark.createDataFrame([(2, "seeded")], "k long, name string")
    edits = [(1, "remove", 1), (2, "remove", 1), (3, "add", 1), (4, "reset", 2), (5, "reset", 2), (6, "reset", 3), (7, "remove", 3), (8, "remove", 9), (9, None, 2), (10, "add", None)]
    edits = spark.createDataFrame([(s, a, k, "new") for s, a, k in edits], "seq long, action string, k long, name string")
    none = rows.where("false")
    state, audit = enrich.edited(rows, seed, edits, none, "k", ["name"])
    assert {r["seq"]: r["outcome"] for r in audit.collect()} == {
        1: "removed", 2: "removed", 3: "exists", 4: "reset", 5: "reset", 6: "not_seed", 7: "not_operator", 8: "unknown", 9: "bad_action", 10: "bad_key"
    }
    assert sorted(map(tuple, state.collect())) == [(2, "seeded", "seed"), (3, "c", None)]
    assert enrich.edited(rows, seed, edits, rows, "k", ["name"])[1].where("outcome = 'referenced'").count() == 2


def test_books_take_the_last_of_a_batch(spark):
    books = spark.createDataFrame([("r", "9", 1), (None, "1", 1)], "key string, at string, n int")
    runs = spark.createDataFrame([("r", "2", 2), ("r", "3", 3), ("s", "1", 4)], "key string, at string, n int")
    assert {tuple(r) for r in enrich.booked(books, runs, ["key"], "at").collect()} == {("r", "3", 3), (None, "1", 1), ("s", "1", 4)}
    assert enrich.booked(books.limit(0), runs.limit(0), ["key"], "at").collect() == []
