"""Each stage of the pipeline against plain code, on its own input."""

import corpus_pipeline
from beaconry.llm import decontaminate, mixing, quality
from beaconry.llm.common import staged
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_near_dedup import plain as plain_groups

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality_classifier"](spark, docs, SF)
    out, name = quality.scored(docs)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in out.where(out[name] >= 0.5).collect()}
    rows = {r["doc_id"]: r["text"] for r in good.collect()}

    once = stage["near_duplicates"](spark, good, SF)
    assert once.columns == docs.columns
    kept = {i for i, (_, _, k) in plain_groups(rows.items(), 5).items() if k}
    assert {r["doc_id"] for r in once.collect()} == kept
    assert len(kept) < len(rows)

    clean = stage["decontamination"](spark, once, SF)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i in kept if not plain_hits(rows[i], items)[3]}
    assert decontaminate.WINDOW == 13

    mix = stage["mixing"](spark, clean, SF)
    assert mix.columns == docs.columns and 0 < mix.count() <= clean.count()
    last = stage["sharding"](spark, staged(mix, "mix"), SF).collect()
    assert {r["doc_id"]: r["text"] for r in last} == {r["doc_id"]: r["text"] for r in mix.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "shard" in out.columns


def test_mixing_keeps_all_rows_of_a_hot_source(spark):
    rows = [(i, "hot" if i < 2000 else f"s{i % 19}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    mixed = mixing.mixed(docs, mixing.temperature_weights(docs, 0.9))
    order = [r["doc_id"] for r in mixed.orderBy("mix_position").collect()]
    assert mixed.where("not in_mix").count() > 0
    assert [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()] == order
    assert sorted(order) == list(range(6000))


def test_shards_follow_the_mix(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 19}", 6) for i in range(3000)] + [(None, None, None, None, None), (5, "text 5", "en", "hot", 6), (5, "text 5", "en", "hot", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed(docs, mixing.temperature_weights(docs, 0.9)).collect()
    place = {r["doc_id"]: r["mix_position"] for r in mixed}
    out = corpus_pipeline.sharding_stage(spark, staged(corpus_pipeline.mixing_stage(spark, docs, SF), "mix"), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None) == sorted(r[:2] for r in rows if r[0] is not None) and len(out) == len(rows)
    for shard in range(8):
        own = sorted((r["slot"], place[r["doc_id"]]) for r in out if r["shard"] == shard)
        assert [k for k, _ in own] == list(range(len(own))) and len(own) > 300
        assert [p for _, p in own if p != place[5]] == sorted(p for _, p in own if p != place[5])
    plainly = corpus_pipeline.sharding_stage(spark, staged(docs.coalesce(1), "unmixed"), SF).collect()
    assert {r["doc_id"]: r["slot"] for r in plainly} != {r["doc_id"]: r["slot"] for r in out}  # without the mixing stage it would differ
