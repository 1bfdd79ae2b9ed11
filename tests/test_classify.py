"""Classification plans on rows of their own."""

from beaconry.plans import classify


def test_a_next_turn_with_new_words_is_told_apart(spark, tmp_path):
    rows = [(1, 0, "the plant was shut"), (1, 1, "Shut, the plant was"), (1, 2, "the plant was opened"), (2, 0, "all of the outage"), (2, 1, "the outa"), (2, 2, None), (3, 0, None), (3, 1, "a b, reported"), (3, 2, "Énergie")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["own_words"] for r in classify.c18_next_turn(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): True, (1, 1): False, (2, 0): True, (2, 1): True, (3, 0): True, (3, 1): False}
