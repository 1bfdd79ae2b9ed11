import numpy as np
import pytest

from beaconry.llm import toxicity as t

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reader(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return t.Reader(t.language_model(docs, "text"))


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("you 1d10t", "you idiot"), ("$tup1d cl0wn", "stupid clown"), ("i d i o t", "idiot"), ("s.t.u.p.i.d ones", "stupid ones"), ("looooser", "loser"), ("tr@sh", "trash"), ("plain words stay", "plain words stay"), ("in 2024 we", "in 2024 we"), ("", "")],
)
def test_disguises_are_undone(reader, seen, meant):
    assert reader.restore(seen) == meant


def test_trigrams_count_like_plain_code():
    text = "ab, c1 éa"
    padded = [0, 0, *[t.letter_class(c) if c.isalnum() else 0 for c in text], 0]
    want = []
    for i, c in enumerate(padded):
        if i == 0 or c or padded[i - 1]:
            want.append(c)
    assert t.trigrams(text).tolist() == [(a * 64 + b) * 64 + c for a, b, c in zip(want, want[1:], want[2:], strict=False)]


def test_the_likeliest_reading_is_the_cheapest_of_all(reader):
    from itertools import product

    for seen in ("1d10t", "l00ser", "m0r0n", "cl4sss"):
        best = np.inf
        for ways in product(*t.lattice(seen)):
            text, cost, p, q = "".join(w for w, _ in ways), sum(c for _, c in ways), 0, 0
            for c in text:
                k = t.letter_class(c)
                cost, p, q = cost + float(reader.costs[p, q, k]), q, k
            cost += float(reader.costs[p, q, 0])
            if cost < best:
                best, word = cost, text
        assert t.restored(seen, reader.costs) == word


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    out = t.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50
    wrong = [r for r in out if (r["score"] >= 0.5) != (r["toxic"] == 1)]
    assert len(wrong) <= 0.06 * len(out)
    assert not [r for r in wrong if r["toxic"] == 0]


def test_odd_rows(spark):
    rows = [(i, "nice words here" if i % 2 else "rude slur words", "l") for i in range(200)] + [(500, None, "l"), (501, "", "l"), (502, "RUDE SLUR", "l"), (502, "RUDE SLUR", "l"), (None, "rude slur", "l"), (503, "s l u r r r r r 5lur", "l"), (504, "w" * 200_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = t.scored(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[502] > 0.5 and score[503] > 0.5 and score[500] == score[501] < 0.5 and score[1] < 0.5
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert all(r["score"] == 0 for r in t.scored(docs, labels.where("toxic = 1")).collect())
    assert t.scored(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize(
    ("seen", "meant"),
    [
        ("st" + "u" * 45 + "pid", "stupid"),
        ("_".join(["$tup1d", "1d10t", "tr@sh", "looooser", "m0r0n", "cl0wn", "1d10t"]), "stupid idiot trash loser moron clown idiot"),
        (" ".join("stupididiot" * 5), " ".join(["stupid idiot"] * 5)),
    ],
)
def test_long_disguises_are_undone_whole(reader, seen, meant):
    assert reader.restore(seen) == meant
    assert {f"={w}" for w in meant.split() if len(w) > 3} <= reader.features(seen)


def test_a_word_before_a_spelled_one_does_not_hide_it(reader):
    assert "=idiot" in reader.features("you are a i d i o t")


def test_decoding_takes_time_in_proportion(reader):
    seen = "1d10t" * 2000
    assert len(reader.restore(seen).replace(" ", "")) == len(seen)


@pytest.mark.parametrize(("sf", "different"), [("sf0.001", 1), ("sf0.01", 6)])
def test_the_scores_are_those_of_restored_words(spark, reader, sf, different):
    """The query's scores against plain counts over restored texts, fitted and applied row by row."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in t.scored(docs, labels).collect()}
    import math
    import zlib

    own = t.Reader(t.language_model(docs, "text"))
    assert len({round(x, 9) for x in got.values()}) >= different
    words = {r["doc_id"]: own.features(r["text"]) for r in docs.collect()}
    teach = [(r["doc_id"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in words]
    n = [sum(y == k for _, y in teach) for k in (0, 1)]

    def ratio(c, k):
        part = lambda x, rows: x * math.log(x / ((c + k) * rows / sum(n))) if x else 0.0
        return 2 * (part(k, n[1]) + part(c, n[0])) if k / n[1] > c / n[0] else 0.0

    seen = {f for i, _ in teach for f in words[i]}
    count = {f: [sum(f in words[i] for i, y in teach if y == k) for k in (0, 1)] for f in seen}
    strong = sorted(f for f in seen if ratio(*count[f]) >= t.MIN_EVIDENCE)
    at = {f: j for j, f in enumerate(strong)}
    weights, bias = t.fit(sorted((sorted(at[f] for f in words[i] if f in at), y) for i, y in teach), len(strong))
    for i, found in words.items():
        want = 1 / (1 + math.exp(-(sum(weights[at[f]] for f in found if f in at) + bias)))
        assert abs(got[i] - want) < 1e-6


def test_raw_forms_are_no_features(reader):
    assert reader.features("you 1d10t") == {*reader.parts("you"), *reader.parts("idiot")}
