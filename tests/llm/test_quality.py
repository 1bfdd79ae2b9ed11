import random

import pytest

from beaconry.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_em_finds_accuracies_of_labellers():
    rng = random.Random(4)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.95, 0.85]
    patterns, truth = {}, {}
    for _ in range(6000):
        good = rng.random() < 0.8
        p = "".join("-" if rng.random() < 0.2 else "gb"[good ^ (rng.random() < r)] for r in right)
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    share, tables, posterior = q.fit_labels(patterns)
    assert abs(share - 0.8) < 0.03
    for j, r in enumerate(right):
        assert abs(tables[0, j, 0] - r) < 0.05 and abs(tables[1, j, 1] - r) < 0.1
    hits = sum((posterior[p] >= 0.5) == g for p, gs in truth.items() for g in gs)
    assert hits / 6000 > 0.95


def test_agrees_with_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out, name = q.scored(docs)
    assert out.columns == [*docs.columns, name]
    rows = out.join(labels, "doc_id").select("quality", name).collect()
    assert sum((r[1] >= 0.5) == (r[0] == 1) for r in rows) / len(rows) > 0.97
    kept = {r["doc_id"] for r in q.kept(docs).select("doc_id").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good - kept) <= 0.01 * len(good)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "Plain words, and so on.", "d"), (4, "Plain words, and so on.", "d"), (5, "x" * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score_0 string")
    out, name = q.scored(docs)
    got = [(r["doc_id"], r[name]) for r in out.collect()]
    assert len(got) == len(rows)
    assert all(v == 0 for i, v in got if i <= 3)
    assert len({v for i, v in got if i == 4}) == 1
    assert q.scored(docs.limit(0))[0].collect() == []


@pytest.mark.parametrize(("text", "vote"), [("ONLY CAPITALS STAND IN THIS TEXT", "b"), ("Quiet words stand here in a row", "g"), ("1 2 3", "-")])
def test_a_labeller_can_abstain(text, vote):
    assert q.votes(text.encode())[1] == vote


def test_monotony_looks_at_the_whole_text():
    head, spam = [f"w{i}".encode() for i in range(200)], [b"spam", b"offer"] * 20_000
    assert q.monotony(head) == 0 and abs(q.monotony(spam) - 0.99) < 1e-9
    assert q.monotony(head + spam) > 0.98
    assert q.monotony([f"w{i}".encode() for i in range(200)] * 50) == 0
    assert abs(q.monotony(head + [b"x"] * 10) - 9 / 400) < 1e-9
    assert q.votes(b" ".join(head + spam))[5] == "b" and q.votes(b" ".join(head))[5] == "g"


def test_the_scores_are_those_of_plain_code(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10_000 + i, "one text, many times.") for i in range(300)] + [(20_000, None), (20_001, "")]
    out, name = q.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r[name] for r in out.collect()}
    texts = [t.encode() for _, t in rows if t and not t.isspace()]
    patterns, copies = {}, {}
    for t in texts:
        patterns[q.votes(t)] = patterns.get(q.votes(t), 0) + 1
        copies[t] = copies.get(t, 0) + 1
    _, _, posterior = q.fit_labels(patterns)
    x = q.np.stack([q.features(t).astype("<f2").astype(q.np.float32) for t in copies])
    x = q.np.hstack([x, q.np.ones((len(x), 1), q.np.float32)])
    w, b = q.fit_scorer(x, q.np.array([posterior[q.votes(t)] for t in copies], q.np.float32), weight=1 + q.np.log(q.np.array(list(copies.values()), float)))
    for i, t in rows:
        want = 0.0 if not t else 1 / (1 + q.np.exp(-(float(q.features(t.encode()) @ w) + b)))
        assert abs(got[i] - want) < 1e-3 and (abs(want - 0.5) < 1e-3 or (got[i] >= 0.5) == (want >= 0.5))


def plain_em(patterns, rounds=60):
    """Two classes, labellers independent given the class, by loops over patterns; an abstention counts for nothing."""
    n = len(next(iter(patterns)))
    share, right = 0.7, [{"good": {"g": 0.85, "b": 0.15}, "bad": {"g": 0.5, "b": 0.5}} for _ in range(n)]
    post = {}
    for _ in range(rounds):
        for p in patterns:
            good, bad = share, 1 - share
            for j, vote in enumerate(p):
                if vote != "-":
                    good, bad = good * right[j]["good"][vote], bad * right[j]["bad"][vote]
            post[p] = good / (good + bad)
        total = sum(patterns.values())
        share = (sum(k * post[p] for p, k in patterns.items()) + 1) / (total + 2)
        for j in range(n):
            for kind in ("good", "bad"):
                seen = {v: 1 + sum(k * (post[p] if kind == "good" else 1 - post[p]) for p, k in patterns.items() if p[j] == v) for v in "gb"}
                right[j][kind] = {v: x / (seen["g"] + seen["b"]) for v, x in seen.items()}
    return share, right, post


def test_posteriors_are_those_of_plain_expectation_maximisation():
    import random

    rng = random.Random(12)
    sure = [0.95, 0.9, 0.8, 0.7, 0.9, 0.6, 0.85, 0.75][: len(q.LABELLERS)]
    patterns, truth = {}, []
    for _ in range(4000):
        good = rng.random() < 0.8
        p = "".join("-" if rng.random() < 0.2 else "g" if (rng.random() < a) == good else "b" for a in sure)
        patterns[p] = patterns.get(p, 0) + 1
        truth.append((p, good))
    share, tables, post = q.fit_labels(patterns)
    want_share, want_right, want = plain_em(patterns)
    assert abs(share - want_share) < 1e-6
    assert all(abs(post[p] - want[p]) < 1e-6 for p in patterns)
    assert all(abs(tables[0, j, 0] - want_right[j]["good"]["g"]) < 1e-6 for j in range(len(sure)))
    assert all(abs(tables[0, j, 0] - a) < 0.05 for j, a in enumerate(sure))  # the labellers' accuracies are found
    assert sum((post[p] >= 0.5) == good for p, good in truth) > 0.95 * len(truth)
