import random
import re

from beaconry.llm import decontaminate as d


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        x = plain_words(t)
        m = min(13, len(x))
        for i in range(len(x) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == x[i : i + m]:
                    hit.update(range(j, j + m))
                    found.update(() if item is None else (str(item),))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def rows_of(spark, docs, items, **options):
    out, name = d.scan(spark.createDataFrame(docs, "doc_id long, text string, found_0 string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    f = out[name]
    got = out.select("doc_id", "found_0", f["n_words"], d.n_hit(f), f["items"], d.is_contaminated(f)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Éc", "d9", "É", "x"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 5, 13, 14, 30]))) for i in range(12)] + [(3, None), (None, some(13)), (5, "Odd-One, out!")]
    docs = [(i, some(rng.randint(0, 80)) + rng.choice(["", ". " + (items[i % 12][1] or "")]) + " tail", "kept") for i in range(60)]
    return docs + [(60, None, "kept"), (61, "", None), (61, "", None), (62, "odd ONE.out " + "z " * 30, "x"), (None, "a b", "x")], items


def test_like_brute_force_in_one_block_and_in_many(spark):
    docs, items = case(1)
    want = sorted(((i, c, *plain(t, items)) for i, t, c in docs), key=repr)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert rows_of(spark, docs, items) == want
    assert rows_of(spark, docs, items, block_bytes=120) == want


def test_long_windows_only(spark):
    items = [(1, " ".join(f"w{i}" for i in range(40)))]
    inside = " ".join(f"W{i}" for i in range(5, 25))
    docs = [(1, f"{'q ' * 100}{inside}!", ""), (2, f"{'q ' * 1000}{inside}", ""), (3, " ".join(f"w{i}" for i in range(12)), "")]
    got = {r[0]: r[2:] for r in rows_of(spark, docs, items)}
    assert got[1] == (120, 20, ["1"], True)
    assert got[2] == (1020, 20, ["1"], False)
    assert got[3] == (12, 0, [], False)


def test_contaminated_rows_go_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, "clean text", "y"), (3, None, None)], "doc_id long, text string, found_0 string")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    out = d.decontaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_empty_tables(spark):
    assert rows_of(spark, [], [(1, "a b")]) == []
    assert rows_of(spark, [(1, "a b", None)], []) == [(1, None, 2, 0, [], False)]
