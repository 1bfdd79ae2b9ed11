import itertools
import random
import re

from beaconry.llm import filter_audit as a

SCHEMA = "doc_id long, text string, lang string, n string, failed string"
LABELS = "doc_id long, quality int, toxic int, good string"


def failures(rows):
    """Per row the letters that it fails, plainly."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append((part or "", {k for k, v in f.items() if v}))
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    facts = [(part, f, i in good, i in toxic) for (i, *_), (part, f) in zip(rows, failures(rows), strict=True)]
    out, credit = [], {}
    for part in {p for p, *_ in facts}:
        mine = [x for x in facts if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                credit[part, x] = credit.get((part, x), 0) + len(gone)
                out.append([part, order, step, len(kept), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                left = kept
    return sorted((*r, credit[r[0], r[1][r[2] - 1]]) for r in out)


def text(rng):
    words = [rng.choice(["low", "Big", "ALL", "c$h", "für", "x"]) + rng.choice(["", "", *map(str, range(300))]) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
    return rng.choice([" ", "\n", " \t\r\x0b\x0c ", "  ", "  "]).join(words).lower() if rng.random() < 0.6 else " ".join(words)


def some(n=140):
    rng = random.Random(4)
    texts = [text(rng) for _ in range(25)] + [None, "", " ", "\x00", " ", "word " * 30_000]
    rows = [(rng.randrange(200), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    rows += [(i, "hot text", "en") for i in range(500, 250, -1)] + [(None, "hot text", "en"), (None, None, None), (7, "hot text", "de"), (7, "hot text", "de"), (7, "hot text", "en")]
    labels = [(rng.randrange(520), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    return rows, labels


def written(spark, rows, folder, files):
    for k in range(files):
        spark.createDataFrame([(*r, "x", "y") for r in rows[k::files]], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def marks(spark, labels):
    return spark.createDataFrame([(*r, "x") for r in labels], LABELS)


def test_equal_to_plain_code_and_kept_up_to_date(spark, tmp_path):
    rows, labels = some()
    half, folder, state = len(rows) // 2, str(tmp_path / "in"), str(tmp_path / "state")
    written(spark, rows[:half], folder, 3)
    assert result(a.audited(a.streamed(spark, folder, 1), marks(spark, labels), state)) == plain(rows[:half], labels)
    written(spark, rows[half:], folder, 1)  # has the smaller ids of the hot text
    out = a.audited(a.streamed(spark, folder, 1), marks(spark, labels), state)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert result(out) == plain(rows, labels)
    assert result(a.audited(a.streamed(spark, folder, 1), marks(spark, labels), state)) == plain(rows, labels)  # nothing new


def test_a_batch_that_is_repeated_replaces_its_changes(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    written(spark, [(5, "same", "en"), (9, "same", "en")], folder, 2)
    a.counters(a.streamed(spark, folder, 1), marks(spark, []), state, 10)
    last = max((tmp_path / "state/query/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if it had failed after its changes were written
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    again = a.counters(a.streamed(spark, folder, 1), marks(spark, []), state, 10)
    assert result(again.select("part", "failed", "n")) == [("en", 1, 1), ("en", 1 | a.REPEATED, 1)]


def test_no_rows_and_one_file(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "none"))
    assert result(a.audited(a.streamed(spark, str(tmp_path / "none")), marks(spark, []))) == []
    written(spark, [(1, None, None)], str(tmp_path / "one"), 1)
    one = next((tmp_path / "one").glob("*.parquet"))
    assert result(a.audited(a.streamed(spark, str(one)), marks(spark, []))) == plain([(1, None, None)], [])


def test_combining_leaves_few_rows_of_a_hot_text(spark):
    rows = spark.createDataFrame([(b"h", i, "en", 1, False, False) for i in range(900)], "digest binary, id bigint, part string, failed int, good boolean, toxic boolean").coalesce(1)
    got = [(r["id"], r["failed"], r["n"]) for r in a.combined(rows).collect()]
    assert sorted(got, key=str) == [(0, 1, 1), (None, 1 | a.REPEATED, 899)]
