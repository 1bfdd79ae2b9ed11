import hashlib
import random

import numpy as np
import pytest

from beaconry.llm import phrases as p

SCHEMA = "doc_id long, text string, key string, range string, to string, n_chars string"
M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_level(names):
    """One level by single steps on one text: (names, how many old names each phrase spans)."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [name if n == 1 else mix(name + n * 0x9E3779B97F4A7C15 & M) for name, n in runs]
    colour = x
    for _ in range(4):
        colour = [c & 1 if not i else p.lowest_difference(colour[i - 1], c) for i, c in enumerate(colour)]
    assert all(c < 6 for c in colour) and all(a != b for a, b in zip(colour, colour[1:], strict=False))
    for high in (5, 4, 3):
        near = [None, *colour, None]
        colour = [min({0, 1, 2} - {near[i], near[i + 2]}) if c == high else c for i, c in enumerate(colour)]
    near = [-1, *colour, -1]
    begins = [i for i in range(len(x)) if not i or near[i] < near[i + 1] > near[i + 2]]
    out, spans = [], []
    for a, b in zip(begins, [*begins, len(x)][1:], strict=True):
        out.append(mix(sum(mix(x[i] + (i - a + 1) * 0xD6E8FEB86659FD93 & M) for i in range(a, b)) & M))
        spans.append(sum(n for _, n in runs[a:b]))
    return out, spans


def plain(text, levels):
    """By level the phrases: (name, begin, end) in code points."""
    names, at = [ord(c) for c in text], list(range(len(text) + 1))
    for _ in range(levels):
        names, spans = plain_level(names)
        at = [at[i] for i in np.cumsum([0, *spans])]
        yield [(n, at[i], at[i + 1]) for i, n in enumerate(names)]


def plain_sketch(text):
    levels = list(plain(text, p.LEVELS[-1]))
    return tuple(tuple(sorted({mix(n) >> 32 for n, _, _ in levels[k - 1]})[: p.KEPT]) for k in p.LEVELS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "data", "é", "straße", "日本", "x" * rng.randrange(1, 9), "runs", str(rng.randrange(10_000))]) for _ in range(n))


def some_texts():
    rng = random.Random(8)
    return ["", "a", "aa", "ab", "a" * 70_000, "ab" * 3000, " \n\t ", "\U0001f600\U0001f600x", "\x00", *(prose(rng, k) for k in (1, 2, 5, 30, 200, 3000))]


def test_names_are_those_of_plain_code():
    texts = some_texts()
    want = [list(plain(t, 5)) for t in texts]
    for level, (names, of, at) in enumerate(p.parsed(texts, 5)):
        start = 0
        for i, t in enumerate(texts):
            assert [(int(n), int(b) - start) for n, b in zip(names[of == i], at[of == i], strict=True)] == [x[:2] for x in want[i][level]]
            start += len(t)
    assert p.sketches_by_chunks(texts) == [plain_sketch(t) for t in texts]


def test_phrases_have_two_to_four_names_and_few_at_the_ends():
    names = [ord(c) for c in prose(random.Random(3), 2000)]
    for _ in range(4):
        names, spans = plain_level(names)
        assert all(1 <= s for s in spans) and sum(spans[1:-1]) / len(spans[1:-1]) > 2


def test_equal_substrings_share_their_inner_phrases_at_any_offset():
    rng = random.Random(9)
    shared = prose(rng, 900)
    for _ in range(6):
        sides = []
        for _ in range(2):
            head = prose(rng, rng.randrange(60))
            sides.append((len(head), list(plain(head + shared + prose(rng, rng.randrange(60)), 4))))
        edge = [0, 0]
        for level in range(4):
            # The names on which a phrase depends reach back LEFT and forward RIGHT old ones, each as long as a phrase of the level below.
            inner = []
            longest = max(e - b for _, levels in sides for _, b, e in (levels[level - 1] if level else [(0, 0, 1)]))
            edge = [edge[0] + p.LEFT * longest, edge[1] + (p.RIGHT + 4) * longest]
            for offset, levels in sides:
                inner.append({(n, b - offset, e - offset) for n, b, e in levels[level] if b - offset >= edge[0] and e - offset <= len(shared) - edge[1]})
            assert inner[0] == inner[1]
            assert level > 2 or len(inner[0]) > 20


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else p.LOWEST), r[2]))
    out = []
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        changed = t[: len(t) - third] + following[:third]
        a, b, c = map(plain_sketch, (t, changed, following))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), p.written(a), p.written(b), p.likeness(a, b), p.likeness(a, c)))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "k", "r", "t", "n") for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in p.fingerprinted(df).collect()), key=str)


def tied(spark, rows):
    """The rows with the hash of the text, which orders rows of one id."""
    got = spark.createDataFrame(rows, "i long, t string").selectExpr("i", "t", "xxhash64(coalesce(t, ''))").collect()
    return [tuple(r) for r in got]


def test_documents_against_their_successors(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(rng.randrange(-50, 5000), rng.choice([prose(rng, rng.randrange(40)), "same text again", None])) for _ in range(160)]
    rows += [(77, "twin"), (77, "twin"), (77, "other"), (None, "no id"), (None, None), (6000, "日本" * 700), (6001, "")]
    want = brute(tied(spark, rows))
    assert found(spark, rows) == want
    for of_range in (1, 7):
        monkeypatch.setattr(p, "RANGE_ROWS", of_range)
        monkeypatch.setattr(p, "CHUNK_CHARS", 100)
        assert found(spark, rows, 5) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "alone here")], [(2, "pair one"), (1, "pair two")]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == (brute(tied(spark, rows)) if rows else [])


def test_likeness_follows_what_is_shared():
    rng = random.Random(11)
    text = prose(rng, 3000)
    a = p.sketches([text])[0]
    for part in (0.2, 0.5, 0.8):
        other = text[: int(part * len(text))] + prose(rng, 3000)[: int((1 - part) * len(text))]
        assert abs(p.likeness(a, p.sketches([other])[0]) - part / (2 - part)) < 0.15
    assert p.likeness(a, a) == 1 and p.likeness(p.read(p.written(a)), a) == 1
    assert p.likeness(*p.sketches(["", text])) == 0 and p.likeness(*p.sketches(["", ""])) == 1
