import random

import pytest
from pyspark.sql import functions as F

from beaconry.llm import url_filter as u

RULES = [u.Rule("org", "/", False), u.Rule("example.org", "/es/", True), u.Rule("example.org", "/en/1", True), u.Rule("com", "/fr/", False), u.Rule("com", "/de/", True)]


def plain(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: len(r.key))
    return host, path, best.key, "block" if best.block else "allow"


def urls():
    rng = random.Random(5)
    out = [None, "", "no scheme/x", "http://", "http://ORG", "http://org/", "HTTP://A.Example.ORG/es/x?q#f", "x://y://z/fr/", "http://notexample.org/es/", "http://com/de", "http://a.com\n/de/x", "http://É.org/É", "http://example.org?/es/", "http://u:p@example.org:80/es/"]
    for _ in range(800):
        host = ".".join(rng.choice(["www", "m", "a", "example", "b"]) for _ in range(rng.randint(1, 3))) + rng.choice([".org", ".com", ".net", ".Org"])
        out.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['es', 'en', 'fr', 'de', ''])}/{rng.randint(1, 30)}{rng.choice(['', '?a=/de/', '#x', '.html'])}")
    return out


def test_like_plain_rules(spark):
    rows = [(i, x, "old") for i, x in enumerate(urls())]
    out = u.judged(spark.createDataFrame(rows, "page_id long, url string, verdict string"), RULES)
    assert out.columns == ["page_id", "url", "verdict", "host", "path", "rule"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(rows)
    for i, x, _ in rows:
        assert got[i] == plain(x, RULES), x


def test_cascades_are_exact_over_their_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    levels = u.cascade(keys.where("listed").select("key"), keys.where("not listed").select("key"))
    assert len(levels) > 1, "no false positives: the test shows nothing"
    wrong = keys.where(u.member(F.col("key"), levels) != F.col("listed"))
    assert wrong.count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = u.judged(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judged(empty, RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/x")] * 2, "page_id long, url string")
    assert [r["verdict"] for r in u.judged(one, [u.Rule("org", "/", True)]).collect()] == ["block", "block"]
    with pytest.raises(ValueError, match="bound"):
        u.level_of(one.select(F.col("url").alias("key")), 10**9, 1)


def test_long_lists_take_the_same_way(spark):
    rules = [u.Rule(f"h{i}.org", "/" if i % 2 else "/x", i % 3 == 0) for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://a.h{i}.org/x{i}") for i in range(0, 4000, 7)], "page_id long, url string")
    out = u.judged(pages, rules)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        i = r["page_id"]
        rule = rules[i] if i < 3000 else None
        assert (r["rule"], r["verdict"]) == ((rule.key, "block" if rule.block else "allow") if rule else (None, "allow"))
