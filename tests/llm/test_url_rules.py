"""The URL filter against SQL that counts every combination of tokens and tries every rule on every URL, on rows with every odd case."""

from __future__ import annotations

import random

import duckdb
import pytest

from cataloom.llm import queries, url_rules
from cataloom.llm.scratch import Scratch

PAGES, LABELS = "page_id long, url string, html string, host string, rule string, token string", "doc_id long, quality int, toxic int"


def cases():
    rng = random.Random(9)
    odd = [None, "", "no scheme", "://", "http://", "HTTP://Casino.Example.NET", "ftp://x.net/", "http://a.example.net/EN/", "http://a.example.net/en/1", "http://example.com/de/#x", "https://org/fr/?a=b", "x?u=http://b.org/fr/", "http://notnet/", "http://a.org/fr"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(None, "http://casino-win.com/en/1"), (8, odd[8]), (3, "http://cheap.example.org/en/" + "x" * 70_000), (99, "://net/#" + "é" * 3000)]
    labels = [(3, None, None), (5, 0, None), (5, 1, 0), (None, 0, 1), (77_777, 0, 1)]
    for k in range(600):
        spam = rng.random() < 0.3
        name = rng.choice(["casino-win", "free-bets"]) if spam else rng.choice(["the", "news", "wiki", "free-press"])
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'm.', 'www.'])}{name}.{rng.choice(['com', 'org', 'info'])}/{rng.choice(['en', 'es', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '/', '?page=2&ref=x', '#top', '.html', '?=&a'])}"
        rows.append((1000 + k, url))
        if rng.random() < 0.7:
            bad = rng.random() < (0.9 if spam and "bets" in name or spam and "/es/" in url else 0.1)
            labels.append((1000 + k, *rng.choice([(0, 0), (1, 1), (None, 1)])) if bad else (1000 + k, 1, rng.choice([0, None])))
    return [(*r, "h", "clash", "clash", None) for r in rows], labels


def stored(spark, folder, pages, labels):
    spark.createDataFrame(pages, PAGES).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def both(spark, folder):
    duck = duckdb.connect()
    for t in ("pages", "labels"):
        source = f"{folder}/{t}.parquet" + ("" if folder.startswith("/root") else "/*.parquet")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{source}'")
    found = duck.sql(queries.ORACLES["op13_urls"])
    mine = queries.op13_urls(spark, folder)
    assert sorted(mine.columns) == sorted(found.columns)
    return sorted(map(repr, map(tuple, mine.select(*found.columns).collect()))), sorted(map(repr, found.fetchall()))


def test_odd_rows(spark, tmp_path):
    stored(spark, str(tmp_path), *cases())
    mine, theirs = both(spark, str(tmp_path))
    assert mine == theirs and len(mine) == len(cases()[0])
    blocked = [r for r in mine if "'block'" in r and "None, 'block'" in r]
    assert len(blocked) > 100 and all("bets" in r or "casino" in r for r in blocked)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_broadcast_or_not(spark, tmp_path, threshold):
    """The same rows whether or not Spark may broadcast the index."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        stored(spark, str(tmp_path), *cases())
        mine, theirs = both(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert mine == theirs


def test_listed_rules(spark):
    urls = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://B.Example.NET/en/1?x#y": ("b.example.net", "/en/1", "example.net/en/", "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "https://example.com/de/://org/fr/": ("example.com", "/de/://org/fr/", "example.com/de/", "block"),
        "https://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "a#://x.org/fr/z": ("x.org", "/fr/z", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame([], "url string, label string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(urls.values()) and not any(r.mined for r in got)


def test_tokens_of_the_same_pages_are_one_item(spark):
    """Thirty tokens that always stand together make one rule, not 2^30 combinations."""
    path = "/".join(f"part{chr(97 + i)}" for i in range(26))
    rows = [(f"http://spam.example.com/{path}/{i}", "block") for i in range(20)] + [(f"http://good{i}.example.com/x/{i}", "allow") for i in range(20)]
    with Scratch(spark) as scratch:
        rules = url_rules.mine(spark.createDataFrame(rows, "url string, label string"), scratch).where("label = 'block'").collect()
    assert len(rules) == 1 and len(rules[0].needed) == 27 and rules[0].confidence == 1 and rules[0].hits == 20


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, spark.createDataFrame([("http://a.b/c", None)], "url string, label string")).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    stored(spark, str(tmp_path), *cases())
    with Scratch(spark) as scratch:
        pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
        found = url_rules.learned(pages, url_rules.mine(url_rules.labels_of_pages(pages, spark.read.parquet(f"{tmp_path}/labels.parquet")), scratch))
        plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
