import random
import re

from pyspark.sql import functions as F

from threatspark.llm import queries, url_rules as U


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = (None, None)
    for said, rule in queries.URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best[1] is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best[1], best[0]


def test_query_equals_brute_force(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op6_url_rules"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, said = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (said or ("block" if r.mined else "allow"))


def test_planted_combination_is_mined_and_matched(spark):
    rng = random.Random(0)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['www', 'm'])}.{rng.choice(['alpha', 'pills', 'news'])}.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'buy'])}/{rng.randint(1, 999)}" for _ in range(600)]
    bad = ["pills" in u and "/buy/" in u for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    rules = U.mine(labelled).collect()
    assert [sorted(r["items"]) for r in rules if len(r["items"]) == 2] == [["host=pills", "path=buy"]]
    assert all({"host=pills", "path=buy"} <= set(r["items"]) for r in rules) and len(rules) == 1
    out = U.judge(labelled.withColumn("host", F.lit(1)), labelled, []).collect()
    assert len(out) == 600 and all((r.verdict == "block") == ("pills" in r.url and "/buy/" in r.url) for r in out)


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG", "x://a.ORG?q=/es/", "http://example.org/es/?a#b", "http://example.org/es/?a#b", "a://b://c/d", "http://notorg/", "http://org/" + "x/" * 50_000, "http://É.org/", "http://h/\n?x"]
    frame = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    none = spark.createDataFrame([], "url string, bad boolean")
    rows = {r.page_id: r for r in U.judge(frame, none, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, said = plain(u)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, said or "allow"), u
    assert U.judge(frame.where("false"), none, queries.URL_RULES).collect() == []
