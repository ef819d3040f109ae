import random
import re

import pytest
from pyspark.sql import functions as F

from pactlake.llm import urls


def brute(pages, rules):
    of = {}
    for host, path, verdict in rules:
        if None not in (host, path, verdict):
            key = (host.lower(), path)
            of[key] = max(verdict, of.get(key, verdict))
    out = []
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [
            (len(h + p), len(h), h + p, v)
            for (h, p), v in of.items()
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule, verdict = max(fits)[2:] if fits else (None, "allow")
        out.append((page, host, path, rule, verdict))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_matches_brute_force(spark, ranges):
    rng = random.Random(8)
    hosts = ["net", "a.net", "b.a.net", "com", "ab.com", "é.com", "x.b.a.net", "xa.net", "net.com", "a.net.com", "o"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/é", "//", "/a.b"]
    pages = [(1, None), (2, ""), (3, "no scheme/a"), (4, "http://"), (5, "://net"), (6, "a://b://net/a"), (7, "http:///a")]
    pages += [(8, "HTTP://A.Net/A/b?x#y"), (9, "http://a.net?/a/"), (10, "http://net#/a"), (8, "HTTP://A.Net/A/b?x#y"), (None, "http://o/")]
    pages += [(20 + i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#f', 'zz'])}") for i in range(400)]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.4]
    rules += [(h, p, "block") for h, p, _ in rules[:3]] + [(None, "/", "block"), ("com", None, "block"), ("NET", "/a", "allow")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = urls.judged(
            spark,
            spark.createDataFrame([(*r, "x") for r in pages], "page_id bigint, url string, key string"),
            spark.createDataFrame(rules, "host string, path string, verdict string"),
        )
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pages, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/b", "x")], "page_id bigint, url string, verdict string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in urls.judged(spark, pages, rules.limit(0)).collect()] == ["allow"]
    assert urls.judged(spark, pages.limit(0), rules).count() == 0
    assert urls.allowed(spark, pages, rules).count() == 0
    assert urls.allowed(spark, pages, rules.withColumn("path", F.lit("/c"))).columns == pages.columns
