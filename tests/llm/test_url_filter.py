import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.llm.url_filter import build_filter, canonical_list, judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("a.b.c", "", "block"), ("net", "/", "allow")]
KIND = "host string, path string, verdict string"


def plain(url):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = lower(rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in sorted(RULES, key=lambda r: r[2] == "block"):
        h = lower(h)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) >= len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, "allow"))


URLS = [
    "http://x.net/", "https://Sub.EXAMPLE.net/en/1?q", "http://example.net/fr/", "http://example.com/de/x#y", "http://notexample.com/de/",
    "http://net/", "http://net", "ftp://www.a.b.c", "http://a.b.c?x=/", "no scheme.net/", None, "", "://", "http:///path", "x://é.net/é",
    "http://" + "a." * 5000 + "net/" + "p" * 50_000, "http://x.net/\nnew", "http://y.net:80/",
]


@pytest.mark.parametrize("limit", [200_000, 1])
def test_against_brute_force(spark, limit):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://x.net/", "clash"), (0, URLS[0], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("x.net", None, "block")], KIND)
    got = judge_urls(pages, rules, broadcast_rows=limit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain(u))) for i, u, _ in rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    none = spark.createDataFrame([], KIND)
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "x.net", "/", None, "allow")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(RULES, KIND)).collect() == []


def test_filter_passes_every_listed_key_and_few_others(spark):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    listed = canonical_list(rules)
    bloom = build_filter(listed)
    hashes = lambda df: np.array([r[0] for r in df.select(F.xxhash64("rule")).collect()])
    assert bloom.may_hold(hashes(listed)).all()
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("rule"))
    assert bloom.may_hold(hashes(others)).mean() < 0.02
