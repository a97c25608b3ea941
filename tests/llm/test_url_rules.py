import random
import time

from vexel.llm import url_rules

RULE_TYPE = "verdict string, host string, path string"


def brute(pages, rules, otherwise="allow"):
    out = []
    for page, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fit = sorted((-len(h + p), h + p, v) for v, h, p in rules if v and h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p))
        out.append((page, host, path, fit[0][1] if fit else None, fit[0][2] if fit else otherwise))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PART_ROWS", 20)
    pick = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "net", "notexample.com", "example.com-x", "x.net", "co", "comx"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é", "/a!", "/a~"]
    rules = [(pick.choice(["allow", "block"]), pick.choice(hosts), pick.choice(paths)) for _ in range(25)]
    rules += [rules[0], (None, "com", "/"), ("block", None, "/"), ("block", "", "/"), ("block", "com", None)]
    pages = [(k, f"http://{pick.choice(hosts).title()}{pick.choice(paths)}{pick.choice(['', 'b', '/c', '?q', '#f'])}") for k in range(400)]
    pages += [(None, None), (1, ""), (2, "no scheme"), (3, "://"), (3, "://"), (4, "http:///a"), (5, "http://com")]
    docs = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' as host", "1 as _row", "2 as label")
    got = url_rules.judge(docs, spark.createDataFrame(rules, RULE_TYPE))
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages, rules)
    carried = url_rules.judge(docs.withColumnRenamed("label", "rank"), spark.createDataFrame(rules, RULE_TYPE), carry=("page_id", "rank", "_row"))
    assert carried.columns == ["page_id", "rank", "_row", "host", "path", "rule", "verdict"] and carried.count() == len(pages)


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://com/en/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], RULE_TYPE)
    assert sorted(map(tuple, url_rules.judge(pages, none, otherwise="block").collect())) == [(1, "com", "/en/", None, "block"), (2, "", "", None, "block")]
    assert url_rules.url_report(pages.limit(0)).count() == 0


def test_a_host_with_many_rules(spark):
    rules = [("block", "example.com", f"/{k}/") for k in range(20_000)]
    pages = [(k, f"http://www.example.com/{k % 30_000}/x") for k in range(20_000)]
    began = time.time()
    got = url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, RULE_TYPE))
    assert got.where("verdict = 'block'").count() == sum(k % 30_000 < 20_000 for k in range(20_000))
    assert time.time() - began < 60
