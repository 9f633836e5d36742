"""URL filter: hosts, paths and rules against a plain loop, a list of many entries, odd urls."""
from __future__ import annotations

import random

from sparklog.llm import urls

PAGES = "page_id long, url string, host string, rule string, key string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        cut = rest.find("/")
        host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h), len(p)) > best[0]:
                best = ((len(h), len(p)), h + p, v)
    return host, path, best and best[1], best[2] if best else "allow"


def check(spark, all_urls, rules):
    df = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in enumerate(all_urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(all_urls)}


ODD = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/a?b#c", "http://a.com", "https://x.example.com/en/1",
       "http://example.com/en", "http://example.com/en/", "https://www.example.com/en/x", "http://fr.net/fr/", "http://net/fr/x",
       "http://a.net/es/", "http://xnet/es/", "http://a.net:80/es/", "http://É.com/ü", "http://a.com#/en/", "x://y://z.com/", "http://a.com/\n/",
       "http://" + "a." * 40 + "com/" + "p/" * 2000]


def test_contract_rules(spark):
    check(spark, ODD, urls.RULES)


def test_a_long_list_of_random_rules(spark):
    rnd = random.Random(2)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    path = lambda: "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randint(0, 5)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(400))}.values())
    check(spark, ODD + [f"http://{host()}{path()}" for _ in range(600)], rules)


def test_empty_list_empty_table_and_repeated_rows(spark):
    check(spark, ODD, [])
    none = spark.createDataFrame([], PAGES)
    assert urls.judge_urls(none, urls.rule_table(spark)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/", "", "", "")] * 2 + [(1, "http://b.net/es/", "", "", ""), (None, None, None, None, None)], PAGES)
    got = sorted(((r.page_id, r.url, r.rule, r.verdict) for r in urls.judge_urls(twice, urls.rule_table(spark)).collect()), key=str)
    assert got == sorted([(1, "http://a.com/", "com/", "allow")] * 2 + [(1, "http://b.net/es/", "net/es/", "block"), (None, None, None, "allow")], key=str)
