import random
from collections import defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from cadenza.llm import urls
from cadenza.llm.queries import URL_RULES


def slow_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    stop = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return host, path[:stop]


def slow_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def slow_judge(pages, rules, damping=0.85, tolerance=1e-4):
    """pages: (url, hosts it links to).  Dictionaries and plain loops."""
    seen = {slow_parts(u): slow_rule(*slow_parts(u), rules) for u, _ in pages}
    of_host = defaultdict(list)
    for (host, _), (_, verdict) in seen.items():
        of_host[host].append(verdict)
    n = defaultdict(int)
    for u, to in pages:
        for dst in set(to):
            src = slow_parts(u)[0]
            if src and dst and src != dst:
                n[src, dst] += 1
    total = defaultdict(lambda: defaultdict(int))
    for kind, word in (("trust", "allow"), ("distrust", "block")):
        for h, v in of_host.items():
            if h:
                total[kind][h] = floor(v.count(word) / len(v) * urls.UNIT)
    start = sum(sum(v.values()) for v in total.values())
    moving = {k: dict(v) for k, v in total.items()}
    while start and sum(sum(v.values()) for v in moving.values()) > tolerance * start:
        after = {"trust": defaultdict(int), "distrust": defaultdict(int)}
        for (src, dst), k in n.items():
            out = sum(x for (s, _), x in n.items() if s == src)
            into = sum(x for (_, t), x in n.items() if t == dst)
            after["trust"][dst] += floor(moving["trust"].get(src, 0) * (k / out * damping))
            after["distrust"][src] += floor(moving["distrust"].get(dst, 0) * (k / into * damping))
        moving = after
        for kind in moving:
            for h, m in moving[kind].items():
                total[kind][h] += m
    out = []
    for u, _ in pages:
        rule, verdict = seen[slow_parts(u)]
        host = slow_parts(u)[0]
        t, d = total["trust"].get(host, 0), total["distrust"].get(host, 0)
        out.append((*slow_parts(u), rule, verdict or ("block" if d > 0.5 * (t + d) else "allow")))
    return out


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/es/x", "http://a.example.org/es/", "https://example.org/en/1", "https://example.org/en/12?q=/es/",
    "https://notexample.org/es/1", "http://x.com/fr/#top", "http://x.com?x=/fr/", "http://y.x.com/de/9", "ftp://com/de/", "http://ÄA.net/", "a://b://c/d", "http://x.net/de/", "http://.org/", "http://a..com/fr/\n?",
]


def test_rules_and_parts(spark):
    rows = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(rows, urls.rule_table(spark, URL_RULES)).collect()}
    for k, u in enumerate(URLS):
        host, path = slow_parts(u)
        assert got[k] == (host, path, slow_rule(host, path, URL_RULES)[0]), u


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_the_slow_way(spark, seed):
    r = random.Random(seed)
    hosts = [f"h{k}.net" for k in range(14)] + ["good.org", "fine.org", "bad.com", "worse.com", "both.com", "x.example.org"]
    pages = []
    for k in range(120):
        host = r.choice(hosts)
        pages.append((f"http://{host}/{r.choice(['fr', 'de', 'es', 'en'])}/{r.randint(0, 20)}", r.sample([*hosts, "only.linked"], r.randint(0, 3))))
    page = lambda links: "<body>" + "".join(f'<a class=x HREF = "{r.choice(["http:", "HTTPS:", ""])}//{h.upper()}/p?x"> <a href="/own">' for h in links + links[:1])
    rows = spark.createDataFrame([(k, u, page(to)) for k, (u, to) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge(rows, urls.rule_table(spark, URL_RULES)).collect()}
    want = slow_judge(pages, URL_RULES)
    assert [got[k] for k in range(len(pages))] == want
    assert {v for _, _, rule, v in want if rule is None} == {"allow", "block"}


def test_distrust_runs_backwards_and_trust_forwards(spark):
    pages = [("http://spam.net/", ["bad.com"]), ("http://bad.com/de/1", ["victim.net"]), ("http://victim.net/", []), ("http://good.org/", ["friend.net"]), ("http://friend.net/", ["bad.com"]), ("http://far.net/", ["spam.net"])]
    rows = spark.createDataFrame([(u, "".join(f"<a href='http://{h}/'>" for h in to)) for u, to in pages], "url string, html string")
    got = {x["host"]: x["verdict"] for x in urls.judge(rows, urls.rule_table(spark, URL_RULES)).collect()}
    assert got == {"spam.net": "block", "bad.com": "block", "victim.net": "allow", "good.org": "allow", "friend.net": "allow", "far.net": "block"}


def test_odd_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "http://a.org/x", None, "r", "d"), (1, "http://a.org/x", None, "r", "d"), (None, None, "<a href=//b.net>" * 3, None, None)], "page_id long, url string, html string, rule string, `a.b` string")
    got = urls.judge(rows, urls.rule_table(spark, URL_RULES))
    assert set(got.columns) == {"page_id", "url", "html", "a.b", "host", "path", "rule", "verdict"}
    assert sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in got.collect()) == [(0, "", "allow"), (1, "org/", "allow"), (1, "org/", "allow")]
    assert urls.judge(rows.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0
    assert urls.judge(rows, urls.rule_table(spark, [])).where(F.col("rule").isNotNull()).count() == 0
