"""URL filters: rules, hosts, and propagation against a matrix version."""

import re

import numpy as np
import pytest

from shelfprice.llm import queries, url_filter
from shelfprice.llm.common import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "allow"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("extra") for c in ("host", "path", "rule", "verdict", "src", "dst", "match_")})


def test_query(spark, folder):
    pages = {r["page_id"]: r["url"] for r in table(spark, folder, "pages").collect()}
    rows = queries.op5_url_filter(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = parts(pages[r["page_id"]])
        text, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, text)
        assert r["verdict"] == (verdict or ("block" if r["distrust"] > 3 * r["trust"] else "allow"))


@pytest.mark.parametrize("url", [
    "HTTP://A.Example.ORG:80/es/x?y#z", "no scheme", "://", "x://host", "x://host?q=/a", "https://EXAMPLE.org/en/12#/es/",
    "http://com/de/", "ftp://notexample.org/es/", "http://a.com/fr", "http://\u00c4.com/fr/1", "http://a://b.com/de/", None, ""])
def test_parts_and_rules(spark, url):
    got = url_filter.judged(frame(spark, [(1, url, None)])).first()
    host, path = parts(url)
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule(host, path)[0])


def rank(hosts, edges, seeds, damping=0.85, rounds=20):
    index, total = {h: i for i, h in enumerate(hosts)}, sum(seeds.values())
    move = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        move[index[b], index[a]] += n
    out = move.sum(axis=0)
    start = np.array([seeds.get(h, 0) / total for h in hosts])
    score = start
    for _ in range(rounds):
        moved = damping * (move @ np.divide(score, out, out=np.zeros_like(out), where=out > 0))
        score = moved + start * (1 - moved.sum())
    return {h: s * total for h, s in zip(hosts, score)}


def linked(spark):
    link = lambda *to: "".join(f'<a class="x" HREF="{u}">t</a>' for u in to)
    return frame(spark, [
        (1, "http://good.org/a", link("http://friend.net/x", "/local", "//second.net/y")),
        (2, "http://friend.net/b", link("https://second.net/", "http://second.net/2")),
        (3, "http://bad.com/de/1", link("http://good.org/")),
        (4, "http://spam.net/1", link("http://bad.com/de/9", "http://bad.com/de/8")),
        (5, "http://farm.net/1", link("http://spam.net/")),
        (6, "http://second.net/z", None), (7, None, link("http://bad.com/de/")), (8, "http://lonely.net/", ""),
        (4, "http://spam.net/1", link("http://bad.com/de/9", "http://bad.com/de/8")),
    ])


def test_propagation_equals_matrix(spark):
    pages = linked(spark)
    edges = {(r["src"], r["dst"]): r["links"] for r in url_filter.host_edges(pages).collect()}
    assert edges == {("good.org", "friend.net"): 1, ("good.org", "second.net"): 1, ("friend.net", "second.net"): 2,
                     ("bad.com", "good.org"): 1, ("spam.net", "bad.com"): 4, ("farm.net", "spam.net"): 1}
    hosts = sorted({h for e in edges for h in e})
    trust = rank(hosts, edges, {"good.org": 1})
    distrust = rank(hosts, {(b, a): n for (a, b), n in edges.items()}, {"bad.com": 1})
    rows = url_filter.judged(pages).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))
    verdicts = {r["host"]: r["verdict"] for r in rows}
    assert verdicts == {"good.org": "allow", "friend.net": "allow", "bad.com": "block", "spam.net": "block", "farm.net": "block",
                        "second.net": "allow", "": "allow", "lonely.net": "allow"}


def test_empty(spark):
    assert url_filter.judged(frame(spark, [])).count() == 0


def test_rules_of_the_contract(spark):
    """Every rule decides as the contract of op5 says, whatever the host's standing."""
    urls = {"http://a.org/x": ("org/", "allow"), "http://example.org/es/1": ("example.org/es/", "block"),
            "http://www.example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
            "http://shop.com/fr/1": ("com/fr/", "allow"), "http://shop.com/de/1": ("com/de/", "block")}
    rows = url_filter.judged(frame(spark, [(i, url, None) for i, url in enumerate(urls)])).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == dict(enumerate(urls.values()))
