import random
import re

import numpy as np
import pytest

from sparkloom.llm import url_filter as uf
from sparkloom.llm.common import Stored

SCHEMA = "page_id long, url string, html string, host string, rule int"


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def pages():
    urls = [None, "", "nothing", "http://A.Example.COM/en/7x", "https://example.com/en/6?x=://q/en/", "x://com/en/", "http://xcom/en/", "http://é.net/de/8", "http://example.net/de/8#a", "http://m.example.net/de/81", "http://b.org/es/", "http://c.org", "http://c.org?es/", "http://D.net/fr/", "://", "a\n://n.net/de/\nq"]
    links = {3: ["http://b.org/x", "/rel"], 13: ["http://b.org/", "HTTP://B.org/2"], 11: ["http://D.net/fr/"], 9: ["http://m.example.net/"]}
    return [(i, u, "".join(f'<a class=x href="{t}">' for t in links.get(i, [])) or None, "h", 1) for i, u in enumerate(urls)]


def test_rules_hosts_and_paths(spark):
    rows = pages()
    got = {x.page_id: x for x in uf.judge_urls(spark, spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()}
    for i, url, *_ in rows:
        host, path = split(url)
        r, v = rule(host, path)
        x = got[i]
        assert (x.host, x.path, x.rule) == (host, path, r)
        assert x.verdict == v if v else x.verdict == ("block" if x.distrust > x.trust + uf.MARGIN else "allow")
    assert got[13].verdict == "block"  # it links to a blocked host
    assert got[11].verdict == "block"  # and c.org links to that one
    assert uf.judge_urls(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_propagation_equals_dense_pagerank(spark):
    r = np.random.default_rng(0)
    n = 12
    a = np.triu(r.integers(0, 3, (n, n)), 1) + np.tril(r.integers(0, 2, (n, n)), -1)
    a[5] = 0  # no outgoing link
    links = [(f"h{i}", f"h{j}", float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]]
    seeds = [(f"h{i}", float(i == 0) + 2 * (i == 3), float(i == 7)) for i in range(n)]
    df = uf.propagate(Stored(spark), spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), steps=60)
    got = {x.host: (x.trust, x.distrust) for x in df.collect()}
    for k, m in ((0, a), (1, a.T)):
        s = np.array([x[1 + k] for x in seeds])
        s /= s.sum()
        p = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        x = s.copy()
        for _ in range(300):
            y = uf.DAMPING * x @ p
            x = y + (1 - y.sum()) * s
        for i in range(n):
            assert abs(got.get(f"h{i}", (0, 0))[k] - x[i]) < 1e-4


def test_distrust_reaches_as_far_as_it_counts(spark):
    far = [(0, "http://h0.org/es/", None)] + [(k, f"http://h{k}.test/", f'<a href="http://h{k - 1}.{"test" if k > 1 else "org"}/">') for k in range(1, 41)]
    rest = [(1000 + k, f"http://n{k}.test/", None) for k in range(80)]
    got = {x.page_id: x for x in uf.judge_urls(spark, spark.createDataFrame(far + rest, "page_id long, url string, html string")).collect()}
    first = (1 - uf.DAMPING) / (1 - uf.DAMPING**41) * len(got)
    for k in range(1, 41):
        assert abs(got[k].distrust - first * uf.DAMPING**k) < uf.TOLERANCE
        assert got[k].verdict == ("block" if first * uf.DAMPING**k > uf.MARGIN else "allow")
    assert got[34].verdict == "block"


def test_small_shares_of_many_hosts_settle(spark):
    links = spark.createDataFrame([("a", "seed", 1.0), ("b", "a", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("seed", 0.0, 1.0), ("others", 0.0, 1e7 - 1)], "host string, trusted double, blocked double")
    got = {x.host: x.distrust * 1e7 for x in uf.propagate(Stored(spark), links, seeds, hosts=10**7).collect()}
    for k, host in enumerate(("seed", "a", "b", "c")):
        assert abs(got[host] - uf.DAMPING**k) < uf.TOLERANCE
    with pytest.raises(RuntimeError):
        uf.propagate(Stored(spark), links, seeds, steps=2, hosts=10**7)


def test_links_without_a_scheme(spark):
    html = """<a href="//B.org/x?u=http://no.org/"> <a href='//c.org'> <a href=//d.org/> <a href="HTTPS://e.org?q=//no.org"> <a href="http:/no.org"> <a href="/r//no.org/"> <a href="x//no.org"> <a href="//a.org/own"> <a href="//">"""
    links = uf.host_links(spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string"))
    assert sorted(map(tuple, links.collect())) == [("a.org", f"{x}.org", 1.0) for x in "bcde"]
    pages = [(1, "http://x.test/", '<a href="//bad.org/">'), (2, "http://bad.org/es/", None)]
    got = {x.page_id: x.verdict for x in uf.judge_urls(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block"}


def test_a_hub_of_many_links(spark):
    """A host that a third of all edges touch, in both directions, against dense power iteration."""
    r = random.Random(12)
    n = 600
    links = {("h0", f"h{k}"): 1.0 for k in range(1, 300)} | {(f"h{k}", "h0"): 2.0 for k in range(200, 500)}
    while len(links) < 1500:
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            links[f"h{a}", f"h{b}"] = float(r.choice([1, 3]))
    seeds = [(f"h{k}", float(k % 5 == 0), float(k % 7 == 0)) for k in range(n)]
    rows = [(a, b, w) for (a, b), w in links.items()]
    got = {x.host: (x.trust, x.distrust) for x in uf.propagate(Stored(spark), spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")).collect()}
    for which, side in enumerate(("trusted", "blocked")):
        m = np.zeros((n, n))
        for a, b, w in rows:
            i, j = int(a[1:]), int(b[1:])
            m[(j, i) if side == "trusted" else (i, j)] += w
        total = m.sum(axis=0)
        m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
        s = np.array([x[1 + which] for x in seeds])
        s /= s.sum()
        v = s
        for _ in range(400):
            moved = uf.DAMPING * m @ v
            v = moved + s * (1 - moved.sum())
        assert max(abs(got.get(f"h{k}", (0, 0))[which] - v[k]) for k in range(n)) * n < uf.TOLERANCE


def test_area_links_count_and_link_tags_do_not(spark):
    html = '<area shape="x" href="http://B.org/x"><link href="http://c.org/"><a\nhref=//d.org>x</a>'
    pages = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
    assert sorted(x.dst for x in uf.host_links(pages).collect()) == ["b.org", "d.org"]
