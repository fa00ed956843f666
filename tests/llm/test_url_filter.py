import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.url_filter import RULES, edges, host_and_path, judge_hosts, judge_pages


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def rule(host, path):
    best = None
    for verdict, r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = verdict, r
    return best


def brute_edges(pages):
    n = defaultdict(float)
    hosts = set()
    for url, html in pages:
        src = host_path(url)[0]
        if not src:
            continue
        hosts.add(src)
        for m in re.finditer(r"""<a\b[^>]*?\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or "", re.I):
            dst = re.sub("[A-Z]", lambda c: c[0].lower(), m[1])
            if dst != src:
                n[src, dst] += 1
                hosts.add(dst)
    up = set()
    for h in hosts:
        labels = h.split(".")
        chain = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
        up |= set(zip(chain, chain[1:], strict=False))
    for a, b in up:
        n[a, b] += 1
        n[b, a] += 1
    return dict(n)


def brute_rank(graph, nodes, seed, damping=0.85):
    """The stationary distribution of the walk, from its whole transition matrix: follow a link with probability damping; with the rest,
    and always from a node without links, restart."""
    names = sorted(nodes)
    at = {x: i for i, x in enumerate(names)}
    start = np.array([seed.get(x, 0.0) for x in names])
    if not start.sum():
        return dict.fromkeys(names, 0.0)
    start /= start.sum()
    links = np.zeros((len(names), len(names)))
    for (a, b), n in graph.items():
        links[at[a], at[b]] += n
    walk = np.array([damping * row / row.sum() + (1 - damping) * start if row.sum() else start for row in links])
    values, vectors = np.linalg.eig(walk.T)
    rank = np.real(vectors[:, np.argmin(abs(values - 1))])
    return dict(zip(names, rank / rank.sum(), strict=True))


PAGES = [
    (1, "https://a.example.org/es/1", '<a href="https://spam.net/x">'), (2, "http://B.example.ORG/en/15?q", "<A class=x HREF='//good.net'>"), (3, "https://x.com/fr/", '<a href="http://good.net/1"><a href="http://good.net/2">'), (4, "https://x.com/de/", '<a href="/local">'),
    (5, "https://good.net", None), (6, "https://spam.net/a#f", '<a href="https://a.example.org">'), (7, None, "x"), (8, "no scheme", ""), (9, "://", "y"), (10, "ftp://org/", ""), (11, "https://org?x=://b.com/de/", ""), (12, "https://lonely.info/en/", ""), (12, "https://lonely.info/en/", ""),
    (None, "https://example.org/en/2", ""), (13, "https://notexample.org/es/", ""), (14, "https://x.example.org/en/1", ""),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*p, "v") for p in PAGES], "page_id long, url string, html string, verdict string")
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_pages(df).collect()}
    graph = brute_edges([(u, h) for _, u, h in PAGES])
    good, bad = defaultdict(float), defaultdict(float)
    for _, url, _ in PAGES:
        h, p = host_path(url)
        if h and (r := rule(h, p)):
            (good if r[0] == "allow" else bad)[h] += 1
    nodes = {x for e in graph for x in e} | {host_path(u)[0] for _, u, _ in PAGES} - {""}
    trust = brute_rank(graph, nodes, good)
    distrust = brute_rank({(b, a): n for (a, b), n in graph.items()}, nodes, bad)
    want = set()
    for d, url, _ in PAGES:
        h, p = host_path(url)
        r = rule(h, p)
        want.add((d, h, p, r and r[1], r[0] if r else "block" if h and distrust[h] > trust[h] * 1.0001 else "allow"))
    assert out == want
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}  # the method decides both ways here
    got = {(e.src, e.dst): e.n for e in edges(df.selectExpr("lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) host", "html")).collect()}
    assert got == graph


def test_totals_and_long_chains(spark):
    """Dead ends lose nothing, and trust reaches hosts at any distance."""
    chain = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(60)]
    graph = {(a, b): n for a, b, n in [*chain, ("x", "sink", 1.0), ("y", "sink", 1.0), ("x", "y", 3.0)]}
    judged = [("h0", "allow"), ("x", "allow"), ("y", "block"), ("sink", "block"), ("alone", None)]
    df = spark.createDataFrame([(*k, n) for k, n in graph.items()], "src string, dst string, n double")
    out = {r.host: r for r in judge_hosts(spark.createDataFrame(judged, "host string, verdict string"), df, tolerance=1e-9).collect()}
    nodes = {x for e in graph for x in e} | {"alone"}
    trust = brute_rank(graph, nodes, {"h0": 1, "x": 1})
    distrust = brute_rank({(b, a): n for (a, b), n in graph.items()}, nodes, {"y": 1, "sink": 1})
    assert out.keys() == nodes
    for h, r in out.items():
        assert abs(r.trust - trust[h]) < 1e-8 and abs(r.distrust - distrust[h]) < 1e-8
    assert out["h60"].trust > 0
    for side in ("trust", "distrust"):
        assert abs(sum(r[side] for r in out.values()) - 1) < 1e-9
    none = judge_hosts(spark.createDataFrame([("x", None)], "host string, verdict string"), df).collect()
    assert {(r.trust, r.distrust, r.blocked) for r in none} == {(0.0, 0.0, False)}


def test_long_urls_pages_and_clashing_names(spark):
    far = '<p>' + "x" * 200_000 + '<a href="https://far.net/">'
    rows = [(1, "https://seed.org/" + "a/" * 50_000, far), (2, "https://far.net", None), (3, "https://a." + "b." * 300 + "net/", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, trust string")
    out = {r.page_id: r for r in judge_pages(df).collect()}
    assert out[1].rule == "org/" and len(out[1].path) == 100_001 and out[2].trust > 0 and out[3].verdict == "allow"


def test_hosts_of_many_labels_have_every_parent(spark):
    long = ".".join(f"l{i}" for i in range(3000))
    pages = [("https://" + long + "/x", None), ("https://b.c.d.e", f'<a href="//{"z" * (1 << 20)}.y.x.w">'), ("https://one", ""), ("https://a..b.", ""), ("https://two.labels", "")]
    df = spark.createDataFrame(pages, "url string, html string")
    rows = df.select(host_and_path(F.col("url"))[0].alias("host"), "html")
    assert {(r.src, r.dst): r.n for r in edges(rows).toLocalIterator()} == brute_edges(pages)


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert judge_pages(df).count() == len(PAGES)
    assert judge_pages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        judge_pages(df.drop("html"))
