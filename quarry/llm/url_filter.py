"""URL filter: rules for hosts and paths, and for the rest propagation over the link graph.

Nodes are hosts and their parent domains. Edges are the pages' absolute links (weighted by their number) and, so that
hosts of one domain inform each other, host to parent domain and back. Trust is a personalised PageRank from the
hosts whose pages an allow rule judges; distrust is the same over reversed edges from the hosts that a block rule judges.
A host is blocked where its distrust exceeds its trust; each has a total of 1 over all hosts, so that they compare.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, require, stash

#: (verdict, host and path). Fixed values of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for what has no ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, rest, 1)), F.regexp_extract(url, rest, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits as a struct (verdict, rule); null if none does. Of equally long ones the first stands."""
    out = F.lit(None)
    ordered = sorted(rules, key=lambda r: len(r[1]))
    for verdict, rule in ordered:  # later, that is longer ones go in front
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host) -> (src, dst): a.b.c to b.c, and so on, but to no last label alone. A host of many labels goes out in several batches."""
    src, dst, held = [], [], 0
    form = lambda: pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])
    for batch in batches:
        for host in batch.column(0):
            host, at = host.as_py(), 0
            while (dot := host.find(".", at)) >= 0 and host.find(".", dot + 1) >= 0:
                src.append(host[at:])
                dst.append(host[dot + 1 :])
                held, at = held + len(src[-1]) + len(dst[-1]), dot + 1
                if held > 1 << 20:
                    yield form()
                    src, dst, held = [], [], 0
    yield form()


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between hosts; pages have host and html."""
    link = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([a-z][a-z0-9+.-]*:)?(//[^/?#\"'\s>]+)"
    found = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), F.lit(2))).alias("to"))
    linked = found.select(F.col("host").alias("src"), ascii_lower(F.expr("substring(to, 3)")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").distinct().union(linked.select("dst")).distinct()
    up = hosts.mapInArrow(_parents, "src string, dst string").distinct().withColumn("n", F.lit(1.0))
    return linked.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def page_rank(graph: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRanks (side, node, rank) of a few graphs at once, which ``side`` tells apart: (side, src, dst, n) and (side,
    node, weight). A walk follows links by their n with probability ``damping``; else, and from where there is no way out, it
    restarts at a node by its weight. The ranks of a side add up to 1; a node that no walk visits has no row.

    What walks visit before their first restart is summed up, step by step; restarts repeat it, so that this sum over its
    total is the rank, dead ends included. A step more is one join and one aggregation; every fifth ends in a table in the
    shared folder. All steps to come add at most so much of what the last five did as five steps of pure damping leave of
    it: it ends when that is below ``tolerance`` of the total, however many steps it takes."""
    total = lambda df, c: {r["side"]: r["s"] for r in df.groupBy("side").agg(F.sum(c).alias("s")).collect()}  # noqa: E731  # a row a side
    over = lambda by: F.create_map(*(F.lit(x) for pair in by.items() for x in pair))[F.col("side")]
    seeds = seeds.where("weight > 0")
    weights = total(seeds, "weight")
    if not weights:
        return seeds.select("side", "node", F.col("weight").alias("rank"))
    base = stash(seeds.select("side", "node", (F.col("weight") / over(weights)).alias("visits")), "restart")
    out = graph.groupBy("side", "src").agg(F.sum("n").alias("out"))
    share = stash(graph.join(out, ["side", "src"]).select("side", F.col("src").alias("node"), "dst", (F.lit(damping) * F.col("n") / F.col("out")).alias("p")), "shares")
    visits, seen, left = base, dict.fromkeys(weights, 1.0), damping**5
    while True:
        last = visits
        for _ in range(5):
            moved = share.join(visits, ["side", "node"]).select("side", F.col("dst").alias("node"), (F.col("p") * F.col("visits")).alias("visits"))
            visits = base.unionAll(moved).groupBy("side", "node").agg(F.sum("visits").alias("visits"))
        visits = stash(visits, "visits")
        if last is not base:
            discard(last)
        before, seen = seen, total(visits, "visits")
        if all((seen[k] - before[k]) * left / (1 - left) <= tolerance * seen[k] for k in seen):
            break
    rank = stash(visits.select("side", "node", (F.col("visits") / over(seen)).alias("rank")), "rank")
    for old in (base, share, visits):
        discard(old)
    return rank


def judge_hosts(judged: DataFrame, graph: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust, blocked) for each host. judged: pages with host, and rule verdicts (null: none)."""
    seeds = judged.where("host <> ''").groupBy(F.col("host").alias("node"), "verdict").agg(F.count("*").cast("double").alias("weight"))
    seeds = stash(seeds, "seeds")
    side = F.when(F.col("verdict") == "allow", 0).when(F.col("verdict") == "block", 1)
    back = graph.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    rank = page_rank(graph.select(F.lit(0).alias("side"), "src", "dst", "n").unionAll(back), seeds.where("verdict is not null").select(side.alias("side"), "node", "weight"), damping, tolerance)
    every = graph.select(F.col("src").alias("node")).union(graph.select(F.col("dst").alias("node"))).union(seeds.select("node")).select("node", F.lit(None).cast("int").alias("side"), F.lit(0.0).alias("rank"))
    sided = lambda k: F.sum(F.when(F.col("side") == k, F.col("rank")).otherwise(0.0))
    both = every.unionAll(rank.select("node", "side", "rank")).groupBy(F.col("node").alias("host")).agg(sided(0).alias("trust"), sided(1).alias("distrust"))
    out = stash(both.withColumn("blocked", F.col("distrust") > F.col("trust") * (1 + tolerance)), "hosts")
    discard(seeds)
    return out


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A null url and one without ``://`` have an empty host and path; such pages, and hosts that neither trust nor distrust
    reaches, are allowed. Equal scores (to within the ranks' tolerance) allow. Rows may repeat, ids may be null; a url and a page may
    be of any length, all of its links count; null pages have none; other columns are not read. An empty table gives no rows.
    """
    require(pages, id_col, url_col, html_col)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", "r.verdict")
    graph = stash(edges(rows.select("host", "html")), "host-edges")
    hosts = judge_hosts(ruled, graph)
    discard(graph)
    out = ruled.join(hosts, "host", "left")
    verdict = F.coalesce(F.col("verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
