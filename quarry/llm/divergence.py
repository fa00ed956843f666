"""Divergence of the sources of each language by the terms that their documents use.

Terms are counted where the texts lie and combined by task; a group that holds a third of the table sends one number a term and
task. The terms of a language are dealt out in blocks. A task gets a block's counts as a dense matrix of groups by terms,
compares all of its groups by broadcasting, and passes on one partial sum for each pair of groups and a heap of the best terms
of each group; partial sums are added up and heaps merged. Many groups are cut into blocks as well, so that no
matrix has more than ``groups_a_block`` rows a side.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, give_back, require, stash

#: Letters are lower-cased, bytes of other characters beyond ASCII stay, all else separates terms. Fixed value of the contract.
_KEPT = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

#: Differing terms that one task combines at once, and bytes of a text that are cut into terms at once.
TERMS_AT_ONCE, BYTES_AT_ONCE = 300_000, 1 << 20

#: The scale of shares. Fixed value of the contract.
SCALE = 1_000_000_000


def terms_of(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists: a very long text is never one list."""
    body = body.translate(_KEPT)
    at = 0
    while at < len(body):
        end = len(body) if len(body) - at <= BYTES_AT_ONCE else body.find(b" ", at + BYTES_AT_ONCE)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


_COUNTS = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, occurrences, documents), and for each group a row without a term."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            k = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        for lang, source, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in terms_of(body):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held > TERMS_AT_ONCE:
                yield from flush()
                held = 0
    yield from flush()
    give_back()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total), exactly: by long division, three digits at a time, so that nothing overflows while totals
    are below 9e15."""
    left = counts + 2
    out = np.zeros(np.broadcast_shapes(left.shape, total.shape), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); shares are at most SCALE + 1, so squares fit."""
    return (p - q) * (p - q) // (p + q)


_TILE = "lang string, part string, source string, item string, value long"


def _tile(top: int):
    """One block of terms and one pair of blocks of groups -> partial sums of pairs, and the best terms of each group.

    Rows: groups (source, n: its N, side, all_n: the language's N, v), terms (term, n: in the language), counts (source, term, n)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        kind = rows.column("kind").to_numpy()
        of = lambda k: rows.filter(pa.array(kind == k))
        groups, terms, counts = of(0), of(1), of(2)
        sources = groups.column("source").to_pylist()
        row = {s: k for k, s in enumerate(sources)}
        names = terms.column("term").to_pylist()
        column = {t: k for k, t in enumerate(names)}
        table = np.zeros((len(sources), len(names)), np.int64)
        at = [row[s] for s in counts.column("source").to_pylist()], [column[t] for t in counts.column("term").to_pylist()]
        table[at] = counts.column("n").to_numpy()
        v = int(groups.column("v")[0].as_py())
        p = shares(table, groups.column("n").to_numpy()[:, None] + 2 * v)
        out: tuple[list, ...] = ([], [], [], [])
        side = groups.column("side").to_numpy()
        for a in range(len(sources)):
            others = np.arange(a + 1, len(sources)) if i == j else np.flatnonzero(side > i) if side[a] == i else np.empty(0, np.int64)
            if len(others):
                sums = divergence(p[a], p[others]).sum(1)
                for column_of, values in zip(out, (["pair"] * len(others), [sources[a]] * len(others), [sources[b] for b in others], sums.tolist()), strict=True):
                    column_of.extend(values)
        if i == j:
            q = shares(terms.column("n").to_numpy(), groups.column("all_n").to_numpy()[:1] + 2 * v)
            for a, source in enumerate(sources):
                better = np.flatnonzero((table[a] > 0) & (p[a] > q))
                heap = heapq.nsmallest(top, zip((-divergence(p[a, better], q[better])).tolist(), (names[k] for k in better), strict=True))
                for column_of, values in zip(out, (["term"] * len(heap), [source] * len(heap), [t.decode("utf-8", "replace") for _, t in heap], [-f for f, _ in heap]), strict=True):
                    column_of.extend(values)
        part, source, item, value = out
        return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, terms_a_block: int = 1024, groups_a_block: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others (part pair: item is the other source)
    and which terms it uses more than the language as a whole (part term: at most ``top``).

    Terms are those in at least ``least_docs`` documents of their language. Shares are smoothed by two occurrences a term and
    scaled to whole numbers; all arithmetic is exact. Null texts, languages and sources are empty ones. A group without terms
    is compared like any other; a language without terms has pairs of value 0. Ties are ordered by item in UTF-8. Rows that
    repeat count again. A text may be of any length. An empty table gives no rows. Other columns are not read, whatever their
    names. Languages and sources of any number: what is held by one task is bounded by ``terms_a_block`` and ``groups_a_block``.
    """
    require(df, lang_col, source_col, text_col)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = stash(counted, "term-counts")
    known = counted.where("term is not null")
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stash(kept.select("lang", "term", "all"), "kept-terms")
    counts = stash(known.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "kept-counts")

    # groups of each language: a few numbers each
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counted.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_n", F.lit(0)).alias("all_n"), (place / groups_a_block).cast("int").alias("side"))
    groups = stash(groups, "groups")
    most = by_lang.agg(F.max("v")).first()[0] or 1
    sides = groups.groupBy("lang").agg((F.max("side") + 1).alias("sides"))
    block = F.pmod(F.xxhash64("term"), F.lit(-(-most // terms_a_block))).cast("int").alias("block")

    paired = lambda d: d.select("*", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")).select("*", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    names = "lang", "block", "i", "j", "kind", "source", "term", "n", "side", "all_n", "v"
    none: Column = F.lit(None)

    def form(d: DataFrame, kind: int, **more: Column) -> DataFrame:
        kinds = {"source": "string", "term": "binary", "n": "long", "side": "int", "all_n": "long", "v": "long"}
        have = set(d.columns)
        return d.select("lang", "block", "i", "j", F.lit(kind).alias("kind"), *(more.get(c, F.col(c) if c in have else none).cast(t).alias(c) for c, t in kinds.items()))

    placed = groups.join(sides, "lang")
    head = paired(placed).join(kept.select("lang", block).distinct(), "lang")
    every = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda a: F.transform(F.sequence(a, F.col("sides") - 1), lambda b: F.struct(a.alias("i"), b.alias("j"))))))
    of_terms = kept.select("lang", "term", F.col("all").alias("n"), block).join(sides, "lang").select("*", every.alias("at")).select("lang", "term", "n", "block", "at.i", "at.j")
    of_counts = paired(counts.select("*", block).join(placed.select("lang", "source", "side", "sides"), ["lang", "source"])).select("lang", "source", "term", "n", "block", "i", "j")
    tiles = form(head, 0).unionAll(form(of_terms, 1)).unionAll(form(of_counts, 2)).select(*names)
    found = stash(tiles.groupBy("lang", "block", "i", "j").applyInArrow(_tile(top), _TILE), "tiles")

    one_way = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("v = 0").select("lang", "source")
    without = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(without).withColumn("part", F.lit("pair"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out = stash(pairs.withColumn("rank", F.row_number().over(w)).unionByName(best).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    for old in (counted, kept, counts, groups, found):
        discard(old)
    return out
