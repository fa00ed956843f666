"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive benchmark words (a shorter item is one window of its own length). All
patterns of one length share a shift table: the last ``block`` words under the search position say how far the
search may jump without missing an occurrence. A shift of zero leads to the bucket of patterns that end in this
block, and direct comparison of the words confirms an occurrence.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered, require, stash

#: Bytes that separate words, after A-Z are lower-cased: \x00-\x2F, \x3A-\x60, \x7B-\x7F. Fixed value of the contract.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    n = min(len(words), window)
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


class WuManber:
    """Patterns of one length, each with a list of owners."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], block: int = 3):
        self.length = len(next(iter(patterns)))
        self.block = min(block, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for p, owners in patterns.items():
            for end in range(self.block, self.length + 1):
                key = p[end - self.block : end]
                far = self.length - end
                if far < self.shift.get(key, self.default):
                    self.shift[key] = far
            self.buckets[p[self.length - self.block :]].append((p, owners))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, owners) of every occurrence."""
        at, n, shift, default, block, length = self.length, len(words), self.shift, self.default, self.block, self.length
        while at <= n:
            key = tuple(words[at - block : at])
            far = shift.get(key, default)
            if far:
                at += far
                continue
            found = tuple(words[at - length : at])
            for p, owners in self.buckets[key]:
                if p == found:
                    yield at - length, owners
            at += 1


def matchers(patterns: list[tuple[bytes, list]], block: int = 3) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(dict)
    for text, owners in patterns:
        p = tuple(text.split(b" "))
        by_length[len(p)].setdefault(p, []).extend(owners)
    return [WuManber(p, block) for p in by_length.values()]


def _ids_first(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _windows(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {(b" ".join(w), i if isinstance(i, str) else None) for i, t in zip(f["item"], f["text"], strict=True) for w in windows_of(words_of(t), window)}
            yield pd.DataFrame(sorted(out, key=lambda x: (x[0], _ids_first(x[1]))), columns=["pattern", "item"])

    return run


def pattern_table(benchmark: DataFrame, window: int, patterns_at_once: int, id_col: str = "item_id", text_col: str = "text", null_ids: bool = False) -> tuple[DataFrame, int]:
    """A stashed table (pattern, item, block) of the benchmark's distinct windows with the ids (as strings) of their items, and the
    number of blocks. A pattern is in one block; blocks have about patterns_at_once rows or fewer."""
    require(benchmark, id_col, text_col)
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    items = items if null_ids else items.where("item is not null")
    rows = stash(items.mapInPandas(_windows(window), "pattern binary, item string").distinct(), "patterns")
    n = rows.count()
    blocks = max(1, -(-2 * n // patterns_at_once)) if n > patterns_at_once else 1
    return rows.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))), blocks


def patterns_of(table: DataFrame, block: int) -> list[tuple[bytes, list[str | None]]]:
    found: dict[bytes, list[str | None]] = defaultdict(list)
    for r in table.where(F.col("block") == block).toLocalIterator():
        found[bytes(r["pattern"])].append(r["item"])
    return sorted(found.items(), key=lambda x: x[0])


_HITS = "struct<n_words long, hits array<long>, items array<string>>"


def _scan(sent: Broadcast, block: int):
    """The search for one block of patterns as a column function."""

    @F.pandas_udf(_HITS)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        search = matchers(sent.value, block)
        for s in it:
            n_words, hits, items = [], [], []
            for text in s:
                words = words_of(text)
                runs: list[int] = []  # start, end, start, end: merged
                own: set[str | None] = set()
                for m in search:
                    for first, owners in m.search(words):
                        own.update(owners)
                        if runs and runs[-2] <= first <= runs[-1]:
                            runs[-1] = max(runs[-1], first + m.length)
                        else:
                            runs += [first, first + m.length]
                n_words.append(len(words))
                hits.append(runs)
                items.append(sorted(own, key=_ids_first))
            yield pd.DataFrame({"n_words": n_words, "hits": hits, "items": items})

    return run


def _merged(*columns):
    """From the number of words and, for each block, a text's hits and items."""

    @F.pandas_udf("struct<n_words long, n_hit long, n_items long, items_sha256 string, items array<string>>")
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for f in it:
            rows = []
            for n_words, hits, items in zip(*f, strict=True):
                runs = sorted((h[i], h[i + 1]) for h in hits for i in range(0, len(h), 2))
                hit = end = 0
                for a, b in runs:
                    hit += max(0, b - max(a, end))
                    end = max(end, b)
                own = {x for i in items for x in i}
                named = sorted(own - {None})
                rows.append((n_words, hit, len(own), hashlib.sha256(",".join(named).encode()).hexdigest(), named))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "items"])

    return run(*columns)


def contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, block: int = 3, patterns_at_once: int = 500_000, null_ids: bool = False
) -> DataFrame:
    """(row, found) for each row of df: the row as a struct, so that no names clash, and a struct n_words, n_hit, n_items, items_sha256,
    items.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A word is hit if it
    lies in an occurrence of any window. Null and empty texts have no words; whole texts are searched, of any length; items
    without words have no window; items that repeat an id count once. Items with a null id are left out unless
    ``null_ids``: then their windows hit as any others do, and together they count as one item that is not in the list.
    Rows of df may repeat. An empty benchmark hits nothing; an empty df gives no rows.

    The benchmark may be of any size: at most about ``patterns_at_once`` windows are on the driver and in a worker at a time. With
    so few, the search is a projection and nothing is shuffled. More are searched for block by block, each a pass over the
    texts that writes what it hit; a block is freed before the next is read.
    """
    require(df, text_col)
    spark = df.sparkSession
    patterns, blocks = pattern_table(benchmark, window, patterns_at_once, null_ids=null_ids)
    if blocks == 1:
        sent = spark.sparkContext.broadcast(patterns_of(patterns, 0))
        hit = df.select(F.struct(*df.columns).alias("row"), _scan(sent, block)(F.col(text_col)).alias("h"))
        return hit.select("row", _merged("h.n_words", F.array("h.hits"), F.array("h.items")).alias("found"))
    rows, parts = numbered(df, "scanned", F.lit(0).alias("_")).drop("_"), []
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(patterns_of(patterns, k))
        hit = rows.select("n", _scan(sent, block)(F.col(f"row.{text_col}")).alias("h")).select("n", "h.*")
        parts.append(stash(hit if k == 0 else hit.where(F.size("hits") > 0), "hits"))  # the first has every row
        sent.destroy()
    every = functools.reduce(DataFrame.unionAll, parts)
    found = every.groupBy("n").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    return rows.join(found.select("n", _merged("n_words", "hits", "items").alias("found")), "n").select("row", "found")
