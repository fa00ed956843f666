"""Exact ranks, sums and distinct labels of rolling time windows.

The time of each group is cut into tiles as long as the longest window; what lies in a tile goes to its own task and to that of the
tile after it. Equal points (group, time, value, label) are one point with a weight before they are dealt out, so that a
tile is bounded by its seconds, not by its rows. A task sorts its points by time and builds a merge-sort tree over them: each node
has the values of its positions in order, and from each of its places the place in its left child (fractional cascading).
A rank is found by searching the values of the root: a window's weight below a candidate is the sum over the nodes that make up
the window, one step a level.

A tile with more than ``at_once`` points is split by value into chunks. A first pass weighs each chunk in each window, sums of
these show in which chunk a rank lies, and a second pass finds it there. Labels are split likewise; their numbers add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, require, stash


class MergeSortTree:
    """Over values at positions 0 to n - 1, with weights of 1 if none are given. All methods take arrays of equal length."""

    def __init__(self, values: np.ndarray, weights: np.ndarray | None = None):
        n = len(values)
        self.depth = n.bit_length()
        size = 1 << self.depth
        order = np.argsort(values, kind="stable")
        self.n, self.values = n, values[order]
        heavy = np.zeros(size, np.int64)
        heavy[:n] = 1 if weights is None else weights
        at = np.concatenate((order, np.arange(n, size)))  # positions in the order of their values; those beyond n come last
        self.left: list = [None] * (self.depth + 1)  # by level, node and place: how many of the values before are in the left child
        self.weight: list = [None] * (self.depth + 1)  # and their weight
        for k in range(self.depth, -1, -1):
            width = 1 << k
            self.weight[k] = self._sums(heavy[at].reshape(-1, width))
            if k:
                left = (at >> (k - 1) & 1 == 0).reshape(-1, width)
                self.left[k] = before = self._sums(left, np.int32)
                place = np.where(left, before[:, :-1], width // 2 + np.arange(width) - before[:, :-1]) + width * np.arange(size // width)[:, None]
                down = np.empty_like(at)
                down[place.ravel()] = at
                at = down

    @staticmethod
    def _sums(x: np.ndarray, kind: type = np.int64) -> np.ndarray:
        out = np.zeros((x.shape[0], x.shape[1] + 1), kind)
        np.cumsum(x, 1, out=out[:, 1:])
        return out

    def place(self, values: np.ndarray) -> np.ndarray:
        """How many values are smaller."""
        return np.searchsorted(self.values, values, "left")

    def before(self, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The weight, of the positions before ``end``, of the first ``place`` values."""
        total, node = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        for k in range(self.depth, 0, -1):
            left = self.left[k][node, place]
            right = end >> (k - 1) & 1
            node *= 2
            total += np.where(right, self.weight[k - 1][node, left], 0)
            place = np.where(right, place - left, left)
            node += right
        return total

    def within(self, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before(end, place) - self.before(start, place)

    def select(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value number ``rank``, counted from 1, of positions start to end - 1, which weigh at least so much."""
        low, high = np.zeros(len(rank), np.int64), np.full(len(rank), self.n)  # the first `low` values weigh less than rank, the first `high` do not
        for _ in range(self.depth):
            middle = (low + high) // 2
            enough = self.within(start, end, middle) >= rank
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        return self.values[np.maximum(high, 1) - 1]


def _sorted(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns without nulls, ordered by the first one."""
    columns = [rows.column(n).to_numpy() for n in names]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _label_counts(rows: pa.Table, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many labels occur at times from start to before end. Of a label's times in a window only the first has none in it before: it is
    counted by the place of the window's start among the times that came before."""
    rows = rows.filter(rows.column("label").is_valid())
    if not rows.num_rows:
        return np.zeros(len(start), np.int64)
    codes = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    pairs = np.unique(np.stack((codes, rows.column("t").to_numpy()), 1), axis=0)
    last = np.full(len(pairs), np.iinfo(np.int64).min)
    same = pairs[1:, 0] == pairs[:-1, 0]
    last[1:][same] = pairs[:-1, 1][same]
    order = np.argsort(pairs[:, 1], kind="stable")
    t = pairs[order, 1]
    tree = MergeSortTree(last[order])
    return tree.within(np.searchsorted(t, start), np.searchsorted(t, end), tree.place(start))


def _windows(t: np.ndarray, windows: Sequence[int]) -> tuple[np.ndarray, ...]:
    asked = np.unique(t)
    end, w = np.tile(asked, len(windows)), np.repeat(np.array(windows, np.int64), len(asked))
    return end, w, end - w


def _rank(m: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return -(-m * share[0] // share[1])


def _whole(windows: Sequence[int], shares: Sequence[tuple[int, int]], length: int):
    """All points of one group's tile (t, value, label, n), and those of the tile before it -> a row for each of its times and windows."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group, tile = key[0].as_py(), key[1].as_py()
        t, n = _sorted(rows, "t", "n")
        end, w, start = _windows(t[t // length == tile], windows)
        events = np.concatenate(([0], np.cumsum(n)))
        out = {"g": pa.array([group] * len(end), pa.string()), "t": end, "w": w, "n_events": events[np.searchsorted(t, end)] - events[np.searchsorted(t, start)], "n_labels": _label_counts(rows, start, end)}
        t, value, n = _sorted(rows.filter(rows.column("value").is_valid()), "t", "value", "n")
        a, b = np.searchsorted(t, start), np.searchsorted(t, end)
        m, sums = (np.concatenate(([0], np.cumsum(x))) for x in (n, n * value))
        m = m[b] - m[a]
        out["total"] = sums[b] - sums[a]
        tree, none = MergeSortTree(value, n) if len(value) else None, m == 0
        for i, share in enumerate(shares):
            found = np.zeros(len(m), np.int64)
            if tree is not None:
                found[~none] = tree.select(a[~none], b[~none], _rank(m[~none], share))
            out[f"q{i}"] = pa.array(found, pa.int64(), mask=none)
        return pa.table({k: out[k] for k in ("g", "t", "w", "n_events", "total", "n_labels", *(f"q{i}" for i in range(len(shares))))})

    return run


def _weighed(windows: Sequence[int], length: int, labels: bool):
    """One chunk of a tile, and the tile's times (asked) -> for each time and window the chunk's events, total and number of values; or of labels."""

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        group, tile, chunk = (k.as_py() for k in key)
        end, w, start = _windows(asked.column("t").to_numpy(), windows)
        if labels:
            x = _label_counts(rows, start, end)
            sums = x, x, x
        else:
            t, value, n = _sorted(rows, "t", "value", "n")
            a, b = np.searchsorted(t, start), np.searchsorted(t, end)
            sums = tuple(c[b] - c[a] for c in (np.concatenate(([0], np.cumsum(x))) for x in (n, n * value)))
            sums = sums[0], sums[1], sums[0]
        return pa.table({"g": pa.array([group] * len(end), pa.string()), "tile": pa.array([tile] * len(end), pa.int64()), "chunk": pa.array([chunk] * len(end), pa.int64()), "t": end, "w": w, "n": sums[0], "total": sums[1], "m": sums[2]})

    return run


def _chosen(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
    """One chunk of a tile, and the ranks (t, w, q, rank) that lie in it -> their values."""
    end, w, rank = (asked.column(c).to_numpy() for c in ("t", "w", "rank"))
    t, value, n = _sorted(rows, "t", "value", "n")
    found = MergeSortTree(value, n).select(np.searchsorted(t, end - w), np.searchsorted(t, end), rank) if len(end) else np.zeros(0, np.int64)
    return pa.table({"g": pa.array([key[0].as_py()] * len(end), pa.string()), "t": end, "w": w, "q": asked.column("q"), "value": found})


def tile_of(length: int) -> Column:
    """floor(t / length), in whole numbers."""
    return F.expr(f"(t - pmod(t, {length})) div {length}")


def _crowded(points: DataFrame, tiles: Column, crowded: DataFrame, windows: Sequence[int], shares: Sequence[tuple[int, int]], length: int, at_once: int) -> DataFrame:
    """As _whole() does, for tiles with more than at_once points, chunk by chunk."""
    keys = ["g", "tile"]
    same = lambda a, b: reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in keys))
    dealt = points.select("*", F.explode(tiles).alias("tile"))
    dealt = stash(dealt.join(crowded, same(dealt, crowded), "left_semi"), "crowded-points")
    asked = stash(dealt.where(F.col("tile") == tile_of(length)).select(*keys, "t").distinct(), "crowded-times")
    def chunked(points: DataFrame, by: str) -> DataFrame:
        """points (g, tile, t, by, ...) with their chunk: each has the points of some values (labels) that follow each other."""
        upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        chunks = points.groupBy(*keys, by).agg(F.count("*").alias("points")).select(*keys, by, F.floor(F.coalesce(F.sum("points").over(upto), F.lit(0)) / at_once).alias("chunk"))
        chunks = stash(chunks, "crowded-chunks")
        out = points.join(chunks, same(points, chunks) & (points[by] == chunks[by])).select(*(points[c] for c in points.columns), "chunk")
        out = stash(out, "crowded-values")
        discard(chunks)
        return out

    valued = chunked(dealt.where("value is not null").groupBy(*keys, "t", "value").agg(F.sum("n").alias("n")), "value")
    lettered = chunked(dealt.where("label is not null").select(*keys, "t", "label").distinct(), "label")
    every = dealt.groupBy(*keys, "t").agg(F.sum("n").alias("n")).select(*keys, F.lit(0).cast("long").alias("chunk"), "t", F.lit(0).cast("long").alias("value"), "n")
    kind = "g string, tile long, chunk long, t long, w long, n long, total long, m long"

    def weigh(rows: DataFrame, labels: bool = False) -> DataFrame:
        parts = rows.select(F.col("g").alias("of"), F.col("tile").alias("at"), F.col("chunk").alias("part")).distinct()
        times = asked.join(parts, F.col("g").eqNullSafe(F.col("of")) & (F.col("tile") == F.col("at"))).select(*keys, F.col("part").alias("chunk"), "t")
        return times.groupBy(*keys, "chunk").cogroup(rows.groupBy(*keys, "chunk")).applyInArrow(_weighed(windows, length, labels), kind)

    weighed = stash(weigh(valued), "crowded-weights")
    by = Window.partitionBy("g", "t", "w")
    m = F.sum("m").over(by)
    below = F.coalesce(F.sum("m").over(by.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.expr(f"(_m * {a} + {b - 1}) div {b}").alias("k")) for i, (a, b) in enumerate(shares))))
    lie = weighed.select(*keys, "chunk", "t", "w", "m", m.alias("_m"), below.alias("below")).where("_m > 0").select("*", rank.alias("r")).select(*keys, "chunk", "t", "w", "m", "r.q", (F.col("r.k") - F.col("below")).alias("rank"))
    lie = lie.where("rank > 0 and rank <= m")
    found = lie.groupBy(*keys, "chunk").cogroup(valued.groupBy(*keys, "chunk")).applyInArrow(_chosen, "g string, t long, w long, q int, value long")
    parts = weigh(every).select("g", "t", "w", F.col("n").alias("n_events"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("n_labels"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("long").alias("value"))
    zero = F.lit(0).cast("long")
    parts = parts.unionAll(weighed.select("g", "t", "w", zero, "total", zero, F.lit(None).cast("int"), F.lit(None).cast("long")))
    parts = parts.unionAll(weigh(lettered, True).select("g", "t", "w", zero, zero, "n", F.lit(None).cast("int"), F.lit(None).cast("long")))
    parts = parts.unionAll(found.select("g", "t", "w", zero, zero, zero, "q", "value"))
    out = parts.groupBy("g", "t", "w").agg(*(F.sum(c).alias(c) for c in ("n_events", "total", "n_labels")), *(F.max(F.when(F.col("q") == i, F.col("value"))).alias(f"q{i}") for i in range(len(shares))))
    out = stash(out, "crowded-windows")
    for old in (dealt, asked, valued, lettered, weighed):
        discard(old)
    return out


def rolling_ranks(rows: DataFrame, windows: Sequence[int], shares: Sequence[tuple[int, int]] = ((1, 2), (90, 100)), at_once: int = 1 << 18) -> DataFrame:
    """(id, w, t, n_events, total, n_labels, q0, ...): for each row (id, g, t, value, label) and window length w, what the rows of its group at
    times from t - w to before t are: how many, the sum of their values, the number of differing labels, and for each share
    (a, b) the value number ceil(m * a / b) of the m values in ascending order.

    Null groups are one group. Rows without a time have empty windows and are in no one's; null values and labels are not counted
    as such, but their rows are events. Without values the sum is 0 and ranks are null. Rows may repeat and times tie: rows
    at one time are not in each other's windows. An empty table gives no rows. Times and values are whole numbers; columns beyond
    those named are not read.
    """
    require(rows, "id", "g", "t", "value", "label")
    length = max(windows)
    rows = stash(rows.select("id", F.col("g").cast("string").alias("g"), F.col("t").cast("long").alias("t"), F.col("value").cast("long").alias("value"), F.col("label").cast("string").alias("label")), "rolling-rows")
    points = stash(rows.where("t is not null").groupBy("g", "t", "value", "label").agg(F.count("*").alias("n")), "rolling-points")
    tiles = F.array(tile_of(length), tile_of(length) + 1)
    dealt = points.select("*", F.explode(tiles).alias("tile"))
    crowded = stash(dealt.groupBy("g", "tile").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("g", "tile"), "crowded")
    columns = "g string, t long, w long, n_events long, total long, n_labels long" + "".join(f", q{i} long" for i in range(len(shares)))
    some = not crowded.isEmpty()
    if some:
        dealt = dealt.join(crowded, dealt["g"].eqNullSafe(crowded["g"]) & (dealt["tile"] == crowded["tile"]), "left_anti")
    found = dealt.groupBy("g", "tile").applyInArrow(_whole(windows, shares, length), columns)
    if some:
        found = found.unionByName(_crowded(points, tiles, crowded, windows, shares, length, at_once))
    found = stash(found, "rolling-windows")  # a table, so that rows at one time can be split in the join
    each = rows.select("id", F.col("g").alias("own"), F.col("t").alias("at"), F.explode(F.array(*(F.lit(w).cast("long") for w in windows))).alias("for"))
    out = each.join(found, F.col("own").eqNullSafe(F.col("g")) & (F.col("at") == F.col("t")) & (F.col("for") == F.col("w")), "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.col("for").alias("w"), F.col("at").alias("t"), *(F.coalesce(c, zero).alias(c) for c in ("n_events", "total", "n_labels")), *(f"q{i}" for i in range(len(shares))))


def event_seconds(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id as text) mod 10000) / 6), in whole numbers."""
    x = doc_id.cast("long") + F.crc32(doc_id.cast("string").cast("binary")) % 10000
    return (x - F.pmod(x, F.lit(6))) * 10


def document_windows(docs: DataFrame, windows: Sequence[int] = (600, 43200), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", at_once: int = 1 << 18) -> DataFrame:
    """Two rows per row of docs: doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars over the documents of the
    same source before it. Lengths are code points of whole texts, however long; a null text has no length, an empty one 0. A null id has
    no time: its windows are empty. Null sources are one source, null languages none. Other columns are not read. See rolling_ranks()."""
    require(docs, id_col, text_col, lang_col, source_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("g"), event_seconds(F.col(id_col)).alias("t"), F.length(text_col).alias("value"), F.col(lang_col).alias("label"))
    names = {"id": "doc_id", "w": "window_s", "t": "event_s", "n_events": "n_events", "total": "sum_chars", "n_labels": "n_langs", "q0": "median_chars", "q1": "high_chars"}
    return rolling_ranks(rows, windows, at_once=at_once).select(*(F.col(a).alias(b) for a, b in names.items()))
