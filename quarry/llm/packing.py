"""Best-fit packing of token sequences by patterns.

Texts become token ids, and pieces of at most ``limit`` tokens. What is packed is the histogram of piece lengths, which
has at most ``limit`` entries however many documents there are. Patterns of few lengths that fill a sequence well are
enumerated; non-negative least squares fits how often each is used; the counts are rounded down so that no length is
used more often than it occurs; what remains is packed by best fit, again on counts. The plan is a list of runs:
"the pieces of this length from rank a on go to sequences s, s+1, ... at this offset". A piece finds its run from its
rank among the pieces of its length; ranks come from counts by task, so no length is ever gathered in one task.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, require, stash

CACHE = 250_000  # words whose ids a task remembers


#: A word of letters with punctuation after it. ASCII punctuation makes one token run of its own in this vocabulary.
_PLAIN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")

_MARKS = frozenset((b"", b".", b",", b"!", b"?", b";", b":"))


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Tokenizer:
    """Ids of whole texts. White space separates tokens of this vocabulary, so a word's ids don't depend on its neighbours."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Backend

        self.backend, self.cache, self.parts, self.letters = Backend.from_file(path), {}, {}, _byte_letters()
        self.model = self.backend.model

    def encode(self, text: str) -> list[bytes]:
        """The ids of each word as little-endian 32-bit words."""
        words = text.encode("utf-8", "replace").split()  # ASCII white space only: each part may hold more
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = [self._add(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _add(self, word: bytes) -> bytes:
        if (ids := self.cache.get(word)) is not None:
            return ids
        core, mark = (word, b"") if word.isalpha() else (word[:-1], word[-1:])
        if core.isalpha() and mark in _MARKS:  # ASCII letters, perhaps with one mark after them
            ids = self._known(core.lower()) + (self._known(mark) if mark else b"")
        else:
            text = word.decode("utf-8")
            # Below U+0250 letters are in normal form and lower-case alike everywhere, but for U+0130.
            if (m := _PLAIN.fullmatch(text)) and m[1].isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text)):
                ids = self._known(m[1].lower().encode()) + (self._known(m[2].encode()) if m[2] else b"")
            else:
                ids = array("I", self.backend.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 256:
            self.cache[word] = ids
        return ids

    def _known(self, key: bytes) -> bytes:
        """Ids of one run of letters or punctuation, by the merges alone."""
        if (ids := self.parts.get(key)) is None:
            if len(self.parts) > CACHE:
                self.parts.clear()
            tokens = self.model.tokenize(key.decode() if key.isascii() else "".join([self.letters[b] for b in key]))
            ids = self.parts[key] = array("I", [t.id for t in tokens]).tobytes()
        return ids


def _pieces(path: str, end_id: int, limit: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, task, ranks = Tokenizer(path), TaskContext.get().partitionId(), defaultdict(int)
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                ids = b"".join([*tokenizer.encode(text or ""), end])
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), task, ranks[n]))
                    ranks[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"]).astype({"doc_id": "Int64"})
        del tokenizer
        give_back()

    return run


def patterns(lengths: np.ndarray, limit: int, most: int = 3000) -> list[tuple[int, ...]]:
    """Combinations of few lengths, each as full as the histogram allows: for every longest length one with one, two
    and three partners, the last partner being the longest that still fits."""
    have = sorted(lengths.tolist())
    out: dict[tuple[int, ...], int] = {}

    def longest(room: int) -> int | None:
        k = bisect.bisect_right(have, room)
        return have[k - 1] if k else None

    steps = [have[i] for i in np.unique(np.linspace(0, len(have) - 1, min(24, len(have))).astype(int))]
    for first in reversed(have):
        for chosen in [(first,), *((first, s) for s in steps), *((first, s, t) for s in steps[::3] for t in steps[::3])]:
            room = limit - sum(chosen)
            if room < 0:
                continue
            full = list(chosen)
            while (x := longest(room)) is not None and len(full) < 6:
                full.append(x)
                room -= x
            p = tuple(sorted(full, reverse=True))
            out[p] = room
    best = sorted(out, key=lambda p: (out[p], len(p), p))
    covered, kept = defaultdict(int), []
    for p in best:  # the fullest first, and for each length some in any case
        if len(kept) < most or any(covered[x] < 2 for x in p):
            kept.append(p)
            for x in set(p):
                covered[x] += 1
    return kept


def fit_counts(matrix: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that the histogram is met. Accelerated projected
    gradients on a sparse matrix; rows are weighted by the square root of the length, so that tokens count."""
    where = {int(x): i for i, x in enumerate(lengths)}
    row = np.array([where[x] for p in matrix for x in p])
    col = np.repeat(np.arange(len(matrix)), [len(p) for p in matrix])
    weight = np.sqrt(lengths / lengths.max())
    scale = max(1.0, float(counts.max()))
    b = counts / scale * weight
    forward = lambda x: np.bincount(row, x[col], len(lengths)) * weight
    back = lambda r: np.bincount(col, (r * weight)[row], len(matrix))
    v = np.ones(len(matrix))
    for _ in range(20):
        v = back(forward(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    step, x = 1 / (1.05 * norm), np.zeros(len(matrix))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - b))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def plan(histogram: dict[int, int], limit: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """length -> runs (ranks below, first sequence less first rank, offset), and the number of sequences.

    Depends on the histogram alone; the runs are in the order of their ranks."""
    left = {x: c for x, c in histogram.items() if c}
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequences = 0

    def put(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at = 0
        for x in pattern:
            used[x] += times
            runs[x].append((used[x], sequences - (used[x] - times), at))
            left[x] -= times
            if not left[x]:
                del left[x]
            at += x
        sequences += times

    if left:
        lengths = np.array(sorted(left))
        matrix = patterns(lengths, limit)
        need = [dict(zip(*np.unique(p, return_counts=True), strict=True)) for p in matrix]
        times = fit_counts(matrix, lengths, np.array([left[x] for x in lengths.tolist()], float))
        for k in np.argsort([limit - sum(p) for p in matrix], kind="stable"):
            n = min([int(times[k]), *(left.get(int(x), 0) // int(c) for x, c in need[k].items())])
            if n:
                put(matrix[k], n)
    have = sorted(left)
    while left:  # best fit, longest first; as many sequences alike at once as the counts allow
        while have[-1] not in left:
            have.pop()
        chosen, room = [have[-1]], limit - have[-1]
        need_now = {have[-1]: 1}
        while (k := bisect.bisect_right(have, room)) and room:
            k -= 1
            while k >= 0 and left.get(have[k], 0) <= need_now.get(have[k], 0):
                if have[k] not in left:
                    del have[k]
                k -= 1
            if k < 0:
                break
            chosen.append(have[k])
            need_now[have[k]] = need_now.get(have[k], 0) + 1
            room -= have[k]
        put(tuple(chosen), min(left[x] // c for x, c in need_now.items()))
    return dict(runs), sequences


def _place(runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in it:
            length, rank = length.to_numpy(), rank.to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                below, shift, at = runs[int(x)]
                k = np.searchsorted(below, rank[own], "right")
                sequence[own], offset[own] = rank[own] + shift[k], at[k]
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return run


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then end_id; null texts are empty and give the end alone. Only longer documents
    are cut, and texts may be of any length. A sequence holds whole pieces without gaps; pieces of equal length are alike, and
    take their places in the order of tasks and rows. Rows that repeat an id are documents of their own. Other columns are
    not read, whatever their names. An empty table gives no rows. Ids must be integers or null. The tokenizer's file must be
    at the same path on every executor.
    """
    require(df, id_col, text_col)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = stash(rows.mapInPandas(_pieces(tokenizer_path, end_id, limit), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    runs, _ = plan(histogram, limit)
    runs = {x: tuple(np.array(c) for c in zip(*r, strict=True)) for x, r in runs.items()}
    sent = spark.sparkContext.broadcast(runs)  # bounded by limit and the number of patterns

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _place(sent.value)(it)

    ranked = cut.join(before, ["length", "task"]).withColumn("at", place("length", F.col("before") + F.col("rank_in_task")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
