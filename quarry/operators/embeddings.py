"""Embeddings learned from the corpus: co-occurrence counts, positive mutual information, and its leading singular vectors by a
randomised range finder.

Counting and every product with the matrix are Spark jobs over all texts. What the driver holds is bounded by the vocabulary
(``size`` words, a parameter), whatever the corpus: a few dense columns, orthonormalised between two products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import spread
from quarry.sources.store import stored
from quarry.workers import give_back

#: Pairs of neighbouring words that a task holds at once: 16 MB, in a few copies.
PAIRS_AT_ONCE = 4_000_000

#: Bytes of text whose words a task holds at once, if no single text is longer.
TEXT_AT_ONCE = 2 << 20

#: Words of texts whose vectors a task gathers at once: of 64 dimensions 8 MB.
WORDS_AT_ONCE = 1 << 14

#: Words with their numbers of documents that a task holds before it adds them up: some 20 MB, in a few copies.
TERMS_AT_ONCE = 1_000_000

#: Words on a side of a tile of the matrix, so that 16 bits name a cell.
SIDE = 256


def _split(texts: Iterable[str | None]) -> Iterator[pa.ListArray]:
    """The words of some texts at a time, in their order: as `retrieval.words_of` gives them, but for empty ones at a text's ends."""
    held, n = [], 0
    for t in texts:
        held.append((t or "").lower().encode("utf-8", "replace"))
        n += len(held[-1])
        if n >= TEXT_AT_ONCE:
            yield pc.ascii_split_whitespace(pa.array(held, pa.string()))
            held, n = [], 0
    if held:
        yield pc.ascii_split_whitespace(pa.array(held, pa.string()))


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (term, df): in how many texts each word is, combined as far as memory allows."""
    held, n = [], 0

    def flush() -> list[pa.RecordBatch]:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"]).combine_chunks().to_batches()

    for batch in batches:
        for split in _split(x.as_py() for x in batch.column(0)):
            words = split.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
            once = np.unique(text * len(words.dictionary) + words.indices.to_numpy()) % max(1, len(words.dictionary))
            part = pa.table({"term": words.dictionary.cast(pa.binary()), "df": np.bincount(once, minlength=len(words.dictionary))})
            held.append(part.filter(pc.not_equal(pc.binary_length(part["term"]), 0)))
            n += len(held[-1])
        if n > TERMS_AT_ONCE:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()
    held = []
    give_back()


def vocabulary(docs: DataFrame, size: int = 20_000, least_docs: int = 5) -> DataFrame:
    """(word, df, place): the words in most documents, ties by word, numbered from 0."""
    counted = spread(docs.select("text")).mapInArrow(_documents_of, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    first = counted.where(F.col("df") >= least_docs).orderBy(F.desc("df"), "term").limit(size)
    rows = [(bytes(r["term"]).decode("utf-8", "replace"), r["df"], i) for i, r in enumerate(first.collect())]
    return docs.sparkSession.createDataFrame(rows, "word string, df long, place int")


def _places(words: DataFrame) -> dict[bytes, int]:
    return {r["word"].encode(): r["place"] for r in words.collect()}


class _Found:
    """The places of the words of many texts at once, -1 for others: words as `retrieval.words_of` gives them."""

    def __init__(self, place: dict[bytes, int]):
        self.words, self.places = pa.array(list(place), pa.string()), np.array([*place.values(), -1], np.int32)

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, number of words of each text) of some texts at a time, in their order."""
        for split in _split(texts):
            at = pc.fill_null(pc.index_in(split.flatten(), value_set=self.words), len(self.words))
            yield self.places[at.to_numpy(zero_copy_only=False)], np.diff(split.offsets.to_numpy())


def _tiles(n: int) -> int:
    """How many tiles a side of a matrix of n words has: words are dealt out to them by turns, so that each has frequent and rare ones."""
    return max(16, -(-n // SIDE))


def _pairs(place: dict[bytes, int], window: int):
    """(text) -> (i, j, cells, n): how often two words are at a distance of at most ``window``, in either order, by tile of the matrix and combined
    as far as memory allows. Of a pair, only the cell on one side of the diagonal is counted."""
    tiles = _tiles(len(place))
    kind = np.int32 if tiles * tiles * SIDE * SIDE < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = _Found(place), [], 0

        def flush() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            tile = codes // (SIDE * SIDE)
            start = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1))
            cells, counts, ends = (codes % (SIDE * SIDE)).astype(np.uint16), counts.astype(np.uint32), [*start[1:], len(codes)]
            by = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array((tile[start] // tiles).astype(np.int32)), pa.array((tile[start] % tiles).astype(np.int32)), by(cells), by(counts)], ["i", "j", "cells", "n"])

        for batch in batches:
            for at, words in found.parts(x.as_py() for x in batch.column(0)):
                apart = np.full(len(at) + window * len(words), -1, kind)  # texts are kept apart by words without a place
                apart[np.arange(len(at)) + np.repeat(np.arange(len(words)) * window, words)] = np.where(at < 0, -1, at % tiles * SIDE + at // tiles)
                for k in range(1, window + 1):
                    a, b = apart[:-k], apart[k:]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    held.append((a // SIDE * tiles + b // SIDE) * (SIDE * SIDE) + a % SIDE * SIDE + b % SIDE)
                    n += len(a)
                if n > PAIRS_AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        held = []
        give_back()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of tiles, sorted by tile -> whole tiles. Those on the diagonal get both sides of it; of others there is one for both."""
    at, sums = None, np.zeros((SIDE, SIDE), np.int64)

    def whole() -> pa.RecordBatch:
        out = (sums + sums.T if at[0] == at[1] else sums).ravel()
        cells = np.flatnonzero(out)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([out[cells].tobytes()], pa.binary())], ["i", "j", "cells", "n"])

    for batch in batches:
        for i, j, cells, n in zip(*(batch.column(c) for c in range(4)), strict=True):
            if at and at != (i.as_py(), j.as_py()):
                yield whole()
                sums[:] = 0
            at = i.as_py(), j.as_py()
            sums.ravel()[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)
    if at:
        yield whole()


TILES = "i int, j int, cells binary, n binary"


class Pairs:
    """How often words occur near each other: a symmetric matrix in stored tiles, the sums of its rows, and their mutual information, where it is
    positive, as rows or as a matrix to multiply with. Tasks hold one tile of it at a time."""

    def __init__(self, docs: DataFrame, words: DataFrame, window: int = 4):
        place = _places(words)
        self.size, self.tiles = len(place), _tiles(len(place))
        counted = spread(docs.select("text")).mapInArrow(_pairs(place, window), TILES)
        self.stored = stored(counted.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_added, TILES), "zstd")
        self.sums = self._sum(1, lambda i, j, x: (x.sum(1, keepdims=True), x.sum(0)[:, None]), False)[:, 0]

    def _dense(self, mutual: bool):
        """Tiles -> (i, j, counts or mutual information of a pair of words)."""
        tiles, sums, total = self.tiles, None, 0.0
        if mutual:
            sums, total = np.ones(tiles * SIDE), self.sums.sum()
            at = np.arange(self.size)
            sums[at % tiles * SIDE + at // tiles] = self.sums

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i, j, cells, n in zip(*(batch.column(c) for c in range(4)), strict=True):
                    i, j, cells, n = i.as_py(), j.as_py(), np.frombuffer(cells.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(n.as_buffer(), np.int64)
                    x = np.zeros(SIDE * SIDE)
                    x[cells] = np.maximum(np.log(n * total / (sums[i * SIDE + cells // SIDE] * sums[j * SIDE + cells % SIDE])), 0) if mutual else n
                    yield i, j, cells, n, x.reshape(SIDE, SIDE)

        return run

    def _sum(self, width: int, of, mutual: bool = True) -> np.ndarray:
        """The sum over all tiles of what ``of`` makes of one, (its rows' share, its columns' share) of ``width`` columns, as (words, width). Tasks add up
        their tiles, other tasks these sums by rows of tiles; the driver gets the result alone."""
        tiles, dense = self.tiles, self._dense(mutual)

        def parts(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["i", "x"])

        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for i, j, _, _, x in dense(batches):
                rows, columns = of(i, j, x)
                held[i] = held.get(i, 0) + rows
                if i != j:
                    held[j] = held.get(j, 0) + columns
            yield from parts(held)
            held.clear()
            give_back()

        def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for batch in batches:
                for i, x in zip(batch.column(0), batch.column(1), strict=True):
                    held[i.as_py()] = held.get(i.as_py(), 0) + np.frombuffer(x.as_buffer())
            yield from parts(held)

        got = self.stored.mapInArrow(by_task, "i int, x binary").repartition("i").mapInArrow(by_row, "i int, x binary").toArrow()
        out = np.zeros((tiles, SIDE, width))
        for i, x in zip(got.column("i"), got.column("x"), strict=True):
            out[i.as_py()] = np.frombuffer(x.as_buffer()).reshape(SIDE, width)
        at = np.arange(self.size)
        return out[at % tiles, at // tiles]

    def multiply(self, x: np.ndarray) -> np.ndarray:
        """The mutual information times x; the result has the size of x."""
        by, at = np.zeros((self.tiles, SIDE, x.shape[1])), np.arange(self.size)
        by[at % self.tiles, at // self.tiles] = x
        return self._sum(x.shape[1], lambda i, j, m: (m @ by[j], m.T @ by[i]))

    def rows(self) -> DataFrame:
        """(a, b, n, pmi) of the places of words."""
        tiles, dense = self.tiles, self._dense(True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, j, cells, n, x in dense(batches):
                a, b, x = (cells // SIDE * tiles + i).astype(np.int32), (cells % SIDE * tiles + j).astype(np.int32), x.ravel()[cells]
                a, b, n, x = (y[x > 0] for y in (a, b, n, x))
                for u, v in ((a, b), (b, a))[: 1 + (i != j)]:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n), pa.array(x)], ["a", "b", "n", "pmi"])

        return self.stored.mapInArrow(run, "a int, b int, n long, pmi double")


def associations(docs: DataFrame, words: DataFrame, window: int = 4) -> DataFrame:
    """(a, b, n, pmi), from a stored table: the places of words that occur within ``window`` words of each other, in either order, in whole texts, and
    their mutual information where it is positive."""
    return Pairs(docs, words, window).rows()


def _product(x: np.ndarray):
    """(a, b, pmi), sorted by a -> (a, row): parts of the rows of the matrix times x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, v = (batch.column(i).to_numpy() for i in range(3))
                start = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
                rows = np.add.reduceat(v[:, None] * x[b], start)
                yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["a", "row"])

    return run


def multiply(matrix: DataFrame | Pairs, x: np.ndarray) -> np.ndarray:
    """The symmetric matrix, as rows (a, b, pmi) or in tiles, times x, in Spark; the result has the size of x."""
    if isinstance(matrix, Pairs):
        return matrix.multiply(x)
    got = matrix.select("a", "b", "pmi").mapInArrow(_product(x), "a int, row array<double>").toArrow()
    out = np.zeros(x.shape)
    if got.num_rows:
        a = got.column("a").to_numpy()
        rows = got.column("row").combine_chunks().flatten().to_numpy().reshape(len(a), -1)
        np.add.at(out, a, rows)
    return out


def leading_vectors(matrix: DataFrame | Pairs, n: int, dimensions: int, more: int = 10, powers: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading singular vectors of a symmetric matrix of n rows, (n, dimensions), and their values: a random sample of its range is
    refined by ``powers`` products. Of each vector the entry of the largest size is positive."""
    width = min(n, dimensions + more)
    y = multiply(matrix, np.random.default_rng(seed).standard_normal((n, width)))
    for _ in range(powers):
        y = multiply(matrix, np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    u, s, _ = np.linalg.svd(multiply(matrix, q), full_matrices=False)
    u, s = u[:, :dimensions], s[:dimensions]
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])] + 1e-300), s


class WordVectors:
    """Vectors of words and their weights; a text's vector is the weighted sum of its words', of which unknown ones count nothing."""

    def __init__(self, place: dict[bytes, int], vectors: np.ndarray, weights: np.ndarray):
        self.place, self.weighted = place, weights[:, None] * vectors

    def all_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for at, words in _Found(self.place).parts(texts):
            text, at = np.repeat(np.arange(len(words)), words)[at >= 0], at[at >= 0]
            out = np.zeros((len(words), self.weighted.shape[1]))
            for start in range(0, len(at), WORDS_AT_ONCE):
                own, x = text[start : start + WORDS_AT_ONCE], self.weighted[at[start : start + WORDS_AT_ONCE]]
                first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
                out[own[first]] += np.add.reduceat(x, first)
            yield from out

    def of(self, text: str | None) -> np.ndarray:
        return next(self.all_of([text]))

    def column(self, text: Column) -> Column:
        """The embedder as a column function, as `retrieval.hashed_embedding` is."""

        @F.pandas_udf("array<double>")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in it:
                yield pd.Series(list(self.all_of(s)), dtype=object)

        return run(text)


def learn(docs: DataFrame, dimensions: int = 64, size: int = 20_000, least_docs: int = 5, window: int = 4, rare: float = 1e-3) -> WordVectors:
    """Word vectors of docs (text): singular vectors of positive mutual information, scaled by the roots of their values. A word's weight falls
    with its frequency p, as rare / (rare + p). The same corpus and parameters give the same vectors, up to rounding."""
    words = vocabulary(docs, size, least_docs)
    place = _places(words)
    u, s = leading_vectors(Pairs(docs, words, window), len(place), dimensions) if place else (np.zeros((0, dimensions)), np.zeros(dimensions))
    df = np.array([r["df"] for r in words.orderBy("place").collect()], float)
    return WordVectors(place, u * np.sqrt(s), rare / (rare + df / max(1.0, df.sum())))
