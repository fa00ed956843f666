"""A trained pair scorer: a linear model of pair features, fitted by a pairwise logistic loss, scored as a column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lower_words
from quarry.operators.retrieval import spread
from quarry.sources.store import stored

FEATURES = ("words_held", "pairs_held", "triples_held", "sparse", "dense", "sparse_place", "dense_place", "length", "longest_run", "all_held")

#: Longer runs of words count as so many.
LONGEST = 16


def body(text: Column) -> Column:
    """A text's lower-cased words, each between single blanks. It is to be a column of its own: what searches it would split the text again and again."""
    return F.concat(F.lit(" "), F.array_join(lower_words(text), " "), F.lit(" "))


def _split(query: Column, f: Callable[[Column], Column]) -> Column:
    """f of the query's words, which are split once: in the functions of an array's elements they would be split for each."""
    return F.transform(F.array(lower_words(query)), f)[0]


def _has(body: Column, run: Column) -> Column:
    return F.contains(body, F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" ")))


def _held(query: Column, body: Column, n: int) -> Column:
    """The share of the query's runs of n words that the text has."""

    def share(words: Column) -> Column:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n)))
        return F.when(F.size(words) < n, 0.0).otherwise(F.size(F.filter(runs, lambda r: _has(body, r))) / F.size(runs))

    return _split(query, share)


def _longest_run(query: Column, body: Column) -> Column:
    """How many of the query's words in a row the text has at most, or LONGEST. Of the runs that end at a word, only the one is looked for that
    would be the longest so far."""

    def longest(words: Column) -> Column:
        ends = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
        return F.aggregate(ends, F.lit(0), lambda n, i: F.when((F.size(words) > 0) & (n < LONGEST) & (i > n) & _has(body, F.slice(words, i - n, n + 1)), n + 1).otherwise(n))

    return _split(query, longest)


def features(query: Column, body: Column, sparse: Column, dense: Column, sparse_rank: Column, dense_rank: Column) -> Column:
    """The pair's features as one array, in the order of FEATURES. Nulls: not among the first of that search."""
    zero = F.lit(0.0)
    place = lambda r: F.coalesce(1 / r, zero)
    held = (_held(query, body, n) for n in (1, 2, 3))
    every = (_held(query, body, 1) == 1).cast("double")  # of a short query's words only this counts, not their order
    return F.array(*held, F.coalesce(sparse, zero), F.coalesce(dense, zero), place(sparse_rank), place(dense_rank), F.log1p(F.length(body)) / 10, _longest_run(query, body) / LONGEST, every)


@dataclass(frozen=True)
class PairRanker:
    """Scores a pair by weights of its features."""

    weights: tuple[float, ...]

    def score(self, x: Column) -> Column:
        return F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


#: What is used when nothing can be learned: the words held alone.
OVERLAP = PairRanker((8.0,) + (0.0,) * (len(FEATURES) - 1))


def _of_query(w: np.ndarray, x: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Of all pairs of a fitting and another candidate of one query: the mean of log(1 + exp(-(difference of scores))), its gradient and its
    second derivatives, in one row; zeros without both kinds."""
    good, bad = x[fits], x[~fits]
    if not len(good) or not len(bad):
        return np.zeros(1 + len(w) + len(w) ** 2)
    margin = (good @ w)[:, None] - (bad @ w)
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
    r = p * (1 - p)
    both = good.T @ r @ bad
    curve = (good.T * r.sum(1)) @ good + (bad.T * r.sum(0)) @ bad - both - both.T
    return np.concatenate(([np.logaddexp(0, -margin).sum()], p.sum(0) @ bad - p.sum(1) @ good, curve.ravel())) / p.size


def _with_decay(w: np.ndarray, mean: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    n = len(w)
    return mean[0] + 0.5 * decay * w @ w, mean[1 : n + 1] + decay * w, mean[n + 1 :].reshape(n, n) + decay * np.eye(n)


def loss_and_gradient(w: np.ndarray, x: np.ndarray, query: np.ndarray, fits: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The mean over the queries that have both kinds of candidates of what ``_of_query`` gives, and the decay of the weights."""
    parts = [_of_query(w, x[query == q], fits[query == q]) for q in np.unique(query) if len(set(fits[query == q])) == 2]
    return _with_decay(w, np.mean(parts, 0) if parts else np.zeros(1 + len(w) + len(w) ** 2), decay)[:2]


def _summed(w: np.ndarray):
    """Batches of (x, fits), a row a query -> one row for each task: the sum of what ``_of_query`` gives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for f in frames:
            for x, fits in zip(f["x"], f["fits"], strict=True):
                total += _of_query(w, np.reshape(x, (len(fits), len(w))), np.asarray(fits, bool))
        yield pd.DataFrame({"total": [total]})

    return run


def train(candidates: DataFrame, steps: int = 100, decay: float = 1e-3) -> PairRanker:
    """Fits a ranker to candidates (query_id, x, fits) of all queries, by Newton's method with halved steps: the loss has one minimum, which
    is reached. Each step is a pass over the candidates, a row a query, of which tasks pass on sums only. Weights are
    rounded, so that the order of summing shows nowhere. Without a query that has both kinds of candidates, OVERLAP."""
    n = len(FEATURES)
    each = F.sort_array(F.collect_list(F.struct("x", "fits")))
    queries = candidates.groupBy("query_id").agg(each.alias("c")).where(F.exists("c", lambda c: c["fits"]) & F.exists("c", lambda c: ~c["fits"]))
    scales = F.array(*(F.stddev_pop(F.col("x")[i]) for i in range(n)))
    queries = stored(queries.select(F.flatten("c.x").alias("x"), F.col("c.fits").alias("fits")))
    many = queries.count()
    if not many:
        return OVERLAP
    scale = np.array(candidates.agg(scales).first()[0])
    scale[scale == 0] = 1

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = queries.mapInPandas(_summed(w / scale), "total array<double>").collect()
        total = np.sum([r[0] for r in parts], 0) / many
        total[1 : n + 1] /= scale
        total[n + 1 :] /= np.outer(scale, scale).ravel()
        return _with_decay(w, total, decay)

    w = np.zeros(n)
    loss, g, curve = at(w)
    for _ in range(steps):
        if np.linalg.norm(g) < 1e-13:
            break
        step, part = np.linalg.solve(curve, g), 1.0
        # at the end doubles no longer tell the losses apart, but the gradients
        lower = lambda new, part: new[0] <= loss - 1e-4 * part * g @ step or (new[0] < loss + 1e-12 and np.linalg.norm(new[1]) < np.linalg.norm(g) / 2)  # noqa: E731, B023
        while not lower(new := at(w - part * step), part) and part > 1e-6 and np.linalg.norm(g) > 1e-11:
            part /= 2
        if not lower(new, part):
            break
        w, (loss, g, curve) = w - part * step, new
    return PairRanker(tuple(float(f"{v:.6g}") for v in w / scale))


def candidate_pairs(queries: DataFrame, docs: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, id, query, body, x, rank) of what either search found: dense (query_id, id, score, rank), sparse with ``normalised``; rank:
    the better one of both, ties by id, for scorers that leave ties."""
    a = dense.select("query_id", "id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "id", F.col("normalised").alias("sparse"), F.col("rank").alias("sparse_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer").join(docs.select("id", F.coalesce("text", F.lit("")).alias("text")), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    both = stored(spread(stored(both)).withColumn("body", body(F.col("text"))).drop("text"))  # few pairs come from the join in one part
    x = features(F.col("query"), F.col("body"), F.col("sparse"), F.col("dense"), F.col("sparse_rank"), F.col("dense_rank"))
    return both.select("query_id", "id", "query", "body", x.alias("x"), F.least("dense_rank", "sparse_rank").alias("rank"))


def holds_passage(query: Column, body: Column, n: int = 8) -> Column:
    """Whether the text has n of the query's words in a row, or all of a shorter query's: the relevance that training is shown."""
    words = lower_words(query)
    return (F.size(words) > 0) & F.when(F.size(words) < n, _held(query, body, 1) == 1).otherwise(_held(query, body, n) > 0)
