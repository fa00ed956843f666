"""An inverted file with residual product quantisation: approximate nearest neighbours from an index that outlives a query.

Centroids and codebooks are fitted on a bounded sample; every row is assigned to its nearest centroid's list and stored with a
code of its residual and with its vector. A search compares a query with the codes of the lists that it probes, by look-up tables, and
scores the best of them again, exactly. `retrieval.knn` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import _Best, in_turn, ranked, spread

#: Queries whose look-up tables one task holds at once: 16 kB each with 16 codes of 256 values.
QUERIES_AT_ONCE = 1024


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids, from k-means++ seeds. Empty clusters move to the points farthest from their centroids."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[[rng.integers(len(x))]]
    away = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = away.sum()
        at = rng.choice(len(x), p=away / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack((centres, x[at]))
        away = np.minimum(away, ((x - x[at]) ** 2).sum(1))
    for _ in range(rounds):
        own, far = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = (centres * centres).sum(1) - 2 * part @ centres.T
        own[at : at + 4096] = i = d.argmin(1)
        far[at : at + 4096] = np.maximum(d[np.arange(len(part)), i] + (part * part).sum(1), 0)
    return own, far


class Quantiser:
    """Centroids (lists, d) and codebooks (codes, values, d / codes) of residuals, for unit vectors (cosine) or plain ones (l2)."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, metric: str):
        self.centroids, self.books, self.metric = centroids, books, metric

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, codes: int, values: int, metric: str, seed: int) -> Quantiser:
        if x.shape[1] % codes:
            raise ValueError(f"{codes} codes do not divide {x.shape[1]} dimensions")
        x = cls.scaled(x, metric)
        centroids = k_means(x, lists, seed)
        left = (x - centroids[nearest(x, centroids)[0]]).reshape(len(x), codes, -1)
        books = [k_means(left[:, m], values, seed + 1 + m) for m in range(codes)]
        return cls(centroids, np.stack(books), metric)

    @staticmethod
    def scaled(x: np.ndarray, metric: str) -> np.ndarray:
        if metric == "l2":
            return x
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes (uint8) of each row."""
        x = self.scaled(x, self.metric)
        own, _ = nearest(x, self.centroids)
        left = (x - self.centroids[own]).reshape(len(x), len(self.books), -1)
        return own, np.stack([nearest(left[:, m], book)[0] for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[own] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries: inner products with the centroids, (queries, lists), and with the codebooks, (queries, codes, values)."""
        q = self.scaled(q, self.metric)
        return q @ self.centroids.T, np.einsum("qmd,mvd->qmv", q.reshape(len(q), len(self.books), -1), self.books)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query."""
        q = self.scaled(q, self.metric)
        d = (self.centroids * self.centroids).sum(1) - 2 * q @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build(vectors: DataFrame, folder: str, lists: int = 64, codes: int = 16, values: int = 256, metric: str = "cosine", sample_rows: int = 20_000, seed: int = 7) -> None:
    """Writes an index of vectors (id, embedding) to a folder. Null vectors are left out. Centroids and codebooks come from the
    ``sample_rows`` rows with the smallest hash of their id: a bounded sample, the same at each call. Every row is indexed."""
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        raise ValueError("there is no vector to index")
    model = Quantiser.fit(_matrix(sample.column("embedding").combine_chunks()), lists, codes, values, metric, seed)
    parts = [("centroid", 0, i, row.tolist()) for i, row in enumerate(model.centroids)] + [("book", m, i, row.tolist()) for m, book in enumerate(model.books) for i, row in enumerate(book)]
    spark.createDataFrame(parts, "kind string, code int, i int, vector array<double>").withColumn("metric", F.lit(metric)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own, code = model.encode(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column(0), pa.array([c.tobytes() for c in code], pa.binary()), part.column(1)], ["list", "id", "code", "embedding"])

    assigned = spread(rows).mapInArrow(assign, "list int, id long, code binary, embedding array<float>")
    # rows of a list together, so that files and row groups of other lists are skipped; a crowded list takes several partitions
    assigned.hint("rebalance", "list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{folder}/rows")


def open_model(spark: SparkSession, folder: str) -> Quantiser:
    got = spark.read.parquet(f"{folder}/model").orderBy("kind", "code", "i").collect()  # its size does not depend on the rows
    book = [r for r in got if r["kind"] == "book"]
    n = max(r["code"] for r in book) + 1
    return Quantiser(np.array([r["vector"] for r in got if r["kind"] == "centroid"]), np.array([r["vector"] for r in book]).reshape(n, len(book) // n, -1), got[0]["metric"])


def _near_codes(model: Quantiser, ids: list, queries: np.ndarray, probed: np.ndarray, keep: int):
    """Batches (list, id, code) -> the ``keep`` best of each query in this task, by their codes."""
    at_list = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, tables = model.tables(queries)
        best: dict[int, _Best] = {}
        for batch in batches:
            lists, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for c in np.unique(lists):
                asked = at_list.get(int(c))
                if asked is None:
                    continue
                own = np.flatnonzero(lists == c)
                for at in range(0, len(own), 1024):
                    i = own[at : at + 1024]
                    near = coarse[asked, c][:, None] + sum(tables[asked, m][:, code[i, m]] for m in range(code.shape[1]))
                    if model.metric == "l2":
                        x = model.decode(np.full(len(i), c), code[i])
                        near = 2 * near - (x * x).sum(1)
                    for k, q in enumerate(asked):
                        best.setdefault(q, _Best([ids[q]], keep)).add(near[k : k + 1], rows[i])
        for b in best.values():
            f = b.frame()
            yield pa.RecordBatch.from_pandas(f.astype({"query_id": "int64", "id": "int64"}), preserve_index=False)

    return run


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5, probes: int = 16, refine: int = 10) -> DataFrame:
    """(query_id, id, score, rank): of each query's ``probes`` nearest lists, the refine * k best rows by their codes, scored exactly and
    cut to k. Scores and order are those of `retrieval.knn`; what is missing is what lies in other lists or behind worse codes.
    Tasks keep refine * k candidates of each query; only these are shuffled, and only their vectors are read."""
    model = open_model(spark, folder)
    rows = spark.read.parquet(f"{folder}/rows")
    n = queries.count()
    blocks = max(1, -(-2 * n // QUERIES_AT_ONCE)) if n > QUERIES_AT_ONCE else 1

    def one(block: int) -> DataFrame | None:
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = own.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("query_id").toArrow()
        if not held.num_rows:
            return None
        matrix = _matrix(held.column("embedding").combine_chunks())
        probed = model.probes(matrix, probes)
        here = rows.where(F.col("list").isin([int(c) for c in np.unique(probed)])).select("list", "id", "code")
        found = here.mapInArrow(_near_codes(model, held.column("query_id").to_pylist(), matrix, probed, refine * k), "query_id long, id long, score double")
        return ranked(found, refine * k, F.desc("score"), F.col("id")).select("query_id", "id")

    candidates = in_turn(spark, one, blocks)
    if candidates is None:
        return rows.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    pairs = candidates.join(rows.select("id", F.col("embedding").cast("array<double>").alias("x")), "id").join(asked, "query_id")
    return ranked(pairs.select("query_id", "id", F.round(_exact(model.metric), 12).alias("score")), k, F.desc("score"), F.col("id"))


def _exact(metric: str):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    if metric == "l2":
        return -total(F.zip_with("q", "x", lambda a, b: (a - b) * (a - b)))
    norm = F.sqrt(total(F.transform("q", lambda a: a * a))) * F.sqrt(total(F.transform("x", lambda a: a * a)))
    return F.coalesce(F.try_divide(total(F.zip_with("q", "x", lambda a, b: a * b)), norm), F.lit(0.0))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact results (query_id, id, score, rank) that were found. A row that is as near as an exact one, at its
    query's last place, counts as found."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(last, "query_id").where(F.col("score") >= F.col("least") - 1e-9).groupBy("query_id").agg(F.count("*").alias("good"))
    return last.join(good, "query_id", "left").agg(F.count("*").alias("queries"), (F.sum(F.coalesce(F.least("good", "n"), F.lit(0))) / F.sum("n")).alias("recall"))
