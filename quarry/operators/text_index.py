"""BM25 from an index that outlives a query: postings with block maxima, and dynamic pruning by them.

Documents are dealt out in shards of bounded size, each built where its texts lie: a frequent term has one row a shard, and postings
are never shuffled. In a shard, documents are ordered by length and cut into blocks. A term's row has its
postings and, for each block that has the term, its greatest frequency and least length there, which bound what the term adds to a
document's score whatever the statistics of the collection are. A search adds up the bounds of a query's terms and
scores blocks in the order of their bounds, until no bound reaches the k-th best score so far. The result is that of
`retrieval.bm25`, from fewer postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import TEXT_QUERIES_AT_ONCE, _Best, in_turn, normalised, ranked, spread, weights_of, words_of
from quarry.sources.store import stored

_ROWS = "shard long, term binary, n int, docs array<int>, tfs array<int>, block array<int>, most array<int>, least array<int>, ids array<long>, sizes array<int>, docs_a_block int"


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _shard(shard: int, ids: list, sizes: list[int], numbers: _Numbers, parts: list[tuple[np.ndarray, np.ndarray]], docs_a_block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard. parts: of each document, the numbers of its words and how often it has them."""
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    terms = sorted(numbers)
    rank = np.empty(len(terms), np.int64)
    rank[[numbers[t] for t in terms]] = np.arange(len(terms))
    length = np.array(sizes, np.int32)[order]
    none = lambda n, kind: pa.nulls(n, pa.list_(kind))
    names = ["shard", "term", "n", "docs", "tfs", "block", "most", "least", "ids", "sizes", "docs_a_block"]
    per = lambda n: [pa.array([shard] * n, pa.int64()), pa.array([docs_a_block] * n, pa.int32())]
    if terms:
        n = np.array([len(t) for t, _ in parts])
        term, doc, tf = rank[np.concatenate([t for t, _ in parts])], np.repeat(place, n), np.concatenate([c for _, c in parts]).astype(np.int32)
        by = np.argsort(term * len(ids) + doc)
        term, doc, tf = term[by], doc[by], tf[by]
        starts = np.searchsorted(term, np.arange(len(terms)))
        block = doc // docs_a_block
        heads = np.flatnonzero(np.diff(term * (len(ids) + 1) + block, prepend=-1))
        most, least = np.maximum.reduceat(tf, heads), np.minimum.reduceat(length[doc], heads)
        lists = [_lists(doc.astype(np.int32), starts), _lists(tf, starts), *(_lists(x, np.searchsorted(heads, starts)) for x in (block[heads].astype(np.int32), most, least))]
        first, last = per(len(terms))
        whole = pa.RecordBatch.from_arrays([first, pa.array(terms, pa.binary()), pa.array(np.diff(np.append(starts, len(term))).astype(np.int32)), *lists, none(len(terms), pa.int64()), none(len(terms), pa.int32()), last], names)
        for at in range(0, len(terms), 10_000):
            yield whole.slice(at, 10_000)
    first, last = per(1)
    yield pa.RecordBatch.from_arrays([first, pa.nulls(1, pa.binary()), pa.array([0], pa.int32()), *(none(1, pa.int32()) for _ in range(5)), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.int32())), last], names)


def _shards(docs_a_shard: int, docs_a_block: int, words_a_shard: int):
    """Batches (id, text) -> the rows of shards: of each term, in order, and one without a term for the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, sizes, numbers, parts, held = TaskContext.get().partitionId() << 24, [], [], _Numbers(), [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found, n = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
                ids.append(i)
                sizes.append(len(words))
                parts.append((found, n))
                held += len(found)
                if len(ids) >= docs_a_shard or held >= words_a_shard:
                    yield from _shard(shard, ids, sizes, numbers, parts, docs_a_block)
                    shard, ids, sizes, numbers, parts, held = shard + 1, [], [], _Numbers(), [], 0
        if ids:
            yield from _shard(shard, ids, sizes, numbers, parts, docs_a_block)

    return run


def build(docs: DataFrame, folder: str, docs_a_shard: int = 16_384, docs_a_block: int = 32, words_a_shard: int = 2_000_000) -> None:
    """Writes an index of docs (id, text) to a folder, reading each text once. Null texts are empty; rows with a null id are left out but
    count in the statistics, as in `retrieval.bm25`. A shard is closed at ``docs_a_shard`` documents or ``words_a_shard`` postings.
    Its rows are in the order of their terms, so that pages without a query's terms are skipped."""
    rows = spread(docs.select(F.col("id").cast("long").alias("id"), "text"))
    rows.mapInArrow(_shards(docs_a_shard, docs_a_block, words_a_shard), _ROWS).write.mode("overwrite").parquet(f"{folder}/rows")
    known = docs.sparkSession.read.parquet(f"{folder}/rows").where("term is not null")
    known.groupBy("term").agg(F.sum("n").cast("long").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")


def _impact(tf: np.ndarray, size: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def _search(ids: list, place: dict[bytes, int], weights: np.ndarray, mean: float, k: int, k1: float, b: float, at_once: int, docs_a_block: int, floors: np.ndarray):
    """The rows of one shard -> the k best of each query, and a row without a document for what was read: (query, postings, of all).
    A block is given up as soon as its best document cannot reach the floor by what the terms to come add at most there.

    floors: scores that the k-th best of each query is known to reach."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        document = rows.filter(rows.column("term").is_null())
        names = document.column("ids").combine_chunks().flatten()
        named, names = names.is_valid().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
        sizes = document.column("sizes").combine_chunks().flatten().to_numpy().astype(np.float64)
        rows = rows.filter(rows.column("term").is_valid())
        n_blocks = -(-len(names) // docs_a_block)
        terms, bounds = [], np.zeros((n_blocks, len(ids)))
        for term, docs, tfs, block, most, least in zip(*(rows.column(c).combine_chunks() if rows.num_rows else [] for c in ("term", "docs", "tfs", "block", "most", "least")), strict=True):
            at = place[term.as_py()]
            docs, tfs, block, most, least = (x.values.to_numpy() for x in (docs, tfs, block, most, least))
            own = np.flatnonzero(weights[at])
            bound = _impact(most.astype(np.float64), least.astype(np.float64), mean, k1, b)
            bounds[np.ix_(block, own)] += np.outer(bound, weights[at, own])
            terms.append((at, docs, _impact(tfs.astype(np.float64), sizes[docs], mean, k1, b), block, bound))
        out: list[tuple] = []
        for q in range(len(ids)):
            # the terms that can add most come first: what the others can add at most is left in `rest`
            held = sorted(((weights[at, q], *x) for at, *x in terms if weights[at, q]), key=lambda x: -x[0] * x[4].max())
            order, rest = np.argsort(-bounds[:, q], kind="stable"), bounds[:, q].copy()
            best, read, floor = _Best([ids[q]], k), 0, floors[q]
            i, step = 0, at_once
            while i < n_blocks:
                blocks = order[i : i + step]
                i, step = i + step, min(2 * step, 32 * at_once)
                blocks = np.sort(blocks[(bounds[blocks, q] > 0) & (bounds[blocks, q] >= floor - 1e-8)])
                if not len(blocks):
                    break
                score, slot = np.zeros((len(blocks), docs_a_block)), np.full(n_blocks, -1)
                for weight, docs, impact, block, bound in held:
                    slot[:] = -1
                    slot[blocks] = np.arange(len(blocks))
                    starts = blocks * docs_a_block
                    a, z = np.searchsorted(docs, starts), np.searchsorted(docs, starts + docs_a_block)
                    n = z - a
                    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    read += len(at)
                    score[slot[docs[at] // docs_a_block], docs[at] % docs_a_block] += weight * impact[at]  # a document has a term once
                    here = slot[block] >= 0
                    rest[block[here]] -= weight * bound[here]
                    alive = score.max(1) + rest[blocks] >= floor - 1e-8
                    if not alive.all():
                        blocks, score = blocks[alive], score[alive]
                        if not len(blocks):
                            break
                starts = blocks * docs_a_block
                where, found = (starts[:, None] + np.arange(docs_a_block))[score > 0], np.round(score[score > 0], 9)
                if (own := named[where]).any():
                    best.add(found[own][None], names[where[own]])
                if best.scores.shape[1] >= k:
                    floor = max(floor, best.scores[0, k - 1])
            out += [(ids[q], int(r), float(s), 0, 0) for r, s in zip(best.rows[0], best.scores[0], strict=True) if s > 0]
            out.append((ids[q], None, None, read, sum(len(docs) for _, docs, *_ in held)))
        kinds = ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("postings", pa.int64()), ("of", pa.int64())
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds)})

    return run


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The first k documents of each query (query_id, id, score, rank, normalised), as `retrieval.bm25` gives them; and (query_id, postings,
    of): how many postings were scored, of how many that the query's terms have.

    Queries (query_id, text) are taken in blocks of about TEXT_QUERIES_AT_ONCE, one after the other, when this is called. The largest
    shard is searched first; what it finds is a floor for all others. Documents without a query word score 0: where a query has too
    few others, those with the smallest ids follow. A collection most of whose terms are in most of its documents has a negative
    floor of weights, by which scores sink below 0: there a ValueError says so, and `retrieval.bm25` is to be used."""
    built = spark.read.parquet(f"{folder}/rows")
    postings, documents = built.where("term is not null"), built.where("term is null")
    total = documents.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"), F.max(F.struct(F.size("ids"), "shard"))["shard"].alias("largest"), F.first("docs_a_block").alias("docs_a_block")).first()
    docs_a_block = total["docs_a_block"] or 1
    n, mean = total["n"] or 0, (total["words"] or 0) / max(1, total["n"] or 0) or 1.0
    idf = spark.read.parquet(f"{folder}/terms").withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (idf.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    if floor < 0:
        raise ValueError("the mean idf is negative: use retrieval.bm25")
    count = queries.count()
    blocks = max(1, -(-2 * count // TEXT_QUERIES_AT_ONCE)) if count > TEXT_QUERIES_AT_ONCE else 1
    columns = "query_id long, id long, score double, postings long, of long"

    def one(block: int) -> DataFrame | None:
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select(F.col("query_id").cast("long"), "text").orderBy("query_id").collect()
        if not own:
            return None
        ids = [r["query_id"] for r in own]
        place, weights = weights_of(own, idf, floor)
        known = spark.createDataFrame([(bytearray(w),) for w in place], "term binary")
        empty = F.lit(None).cast("array<int>")
        head = documents.select("shard", F.lit(None).cast("binary").alias("term"), *(empty.alias(c) for c in ("docs", "tfs", "block", "most", "least")), "ids", "sizes")
        body = postings.join(F.broadcast(known), "term").select("shard", "term", "docs", "tfs", "block", "most", "least", F.lit(None).cast("array<long>").alias("ids"), empty.alias("sizes"))
        rows = head.unionAll(body)
        by = lambda df, floors: df.groupBy("shard").applyInArrow(_search(ids, place, weights, mean, k, k1, b, max(1, 256 // docs_a_block), docs_a_block, floors), columns)
        first = by(rows.where(F.col("shard") == total["largest"]), np.zeros(len(ids))).toArrow()  # k rows a query and one more
        got: dict[int, list] = {}
        for q, s in zip(first.column("query_id").to_pylist(), first.column("score").to_pylist(), strict=True):
            if s is not None:
                got.setdefault(q, []).append(s)
        floors = np.array([min(got[q]) if len(got.get(q, ())) >= k else 0.0 for q in ids])
        return spark.createDataFrame(first).unionAll(by(rows.where(F.col("shard") != total["largest"]), floors)) if first.num_rows else by(rows, floors)

    found = in_turn(spark, one, blocks)
    if found is None:
        none = queries.select(F.col("query_id").cast("long").alias("query_id")).limit(0)
        return none.selectExpr("query_id", "0L as id", "0.0D as score", "0 as rank", "0.0D as normalised"), none.selectExpr("query_id", "0L as postings", "0L as of")
    found = found if blocks > 1 else stored(found)  # k rows a query and shard, read three times
    read = found.where("id is null").groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("of").alias("of"))
    # of the 2k documents with the smallest ids at least k score 0, where fewer than k score more
    least = documents.select(F.explode(F.slice(F.array_sort(F.filter("ids", lambda x: x.isNotNull())), 1, 2 * k)).alias("id")).orderBy("id").limit(2 * k)
    fill = read.select("query_id").join(F.broadcast(least)).select("query_id", "id", F.lit(0.0).alias("score"))
    hits = found.where("id is not null").select("query_id", "id", "score")
    best = hits.unionAll(fill.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    return normalised(ranked(best, k, F.desc("score"), F.col("id"))), read
