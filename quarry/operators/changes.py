"""Changes between document versions, incremental ingestion, and their metrics.

chunk_versions rows: chunk_id, document_name, version, version_date, section_header, source_file, chunk_index, checksum. Where
an order is needed it is (source_file, chunk_index, chunk_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.versions import normalised_name

ORDER = ("source_file", "chunk_index", "chunk_id")


def _first(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    order = [F.desc(c) if last else F.asc(c) for c in ORDER]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def deduplicate_chunks(chunks: DataFrame) -> DataFrame:
    """The first row of each (version, chunk_index, checksum)."""
    return _first(chunks, ["version", "chunk_index", "checksum"])


def detect_changes(chunks: DataFrame, pairs: DataFrame, embeddings: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """added, deleted, modified and detected changes of each pair (old, new) of versions, all pairs in one job.

    Rows are matched by normalised document name and header (the first row of each key), then what is left by chunk index
    (the last row of each index). A match with another checksum is modified; for a match by index not so if embeddings
    (chunk_id, embedding) have a cosine of at least ``least``. What is left is deleted or added.
    """
    clean = deduplicate_chunks(chunks).withColumn("name_key", normalised_name(F.col("document_name"))).withColumn("header_key", F.lower(F.trim("section_header")))
    sides = {s: clean.join(pairs, F.col("version") == F.col(s)).select("old", "new", "chunk_id", "chunk_index", "checksum", "source_file", "name_key", "header_key") for s in ("old", "new")}
    pair, by_name, by_index = ["old", "new"], ["old", "new", "name_key", "header_key"], ["old", "new", "chunk_index"]

    def match(keys: list[str], rows: dict[str, DataFrame], last: bool) -> DataFrame:
        a, b = (_first(rows[s], keys, last).select(*keys, F.col("chunk_id").alias(f"{s}_id"), F.col("checksum").alias(f"{s}_sum")) for s in ("old", "new"))
        return a.join(b, keys)

    def rest(rows: dict[str, DataFrame], met: DataFrame) -> dict[str, DataFrame]:
        return {s: r.join(met.select(*pair, F.col(f"{s}_id").alias("chunk_id")), [*pair, "chunk_id"], "left_anti") for s, r in rows.items()}

    named = match(by_name, sides, False)
    left = rest(sides, named)
    indexed = match(by_index, left, True)
    left = rest(left, indexed)
    changed = F.col("old_sum") != F.col("new_sum")
    if embeddings is not None:
        from quarry.functions.vectors import cosine

        e = {s: embeddings.select(F.col("chunk_id").alias(f"{s}_id"), F.col("embedding").alias(f"{s}_e")) for s in ("old", "new")}
        indexed = indexed.join(e["old"], "old_id", "left").join(e["new"], "new_id", "left")
        indexed = indexed.withColumn("changed", changed & ~F.coalesce(cosine(F.col("old_e"), F.col("new_e")) >= least, F.lit(False)))
    else:
        indexed = indexed.withColumn("changed", changed)
    events = [named.where(changed).select(*pair, F.lit("modified").alias("kind")), indexed.where("changed").select(*pair, F.lit("modified").alias("kind"))]
    events += [left[s].select(*pair, F.lit(k).alias("kind")) for s, k in (("old", "deleted"), ("new", "added"))]
    every = events[0]
    for e in events[1:]:
        every = every.unionAll(e)
    n = every.groupBy(*pair).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "deleted", "modified")), F.count("*").alias("detected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pairs.join(n, pair, "left").select(*pair, *map(zero, ("added", "deleted", "modified", "detected")))


def fetch_embeddings(stored: DataFrame, texts: DataFrame, embed: Callable) -> DataFrame:
    """(chunk_id, embedding) of every chunk of texts (chunk_id, text): as stored (chunk_id, embedding), else made from its text. Only what is
    missing is made."""
    made = texts.join(stored.where("embedding is not null").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", embed(F.col("text")).alias("embedding"))
    return stored.where("embedding is not null").join(texts.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(made)


def within_tolerance(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """(old, new, detected, actual, correct). truth: (old, new, added, deleted, modified, total), possibly without a pair: then what
    was detected is right. Half rounds to even, as the tolerances are defined."""
    t = truth.select("old", "new", *(F.coalesce(c, F.lit(0)).alias(f"t_{c}") for c in ("added", "deleted", "modified", "total")))
    both = detected.join(t, ["old", "new"], "left")
    actual = F.coalesce("t_total", "detected")
    total = F.greatest(F.lit(2), F.bround(0.2 * actual, 0))
    right = F.abs(F.col("detected") - actual) <= total
    for c in ("added", "deleted", "modified"):
        each = F.abs(F.col(c) - F.col(f"t_{c}")) <= total + F.greatest(F.lit(1), F.bround(0.3 * F.col(f"t_{c}"), 0))
        right = right & F.coalesce(each, F.lit(True))
    return both.select("old", "new", "detected", actual.alias("actual"), right.alias("correct"))


def embedding_changed(old: Column, new: Column, least: float = 0.95) -> Column:
    """Whether two embeddings are less alike than ``least``; false for a missing one or a zero norm."""
    from quarry.functions.vectors import dot

    norms = dot(old, old) * dot(new, new)
    return F.coalesce((norms > 0) & (dot(old, new) / F.sqrt(norms) < least), F.lit(False))


def change_scores(chunks: DataFrame, pairs: DataFrame, detected: Column, embeddings: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of a detection flag against differing checksums, over chunks with the same (source_file, chunk_index)
    in both versions of a pair; null for pairs without any. ``detected`` is over columns old_* and new_*: id, sum, and e if
    embeddings (chunk_id, embedding) are given."""
    rows = deduplicate_chunks(chunks).select("version", "source_file", "chunk_index", "chunk_id", "checksum")
    side = lambda s: rows.select(F.col("version").alias(s), "source_file", "chunk_index", F.col("chunk_id").alias(f"{s}_id"), F.col("checksum").alias(f"{s}_sum"))
    both = side("old").join(pairs, "old").join(side("new"), ["new", "source_file", "chunk_index"])
    if embeddings is not None:
        for s in ("old", "new"):
            both = both.join(embeddings.select(F.col("chunk_id").alias(f"{s}_id"), F.col("embedding").alias(f"{s}_e")), f"{s}_id", "left")
    flags = both.select("old", "new", detected.alias("d"), (F.col("old_sum") != F.col("new_sum")).alias("t"))
    n = flags.groupBy("old", "new").agg(F.count_if(F.expr("d and t")).alias("tp"), F.count_if(F.expr("d and not t")).alias("fp"), F.count_if(F.expr("not d and t")).alias("fn"))
    precision, recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    n = n.withColumn("precision", precision).withColumn("recall", recall)
    n = n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return pairs.join(n, ["old", "new"], "left")


def latest(records: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """The value of the latest record of each key, by one aggregation."""
    return records.groupBy(*keys).agg(F.max_by(value, by).alias(value), F.max(by).alias(by))


def classify_incremental(new: DataFrame, prior: DataFrame, keys: tuple[str, ...] = ("source_file", "chunk_index")) -> DataFrame:
    """Adds ``changed``: no prior record of the key, or another checksum. prior: (*keys, checksum), one row a key."""
    p = prior.select(*keys, F.col("checksum").alias("_prior"))
    return new.join(p, list(keys), "left").withColumn("changed", ~F.col("checksum").eqNullSafe(F.col("_prior")) | F.col("_prior").isNull()).drop("_prior")


def ingest_stats(flagged: DataFrame, *groups: str) -> DataFrame:
    """total, updated and skipped of each group."""
    return flagged.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("skipped"))


def update_efficiency(stats: DataFrame) -> DataFrame:
    """updated / total of each version and, as version ``all``, over all of them; 4 places."""
    both = stats.rollup("version").agg(F.sum("total").alias("total"), F.sum("updated").alias("updated"))
    return both.select(F.coalesce("version", F.lit("all")).alias("version"), "total", "updated", F.coalesce(F.round(F.try_divide(F.col("updated"), F.col("total")), 4), F.lit(0.0)).alias("efficiency"))


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """(product, old, new) by date. versions: (product, version, version_date)."""
    w = Window.partitionBy("product").orderBy("version_date", "version")
    return versions.select("product", F.lag("version").over(w).alias("old"), F.col("version").alias("new")).where("old is not null")


def history(chunks: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("document_name", "chunk_index")) -> DataFrame:
    """As of each target (target, target_date): the latest record of each key dated up to then. A record is seen from its own date to
    that of the key's next record; the targets in between are found in the sorted list of all targets' dates, which is one value
    (a version calendar: its size is checked), so that no record is compared with another and nothing is broadcast."""
    w = Window.partitionBy(*keys).orderBy("version_date", *ORDER)
    spans = chunks.withColumn("until", F.lead("version_date").over(w))
    n = targets.count()
    if n > MOST_TARGETS:
        raise ValueError(f"{n} targets; at most {MOST_TARGETS} dates are looked up at once")
    dates = F.array(*(F.struct(F.lit(r["target"]).alias("target"), F.lit(r["target_date"]).alias("target_date")) for r in targets.collect()))
    seen = F.filter(dates, lambda t: (t["target_date"] >= F.col("version_date")) & (F.col("until").isNull() | (F.col("until") > t["target_date"])))
    return spans.withColumn("t", F.explode(seen)).select(*chunks.columns, "t.target", "t.target_date")


#: Target dates that are looked up at once.
MOST_TARGETS = 1000
