"""A table kept as snapshots of hash buckets: a change rewrites the buckets that its keys fall into, and readers see all of it or none."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; on a single machine without one, a temporary one."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if not at:
        if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        at = tempfile.gettempdir()
    return f"{at.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df to a new folder that all share, and reads it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bitmaps (each of up to 32,768 rows of a file, 4 KB) that are sent to all tasks at once.
MOST_BITMAPS = 8192


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of parquet files, and whether their key is among these, as ``_met``. Of the rows only keys are shuffled; what is met comes back to
    where the rows lie as a bit each, by file and place in it."""
    place = F.col("_metadata.row_index") + 1
    at = F.col("_metadata.file_path").alias("_file"), F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).cast("int").alias("_bit")
    met = rows.select(key, *at).join(keys, key, "left_semi")
    bits = stored(met.groupBy("_file", "_part").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "zstd")
    bits = F.broadcast(bits) if bits.count() <= MOST_BITMAPS else bits
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_met = F.coalesce(F.bit_get(byte, F.col("_bit") % 8) == 1, F.lit(False)).alias("_met")
    return rows.select(*rows.columns, *at).join(bits, ["_file", "_part"], "left").select(*rows.columns, is_met)


class Store:
    """Snapshots under a folder; ``key`` names a row. ``snapshots/<n>`` says which folder holds each bucket, ``data/<n>/_bucket=<b>`` has the
    rows that snapshot n wrote. Buckets that a change does not touch are shared by the snapshots."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[int]:
        path = self._path(part)
        return sorted(int(s.getPath().getName()) for s in self._fs().listStatus(path) if s.getPath().getName().isdigit()) if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return self._names("snapshots")

    def _snapshot(self, version: int | None = None) -> dict:
        """{"buckets": how many, "at": {bucket: folder}}; empty before the first change."""
        there = self.versions()
        if not there:
            return {"buckets": self.buckets, "at": {}}
        text = self.spark.read.text(f"{self.folder}/snapshots/{there[-1] if version is None else version}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, n: int, snapshot: dict) -> int:
        """One file, not to be overwritten: of two writers of the same snapshot one fails."""
        out = self._fs().create(self._path("snapshots", str(n)), False)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        return n

    def _rows(self, snapshot: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{n}/_bucket={b}" for b, n in snapshot["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot (the last by default), with columns that it lacks as nulls."""
        return self._rows(self._snapshot(version))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, snapshot: dict, touched: set[int], dealt: bool = True) -> int:
        """The next snapshot, whose touched buckets hold these rows. They are dealt out by bucket, else each task writes a file a bucket."""
        n = max([0, *self.versions(), *self._names("data")]) + 1
        rows = rows.select(*self.columns, self._bucket(snapshot["buckets"]).alias("_bucket"))
        (rows.hint("rebalance", "_bucket") if dealt else rows).write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder}/data/{n}")
        made = {s.getPath().getName().removeprefix("_bucket=") for s in self._fs().listStatus(self._path("data", str(n)))}
        kept = {b: at for b, at in snapshot["at"].items() if int(b) not in touched}
        return self._publish(n, {"buckets": snapshot["buckets"], "at": kept | {b: n for b in made if b.isdigit()}})

    def write(self, rows: DataFrame) -> int:
        """Replaces all rows."""
        return self._write(rows, {"buckets": self.buckets, "at": {}}, set())

    def change(self, upserts: DataFrame | None = None, gone: DataFrame | None = None, keys: DataFrame | None = None, dealt: bool = True) -> int:
        """Rows replace those of the same key; those whose key is in ``gone`` are dropped. Only the buckets of these keys are read and
        written: they are collected, and there are no more than ``buckets`` of them. ``keys`` are those of the rows, where they are had
        with less work than the rows. Not ``dealt``, rows are not shuffled to be written: for large changes of wide rows, which come in
        large parts anyway."""
        snapshot = self._snapshot()
        keys = [df.select(self.key) for df in (upserts if keys is None else keys, gone) if df is not None]
        keys = keys[0] if len(keys) == 1 else keys[0].unionAll(keys[1])
        touched = {r[0] for r in keys.select(self._bucket(snapshot["buckets"])).distinct().collect()}
        rows = self._rows(snapshot, touched)
        rows = rows.join(keys, self.key, "left_anti") if dealt or not any(int(b) in touched for b in snapshot["at"]) else marked(rows, keys, self.key).where("not _met").drop("_met")
        return self._write(rows if upserts is None else rows.unionByName(upserts.select(*self.columns)), snapshot, touched, dealt)

    def upsert(self, rows: DataFrame) -> int:
        return self.change(rows)

    def delete(self, gone: DataFrame) -> int:
        """Drops the rows that match ``gone`` on its columns."""
        return self.change(gone=self.read().join(gone, gone.columns, "left_semi").select(self.key))

    def rebuild(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Another index over the same rows, such as new embeddings."""
        return self.write(change(self.read()))

    def restore(self, version: int) -> int:
        """An earlier snapshot becomes the last one; no data are copied."""
        return self._publish(max(self.versions() + self._names("data")) + 1, self._snapshot(version))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last snapshots, and the data that no snapshot left refers to."""
        old, left = self.versions()[:-keep], self.versions()[-keep:]
        for n in old:
            self._fs().delete(self._path("snapshots", str(n)), False)
        used = {(n, b) for v in left for b, n in self._snapshot(v)["at"].items()}
        for n in self._names("data"):
            if n > left[-1]:
                continue  # a write that goes on
            for s in self._fs().listStatus(self._path("data", str(n))):
                name = s.getPath().getName()
                if name.startswith("_bucket=") and (n, name.removeprefix("_bucket=")) not in used:
                    self._fs().delete(s.getPath(), True)


RECORDS = "chunk_id string, document_name string, version string, version_date date, page_number int, section_header string, source_file string, chunk_index int, checksum string, changed_flag int, ingested_at timestamp"
VECTORS = "chunk_id string, source_file string, chunk_index int, version string, version_date date, checksum string, text string, embedding array<double>"


def cached_embeddings(changed: DataFrame, vectors: DataFrame, embed: Callable, sums: DataFrame | None = None) -> DataFrame:
    """Adds ``embedding``: that of a stored row of equal content, else by the model. The contents that both have are found first, by checksums
    alone; only their embeddings are grouped. Those are written first: then their size is known, and where they are many, both sides are
    shuffled plainly, so that a frequent content's rows can be split. ``sums``: the changed rows' checksums, where they are
    had with less work than the rows."""
    made = lambda df: df.withColumn("embedding", embed(F.col("text")))
    asked = (changed if sums is None else sums).select("checksum").distinct()
    both = stored(vectors.select("checksum").join(asked, "checksum", "left_semi").distinct())
    if both.isEmpty():
        return made(changed)
    wanted = vectors.join(both, "checksum", "left_semi")
    met = changed.join(stored(wanted.groupBy("checksum").agg(F.first("embedding").alias("embedding"))), "checksum", "left")
    return made(met.where("embedding is null").drop("embedding")).unionByName(met.where("embedding is not null"))


def ingest(chunks: DataFrame, records: Store, vectors: Store, embed: Callable, force: bool = False) -> DataFrame:
    """Brings both stores to the scanned chunks; returns the stats of each version and file, from the snapshot that it wrote.

    Only changed chunks are embedded, from the vectors of equal content where there are any; (file, index) pairs that the scan
    lacks are deleted, whole files and the tails of files that became shorter alike. The records of all chunks are written
    anew, with their flag and time; of the vectors only the buckets that hold a change."""
    from quarry.operators.changes import classify_incremental, ingest_stats, latest

    place = ["source_file", "chunk_index"]
    prior = latest(records.read(), place, "checksum", "ingested_at").select(*place, "checksum")
    flagged = classify_incremental(chunks, prior)
    if force:
        flagged = flagged.withColumn("changed", F.lit(True))
    flagged = flagged.persist()
    changed = flagged.where("changed")
    stored = vectors.read().select("chunk_id", *place)
    # what stands at a changed place, under whatever id, and what stands at a place that is no more
    gone = stored.join(flagged.where("not changed").select(*place), place, "left_anti").select("chunk_id")
    vectors.change(cached_embeddings(changed, vectors.read(), embed), gone, changed)
    n = records.write(flagged.withColumn("changed_flag", F.col("changed").cast("int")).withColumn("ingested_at", F.current_timestamp()))
    flagged.unpersist()
    return ingest_stats(records.read(n).withColumn("changed", F.col("changed_flag") == 1), "version", "source_file")


def timed(action: Callable[[], object]) -> tuple[object, float]:
    start = time.perf_counter()
    return action(), time.perf_counter() - start


def compare_updates(full: Callable[[], DataFrame], incremental: Callable[[], DataFrame]) -> dict[str, float]:
    """Times a full and an incremental ingestion: seconds, chunks embedded, and their ratio (2 places)."""
    (a, t_a), (b, t_b) = timed(full), timed(incremental)
    n_a, n_b = (s.agg(F.coalesce(F.sum("updated"), F.lit(0))).first()[0] for s in (a, b))
    return {"full_reindex_time": round(t_a, 3), "incremental_update_time": round(t_b, 3), "chunks_processed_full": n_a, "chunks_processed_incremental": n_b, "update_efficiency_ratio": round(t_a / t_b, 2) if t_b else 0.0}


def write_csv(df: DataFrame, path: str, places: int | None = None) -> None:
    """A report as one CSV file with a header, doubles with so many places. Reports are small by construction."""
    if places is not None:
        df = df.select(*(F.format_string(f"%.{places}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def report_lines(df: DataFrame, places: int = 4, order: str | None = None) -> DataFrame:
    """A small report as lines for a console: a heading, a rule and one line a row, in columns of equal width."""
    shown = df.select(*(F.format_string(f"%.{places}f", c).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes))
    wide = shown.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in df.columns))
    line = lambda cells: F.rtrim(F.array_join(F.array(*cells), " | "))
    padded = lambda v, c: F.rpad(v, F.col(f"w.{c}"), F.lit(" "))
    both = shown.join(wide.select(F.struct(*df.columns).alias("w")), F.lit(True))  # one row
    key = F.col(order or df.columns[0])
    rows = both.select(F.lit(2).alias("part"), key.alias("key"), line([padded(F.coalesce(c, F.lit("")), c) for c in df.columns]).alias("line"))
    only = wide.select(F.struct(*df.columns).alias("w"))
    head = only.select(F.lit(0).alias("part"), F.lit("").alias("key"), line([padded(F.lit(c), c) for c in df.columns]).alias("line"))
    rule = only.select(F.lit(1).alias("part"), F.lit("").alias("key"), F.array_join(F.array(*(F.expr(f"repeat('-', w.`{c}`)") for c in df.columns)), "-+-").alias("line"))
    return head.unionAll(rule).unionAll(rows).orderBy("part", "key")


def show(df: DataFrame, places: int = 4) -> None:
    """Prints a report. Reports are small by construction."""
    for r in report_lines(df, places).collect():
        print(r["line"])
