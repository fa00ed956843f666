"""Incremental ingestion as a stream of files. The checksums of each file's chunks are a table beside the stream's checkpoint: a micro-batch
joins them to know which of its chunks are unchanged and which are no more, and moves texts of changed chunks only."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import chunk_markdown
from quarry.sources.readers import chunk_columns, file_name
from quarry.sources.store import Store, cached_embeddings, dropped, marked, scratch

#: The state: a file, the checksums of its chunks in their order, the batch that brought them, and what they were before it.
SEEN = "source_file string, sums array<string>, batch long, earlier array<string>"


def cut(files: DataFrame) -> DataFrame:
    """Files (source_file, text, arrived, path) -> (n, source_file, arrived, path, texts, sums), n a number of the row."""
    rows = files.select("source_file", "arrived", "path", chunk_markdown(F.col("text")).alias("texts"))
    return rows.withColumn("sums", F.transform("texts", lambda t: F.sha2(t, 256))).withColumn("n", F.monotonically_increasing_id())


def flagged(files: DataFrame, seen: DataFrame, batch: int) -> DataFrame:
    """Cut files and the state -> (n, source_file, sums, changed, batch, earlier), one row a file: of several versions in a batch the one that
    arrived last counts. ``changed`` has one flag for each chunk, ``earlier`` the checksums before this batch, of which a batch that
    is done again reminds. No text is moved."""
    last = files.groupBy("source_file").agg(F.max_by(F.struct("n", "sums"), F.struct("arrived", "path", "n")).alias("last"))
    before = seen.select("source_file", F.when(F.col("batch") == batch, F.col("earlier")).otherwise(F.col("sums")).alias("earlier"))
    both = last.select("last.*", "source_file").join(before, "source_file", "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<string>")))
    changed = F.transform("sums", lambda x, i: ~F.get("earlier", i).eqNullSafe(x))
    return both.select("n", "source_file", "sums", changed.alias("changed"), F.lit(batch).cast("long").alias("batch"), "earlier")


def apply(batch: DataFrame, number: int, seen: Store, records: Store, vectors: Store, embed: Callable) -> None:
    """Brings both stores up to date with a micro-batch, then the state. Only changed chunks are embedded, from the vectors of equal content
    where there are any; tails of files that became shorter are dropped; of unchanged chunks only the record's flag and time are
    written. A batch of the same number may be done again, wherever it ended: that leaves the same stores."""
    spark, folder = batch.sparkSession, scratch(batch.sparkSession)
    zipped = lambda df, *c: df.select("source_file", F.posexplode(F.arrays_zip(*c)).alias("chunk_index", "c")).select("source_file", "chunk_index", "c.*")
    try:
        files = cut(batch)
        files.write.option("compression", "zstd").parquet(folder)  # texts: as a cache they would fill memory, and then the disk without compression
        files = spark.read.schema(files.schema).parquet(folder)
        flags = flagged(files, seen.read(), number).persist()
        there = chunk_columns(zipped(flags, "sums", "changed").withColumnRenamed("sums", "checksum"))
        longer = flags.where(F.size("earlier") > F.size("sums"))
        tails = longer.select("source_file", F.explode(F.sequence(F.size("sums"), F.size("earlier") - 1)).alias("chunk_index"))
        gone = chunk_columns(tails.withColumn("checksum", F.lit(None).cast("string"))).select("chunk_id")
        # records first: then the flags' size is known to the join with the texts
        records.change(there.withColumn("changed_flag", F.col("changed").cast("int")).withColumn("ingested_at", F.current_timestamp()), gone)
        some = flags.where(F.exists("changed", lambda x: x)).select("n", "changed")
        texts = marked(files.select("n", "source_file", "texts", "sums"), some.select("n"), "n").where("_met").join(some, "n")  # texts of other files stay where they lie
        changed = chunk_columns(zipped(texts, "texts", "sums", "changed").where("changed").withColumnsRenamed({"texts": "text", "sums": "checksum"}))
        keys = there.where("changed")
        vectors.change(cached_embeddings(changed, vectors.read(), embed, keys), gone, keys, dealt=False)
        seen.change(flags)
        flags.unpersist()
    finally:
        dropped(spark, folder)


def ingest_stream(files: DataFrame, checkpoint: str, records: Store, vectors: Store, embed: Callable) -> StreamingQuery:
    """Ingests a stream of files (source_file, text, arrived, path). Ends when it has caught up; with the same checkpoint, the next run goes on
    from there, with its state. A file that is no longer there is no event: such files are deleted from a store by name."""
    seen = Store(files.sparkSession, f"{checkpoint.rstrip('/')}/seen", SEEN, "source_file", records.buckets)

    def run(batch: DataFrame, number: int) -> None:
        apply(batch, number, seen, records, vectors, embed)
        gc.collect()
        batch.sparkSession._jvm.System.gc()  # shuffle files go with the driver's garbage, else those of a batch lie beside the next one's

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def markdown_files(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """New *.md files of a folder and the folders in it, as a stream. A later version of a file arrives in another folder, under the same name:
    a path is read once. Spark's file sources give no row for a file of no bytes: a file that is emptied needs a blank, or is deleted from
    the stores by name."""
    read = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_at_once)
    rows = read.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return rows.select(file_name().alias("source_file"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("arrived"), "path")
