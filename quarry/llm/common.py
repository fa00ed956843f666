"""Shared plumbing: tables, the shared scratch folder, and code that travels to executors by value."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to a Python worker at once. Texts are long; the default of 10,000 rows makes workers large.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches, unless the session was configured with one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns a Python worker's freed memory to the system. Workers live on for other tasks, and would keep what one needed."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, on a single machine (in tests), a temporary
    one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path for a table of this application: all of them are in one folder, which can be deleted when its results are stored."""
    path = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    made().append(path)
    return path


_own = threading.local()


def made() -> list[str]:
    """Paths in the order of making, of this thread: what others run at the same time is theirs."""
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """A moment, for sweep()."""
    return len(made())


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes what was put into the shared folder since mark(), but for one stashed table: for callers that have stored a result, of which
    nothing else is read any more."""
    for path in made()[since:]:
        if path != keep._quarry_path:
            delete(spark, path)
    made()[since:] = [keep._quarry_path]


def numbered(df: DataFrame, tag: str, *more: Column) -> DataFrame:
    """A stashed table (n, row, *more): df's rows as structs, so that no names clash, each with a number of its own."""
    return stash(df.select(F.monotonically_increasing_id().alias("n"), F.struct(*df.columns).alias("row"), *more), tag)


def discard(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    delete(df.sparkSession, df._quarry_path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
