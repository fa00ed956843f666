"""What Python workers hold: the size of the batches that they are sent, and the return of memory that they no longer need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: of documents about 2 MB, which a task then holds in a few forms at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets the size of Arrow batches, unless the session was configured with one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, rows)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system. Workers live on for other tasks, and would keep what one needed."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
