"""Grace hash deduplication of whole texts.

Texts are equal when they agree after deleting ASCII white space. Three steps, none of which ever holds more than
``memory_bytes`` of content:

1. Each task combines its own rows: equal texts become one record with the ids of its members. The records are stored.
2. Records without their members are dealt out by a hash of their content (the first Grace level). A text that fills a
   third of the table therefore sends one row per task through the shuffle, whatever the number of its copies. A task
   keeps an open-addressing table that compares complete content. When the table outgrows its memory, its records and
   the rest of the stream go to spill files by the next four bits of the hash, and each file is treated in the same way.
3. What was decided is joined to the stored records by their number, and member lists, which are bounded by the memory
   of step 1, are exploded where they meet it: the ids of one text's copies never come to one task.

Spill files live in the task's own temporary folder and in no other task's plan; a lost executor's tasks make them again.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, require, stash

#: Deleted before texts are compared. Fixed value of the contract.
WHITE = b" \t\n\x0b\x0c\r"
FAN_BITS = 4


def squeezed_sha256(text: Column) -> Column:
    """The digest that deduplicate() gives, as a JVM expression."""
    return F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256)


def squeezed(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


class ContentTable:
    """Open addressing with linear probing; entries are compared by hash, then by complete content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.zeros(slots, np.int64)  # entry + 1; 0: free
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        at = self._free_or_equal(h, content)
        if self.slots[at]:
            return int(self.slots[at]) - 1, False
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        self.slots[at] = len(self.contents)
        return len(self.contents) - 1, True

    def _free_or_equal(self, h: int, content: bytes | None) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = (h >> 20) & mask
        while e := slots[at]:
            if content is not None and self.hashes[e - 1] == h and self.contents[e - 1] == content:
                break
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.zeros(2 * len(self.slots), np.int64)
        for e, h in enumerate(self.hashes):
            self.slots[self._free_or_equal(h, None)] = e + 1


def _order(n_chars: int, doc_id) -> tuple:
    """Smaller is better: the longest original text, then the smallest id; null ids come last."""
    return -n_chars, doc_id is None, doc_id if doc_id is not None else 0


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _combine(memory_bytes: int):
    """Step 1. Arrow batches (doc_id, text, row) -> records."""

    def flush(table: ContentTable, info: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(table.hashes, pa.int64()),
                pa.array(table.contents, pa.binary()),
                pa.array([x[0] for x in info], pa.int64()),
                pa.array([x[1] for x in info], pa.int64()),
                pa.array([x[3] for x in info], pa.int32()),
                pa.array([x[2] for x in info], pa.list_(pa.int64())),
            ],
            ["h", "content", "best_chars", "best_id", "best_at", "members"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, info = ContentTable(), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                content = squeezed(text)
                e, new = table.find_or_add(_hash(hashlib.sha256(content).digest()), content)
                if new:
                    info.append([len(text), doc_id, [doc_id], 0])
                else:
                    x = info[e]
                    x[2].append(doc_id)
                    if _order(len(text), doc_id) < _order(x[0], x[1]):
                        x[0], x[1], x[3] = len(text), doc_id, len(x[2]) - 1
                table.bytes += 40
                if table.bytes > memory_bytes:
                    yield flush(table, info)
                    table, info = ContentTable(), []
        if info:
            yield flush(table, info)
        del table, info
        give_back()

    return run


class _Group:
    __slots__ = ("chars", "doc_id", "record", "size")

    def __init__(self):
        self.chars, self.doc_id, self.record, self.size = -1, None, -1, 0


def _resolve(records: Iterator[tuple], memory_bytes: int, level: int, folder: str) -> Iterator[tuple]:
    """Records (h, content, best_chars, best_id, record, members) of one bucket, the last two a number and a count -> (record, keep_id, size,
    whether its best row stays, that row's characters, digest).

    The records without content wait in a file, in their order, until the bucket's groups are complete."""
    table, groups = ContentTable(), []
    with tempfile.TemporaryFile(dir=folder) as waiting:
        for h, content, chars, doc_id, record, members in records:
            e, new = table.find_or_add(h, content)
            if new:
                groups.append(_Group())
            g = groups[e]
            g.size += members
            if g.record < 0 or (*_order(chars, doc_id), record) < (*_order(g.chars, g.doc_id), g.record):
                g.chars, g.doc_id, g.record = chars, doc_id, record
            pickle.dump((e, chars, doc_id, record, members), waiting, pickle.HIGHEST_PROTOCOL)
            if table.bytes > memory_bytes and len(table.contents) > 1 and FAN_BITS * (level + 1) <= 64:
                yield from _spill(table, waiting, records, memory_bytes, level, folder)
                return
        digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for e, _, _, record, _ in _stored(waiting):
            g = groups[e]
            yield record, g.doc_id, g.size, g.record == record, g.chars, digests[e]


def _spill(table: ContentTable, waiting, records: Iterator[tuple], memory_bytes: int, level: int, folder: str) -> Iterator[tuple]:
    """The next Grace level: what has been read and what is still to come goes to one file for each of 2**FAN_BITS buckets."""
    files = [tempfile.TemporaryFile(dir=folder) for _ in range(1 << FAN_BITS)]
    try:
        put = lambda r: pickle.dump(r, files[(r[0] >> (64 - FAN_BITS * (level + 1))) & (len(files) - 1)], pickle.HIGHEST_PROTOCOL)
        for e, *rest in _stored(waiting):
            put((table.hashes[e], table.contents[e], *rest))
        waiting.truncate(0)
        for r in records:
            put(r)
        table.__init__()
        for f in files:
            yield from _resolve(_stored(f), memory_bytes, level + 1, folder)
            f.close()
    finally:
        for f in files:
            f.close()


def _stored(f) -> Iterator[tuple]:
    end = f.tell()
    f.seek(0)
    while f.tell() < end:
        yield pickle.load(f)


def _grace(memory_bytes: int, level: int = 0):
    """Step 2. Records of one partition -> decided records."""
    names = ["h", "content", "best_chars", "best_id", "record", "members"]
    kinds = {"record": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "keeps": pa.bool_(), "keep_chars": pa.int64(), "text_sha256": pa.string()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            decided = _resolve(records(batches), memory_bytes, level, folder)
            while rows := list(islice(decided, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values(), strict=True)], list(kinds))
        give_back()

    return run


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, keep_chars (code points of the row that stays), text_sha256. Other columns of df are not touched.

    Null texts count as empty; empty texts form one group; texts may be of any length. In each group exactly one row has
    ``kept``: the longest original text in code points, then the smallest id (null ids last). Rows that repeat both id and
    text of the kept row are copies like any other: one of them is kept. An empty table gives no rows. Ids must be integers.
    """
    require(df, id_col, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    combined = rows.mapInArrow(_combine(memory_bytes), "h long, content binary, best_chars long, best_id long, best_at int, members array<long>")
    records = stash(combined.withColumn("record", F.monotonically_increasing_id()), "records")
    bare = records.select("h", "content", "best_chars", "best_id", "record", F.size("members").alias("members"))
    decided = bare.repartition("h").mapInArrow(_grace(memory_bytes), "record long, keep_id long, group_size long, keeps boolean, keep_chars long, text_sha256 string")
    both = records.select("record", "best_at", "members").join(decided, "record").select("*", F.posexplode("members").alias("at", "doc_id"))
    return both.select("doc_id", "keep_id", "group_size", (F.col("keeps") & (F.col("at") == F.col("best_at"))).alias("kept"), "keep_chars", "text_sha256")
