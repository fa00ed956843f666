"""WARC archives compressed with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: each task trains a dictionary on the first records of each of its archives, and writes archives of bounded
size under names of its own to a shared folder. A manifest, written as a table, says which files belong to tasks that
ended well; what other attempts left is deleted. Reading: archives are read as binary files, frame by frame, and every
record's version line, headers, lengths and digest are validated.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, fresh_path, require, stash

#: Magic numbers and names of the formats (fixed values).
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("response", "revisit", "warcinfo", "request", "metadata", "resource", "conversion", "continuation")


class WarcError(ValueError):
    pass


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to=None) -> bytes:
    """A response with its payload, or a revisit, which has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", *([f"WARC-Target-URI: {quote(url, safe=_URL)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", *([f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL = "".join(map(chr, range(33, 127)))


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=3).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def make_dictionary(samples: list[bytes], size: int = 32 << 10) -> zstandard.ZstdCompressionDict:
    """Trained on samples; their raw text where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        raw = b"".join(s[:2048] for s in samples)[-size:]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Bytes of one archive. The first records wait for the dictionary, which is trained on their beginnings."""

    def __init__(self, train_bytes: int = 1 << 20):
        self.waiting, self.waiting_bytes, self.train_bytes = [], 0, train_bytes
        self.compressor, self.parts, self.size, self.records = None, [], 0, 0

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(rec))
            return
        self.waiting.append(rec)
        self.waiting_bytes += len(rec)
        if self.waiting_bytes >= self.train_bytes:
            self._start()

    def _put(self, frame: bytes) -> None:
        self.parts.append(frame)
        self.size += len(frame)

    def _start(self) -> None:
        d = make_dictionary([r[:8192] for r in self.waiting])
        self._put(dictionary_frame(d.as_bytes()))
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def close(self) -> bytes:
        if not self.compressor:
            self._start()
        return b"".join(self.parts)


def records_of(archive: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive: loads the dictionary from the leading skippable frame, then decodes frame by frame."""
    if len(archive) < 8:
        raise WarcError("no skippable frame at the start")
    magic, n = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or 8 + n > len(archive):
        raise WarcError("no dictionary frame at the start")
    body = archive[8 : 8 + n]
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    view, at = memoryview(archive), 8 + n
    while at < len(view):
        one, out = plain.decompressobj(), []
        while not one.eof:
            chunk = view[at : at + step]
            if not chunk:
                raise WarcError("the last frame is cut off")
            try:
                out.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"damaged frame at byte {at}: {e}") from e
            at += len(chunk) - len(one.unused_data)
        yield b"".join(out)


_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        if not (m := _HEADER.fullmatch(line)):
            raise WarcError(f"not a header: {line[:80]!r}")
        out[m[1].decode().lower()] = m[2].decode("utf-8").strip()
    return out


def parse(rec: bytes) -> dict:
    """Validates one record. Returns type, page_id, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, sep, rest = rec.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError(f"no version line: {lines[0][:40]!r}")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"{name} is missing")
    if h["warc-type"] not in TYPES:
        raise WarcError(f"unknown type {h['warc-type']}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"content-length {h['content-length']} and {len(rest) - 4} bytes")
    http_head, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    if not sep or not http_head.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    n = _headers(http_head.split(b"\r\n")[1:]).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if n != str(len(payload)):
            raise WarcError(f"HTTP content-length {n} and {len(payload)} bytes")
        if digest != digest_of(payload):
            raise WarcError(f"payload digest {digest} does not fit")
    elif h["warc-type"] == "revisit" and ("warc-refers-to" not in h or payload or not n.isdigit()):
        raise WarcError("not a revisit")
    ident = lambda u: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", u)) else None
    return {
        "record_type": h["warc-type"], "page_id": ident(h["warc-record-id"]), "refers_to": ident(h.get("warc-refers-to", "")), "url": h.get("warc-target-uri"),
        "payload": payload if h["warc-type"] == "response" else None, "payload_bytes": int(n or 0), "payload_digest": digest,
    }


def _store(folder: str, name: str, data: bytes) -> None:
    """One file in a shared folder, whatever its file system; it appears whole."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if re.match(r"[a-z0-9+.-]+:", folder, re.I) else f"file://{os.path.abspath(folder)}")
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}.part") as f:
        f.write(data)
    system.move(f"{path}/{name}.part", f"{path}/{name}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """Writes a record for each row to archives in ``folder``; returns the manifest (name, records), a stashed table.

    Of records with equal payloads of at least least_bytes, the one with the largest id is a response and the others are
    revisits of it; rows that repeat this id are all responses, and so are all rows of a group whose ids are null. A null
    payload is empty.
    """
    require(pages, id_col, url_col, html_col)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    groups = stash(groups, "payload-groups")  # a table, so that the rows of a frequent payload can be split in the join
    typed = rows.join(groups, "key", "left").select("page_id", "url", "payload", "first")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, archive, done = uuid.uuid4().hex, Archive(), []

        def close() -> None:
            name = f"{attempt}-{len(done):05d}.warc.zst"
            _store(folder, name, archive.close())
            done.append((name, archive.records))

        for f in frames:
            for page_id, url, body, first in f.astype(object).where(f.notna(), None).itertuples(index=False):
                again = first is not None and page_id != first
                archive.add(record(None if page_id is None else int(page_id), url, bytes(body), "revisit" if again else "response", int(first) if again else None))
                if archive.size >= archive_bytes:
                    close()
                    archive = Archive()
        if archive.records:
            close()
        yield pd.DataFrame(done, columns=["name", "records"])

    manifest = stash(typed.mapInPandas(write, "name string, records long"), "manifest")
    discard(groups)
    return manifest


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)


def drop_orphans(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Deletes archives of attempts that did not end well."""
    there = _files(spark, folder).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"))
    conf = spark._jsc.hadoopConfiguration()
    for r in there.join(manifest, "name", "left_anti").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        path.getFileSystem(conf).delete(path, False)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in a folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.
    Raises WarcError in the task for what is malformed."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows, held = [], 0
                for rec in records_of(bytes(content)):
                    rows.append(parse(rec))
                    held += len(rec)
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _files(spark, folder).select("content").mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: one row per row of pages.

    Null pages have an empty payload, null urls none. Of equal payloads the largest page_id is the response; rows that repeat it
    are responses as well, and null ids never are, unless all ids of the payload are null: then each is its own response. A page may
    be of any length that a record can hold (2 GB); an archive is closed after the record that fills it. Other columns are not
    read, whatever their names. An empty table gives no rows."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, **options)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
    drop_orphans(spark, folder, manifest)
    discard(manifest)
    return read_archives(spark, folder)
