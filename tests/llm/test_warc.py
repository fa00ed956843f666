import struct

import pytest
import zstandard

from quarry.llm.common import fresh_path, shared_dir
from quarry.llm.warc import Archive, WarcError, dictionary_frame, digest_of, drop_orphans, make_dictionary, parse, read_archives, record, records_of, round_trip, write_archives


def archive(recs):
    a = Archive(train_bytes=1 << 14)
    for r in recs:
        a.add(r)
    return a.close()


def test_frames_and_dictionary():
    recs = [record(i, f"https://h{i % 3}.example/{i}", b"<html>" + b"body %d " % i * (i % 40) + b"</html>", "response") for i in range(300)]
    data = archive(recs)
    assert list(records_of(data)) == recs
    assert list(records_of(data, step=7)) == recs
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    n = struct.unpack_from("<I", data, 4)[0]
    frames = data[8 + n :]
    assert frames.count(struct.pack("<I", 0xFD2FB528)) >= 300  # one frame for each record
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(frames)  # the dictionary is needed
    assert len(data) < sum(map(len, recs)) / 3


def test_raw_dictionary_in_a_plain_skippable_frame():
    d = zstandard.ZstdCompressionDict(b"<html><body>" * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    rec = record(1, "u", b"<html><body>x", "response")
    plain = struct.pack("<II", 0x184D2A5D, len(d.as_bytes())) + d.as_bytes()
    frame = zstandard.ZstdCompressor(dict_data=d).compress(rec)
    assert list(records_of(plain + frame)) == [rec] == list(records_of(dictionary_frame(d.as_bytes()) + frame))
    assert make_dictionary([b"x"]).as_bytes()


def test_malformed():
    rec = record(5, "https://x/", b"payload", "response")
    data = archive([rec] * 3)
    for bad in (b"", data[:-3], b"x" + data, data[:60] + b"\0" * 9 + data[69:]):
        with pytest.raises((WarcError, zstandard.ZstdError)):
            list(records_of(bad))
    for bad in (rec.replace(b"WARC/1.1", b"WARC/9"), rec.replace(b"payload\r\n\r\n", b"payloax\r\n\r\n"), rec[:-1], rec.replace(b"Content-Length: 7", b"Content-Length: 8"), rec.replace(b"WARC-Date: ", b"Date: "), rec.replace(b"WARC-Type: response", b"WARC-Type: other"), rec.replace(b"WARC-Type: ", b"WARC-Type "), rec.replace(b"response\r\n", b"revisit\r\n", 1)):
        with pytest.raises(WarcError):
            parse(bad)


def test_headers_cannot_be_forged():
    got = parse(record(7, "https://x/\r\nWARC-Type: revisit\r\n\r\n é", b"", "response"))
    assert got["record_type"] == "response" and got["page_id"] == 7 and "\n" not in got["url"]


PAGES = [(1, "u1", "same"), (9, "u9", "same"), (4, "u4", "same"), (2, None, None), (3, "", ""), (5, "u5", "é" * 5000), (6, "u6", "alone\r\n\r\nx"), (9, "u9", "same"), (None, "n", "no id"), (None, "n", "same"), (8, "big", "<p>" * 700_000)]


@pytest.mark.parametrize("least,size", [(0, 8 << 20), (4, 1), (100_000, 1000)])
def test_round_trip(spark, least, size):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    out = sorted((tuple(r) for r in round_trip(df, least_bytes=least, archive_bytes=size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = []
    for d, _, html in PAGES:
        body = (html or "").encode()
        group = [p[0] for p in PAGES if (p[2] or "").encode() == body and p[0] is not None]
        again = len(body) >= least and group and d != max(group)
        want.append((d, len(body), digest_of(body), "revisit" if again else "response", max(group) if again else None))
    assert out == sorted(want, key=repr)


def test_orphans_and_empty_table(spark):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    assert round_trip(df.limit(0)).count() == 0
    folder = fresh_path(spark, "warc-test")
    manifest = write_archives(df, folder)
    import pathlib

    at = pathlib.Path(folder.removeprefix("file:"))
    (at / "left-over.warc.zst").write_bytes(b"half")
    drop_orphans(spark, folder, manifest)
    assert read_archives(spark, folder).count() == 4 and shared_dir(spark) in folder
