import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators.retrieval import hashed_embedding
from quarry.sources import readers
from quarry.sources.store import RECORDS, VECTORS, Store, compare_updates, ingest, show, write_csv, write_json
from quarry.streaming.ingest import ingest_stream, markdown_files

PARA = "A paragraph of some length about {}. It has two sentences."


def put(folder, name, text):
    (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)


def test_markdown_scan(spark, tmp_path):
    put(tmp_path, "assert nodejs 18.20.8.md", "# Title\r\n\r\n" + PARA.format("x"))
    put(tmp_path, "a+b 5.3.1.md", b"caf\xe9 " + PARA.format("y").encode())
    put(tmp_path, "skip.txt", PARA)
    rows = {r.source_file: r for r in readers.markdown_chunks(readers.markdown_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"assert nodejs 18.20.8.md", "a+b 5.3.1.md"}
    r = rows["assert nodejs 18.20.8.md"]
    assert (r.chunk_id, r.version, r.section_header, r.chunk_index, str(r.version_date)) == ("assert nodejs 18.20.8.md__v18.20.8__chunk_0", "v18.20.8", "Section 1", 0, "1970-01-01")
    assert "�" in rows["a+b 5.3.1.md"].text and str(rows["a+b 5.3.1.md"].version_date) == "2023-07-26"


def test_page_chunks_count_over_the_file(spark):
    pages = spark.createDataFrame([("g_3.5.4.pdf", 1, "INTRO\n\n" + "x" * 900), ("g_3.5.4.pdf", 2, "more")], "source_file string, page int, text string")
    rows = readers.page_chunks(pages).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["g_3.5.4.pdf__v3.5.4_p1_c0", "g_3.5.4.pdf__v3.5.4_p1_c1", "g_3.5.4.pdf__v3.5.4_p2_c2"]
    assert rows[0].section_header == "INTRO" and rows[2].section_header == "Section Page 2" and rows[0].document_name == "g"


def test_pdf_needs_its_package(spark, tmp_path):
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            readers.pdf_pages(spark, str(tmp_path))


def test_movies_and_comments(spark, tmp_path):
    movies = [
        {"_id": {"$oid": "a1"}, "title": "One", "genres": ["Drama", "War"], "cast": list("abcdefgh"), "writers": ["W (novel)", "V"], "year": 1999, "runtime": "90 min", "imdb": {"rating": 7.5, "votes": ""}, "awards": {"text": "2 wins.", "wins": 2}, "num_mflix_comments": 3},
        {"_id": "plain", "imdb": {"rating": ""}, "tomatoes": {"viewer": {"rating": 3.5, "meter": 70}}},
    ]
    put(tmp_path, "movies.json", json.dumps(movies))
    a, b = readers.movies(spark, str(tmp_path / "movies.json")).orderBy("id").collect()
    assert a.id == "movie_a1" and a.text == "Title: One. Genres: Drama, War. Cast: a, b, c, d, e, f. Writers: W, V. Year: 1999. Awards: 2 wins."
    assert (a.year, a.runtime, a.imdb_rating, a.imdb_votes, a.award_wins, a.num_mflix_comments, a.genres) == (1999, 0, 7.5, 0, 2, 3, "Drama, War")
    assert (b.id, b.text, b.viewer_rating, b.viewer_meter, b.type) == ("movie_plain", "unknown", 3.5, 70, "movie")
    put(tmp_path, "comments.json", json.dumps([{"_id": {"$oid": "c"}, "text": " hi ", "movie_id": {"$oid": "a1"}, "date": {"$date": {"$numberLong": "12"}}}, {"_id": "d", "text": " \n"}, {"_id": "e"}]))
    (c,) = readers.comments(spark, str(tmp_path / "comments.json")).collect()
    assert (c.id, c.movie_id, c.date, c.name) == ("comment_c", "a1", "12", "")


def test_change_truth(spark, tmp_path):
    pair = {"old_version": "a", "new_version": "b", "added_chunks_count": 1, "total_actual_changes": 4}
    put(tmp_path, "t.json", json.dumps({"version_pairs": [pair, pair | {"added_chunks_count": 2}]}))
    assert [tuple(r) for r in readers.change_truth(spark, str(tmp_path / "t.json")).collect()] == [("a", "b", 2, 0, 0, 4)]
    assert readers.change_truth(spark, str(tmp_path / "none.json")).count() == 0


def stores(spark, folder):
    return Store(spark, f"{folder}/records", RECORDS, "chunk_id", 4), Store(spark, f"{folder}/vectors", VECTORS, "chunk_id", 4)


def scan(spark, folder):
    return readers.markdown_chunks(readers.markdown_files(spark, str(folder)))


def test_incremental_equals_full(spark, tmp_path):
    files, kb, fresh = tmp_path / "files", tmp_path / "kb", tmp_path / "fresh"
    files.mkdir()
    for i in range(4):
        put(files, f"doc{i} 5.3.1.md", "\n\n".join(PARA.format(f"{i}-{j}") * 12 for j in range(3)))
    records, vectors = stores(spark, kb)
    first = ingest(scan(spark, files), records, vectors, hashed_embedding)
    assert sum(r.updated for r in first.collect()) == sum(r.total for r in first.collect()) == 12
    put(files, "doc0 5.3.1.md", PARA.format("0-0") * 12)  # shrinks
    put(files, "doc1 5.3.1.md", "\n\n".join(PARA.format(f"1-{j}{'new' * (j == 2)}") * 12 for j in range(3)))
    put(files, "doc9 5.3.2.md", PARA.format("0-0") * 12)  # equal content under another name
    (files / "doc3 5.3.1.md").unlink()
    second = {r.source_file: (r.total, r.updated) for r in ingest(scan(spark, files), records, vectors, hashed_embedding).collect()}
    assert second == {"doc0 5.3.1.md": (1, 0), "doc1 5.3.1.md": (3, 1), "doc2 5.3.1.md": (3, 0), "doc9 5.3.2.md": (1, 1)}
    full = stores(spark, fresh)
    ingest(scan(spark, files), *full, hashed_embedding)
    key = lambda s: sorted(map(repr, s.read().drop("ingested_at", "changed_flag").collect()))
    assert key(records) == key(full[0]) and key(vectors) == key(full[1])
    assert records.read(1).count() == 12  # the earlier snapshot is still there
    forced = ingest(scan(spark, files), records, vectors, hashed_embedding, force=True)
    assert all(r.updated == r.total for r in forced.collect())
    numbers = compare_updates(lambda: ingest(scan(spark, files), *stores(spark, tmp_path / "n"), hashed_embedding), lambda: ingest(scan(spark, files), records, vectors, hashed_embedding))
    assert (numbers["chunks_processed_full"], numbers["chunks_processed_incremental"]) == (8, 0)


def test_store_mutations_and_sinks(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "k string, v double, f string", "k")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v double, f string")
    s.upsert(rows(("a", 1.0, "x"), ("b", 2.0, "x")))
    s.upsert(rows(("b", 3.0, "y"), ("c", 4.0, "y")))
    assert {tuple(r) for r in s.read().collect()} == {("a", 1.0, "x"), ("b", 3.0, "y"), ("c", 4.0, "y")}
    s.delete(spark.createDataFrame([("y",)], "f string"))
    assert [r.k for r in s.read().collect()] == ["a"]
    s.rebuild(lambda df: df.withColumn("v", F.col("v") * 2))
    assert s.read().first().v == 2.0 and s.read(2).count() == 3
    assert s.restore(2) == 5 and s.read().count() == 3 and s.read(4).count() == 1
    s.restore(4)
    s.vacuum(1)
    assert s.versions() == [6] and s.read().first().v == 2.0
    wider = Store(spark, str(tmp_path / "s"), "k string, v double, f string, extra int", "k")
    assert wider.read().first().extra is None
    write_csv(s.read(), str(tmp_path / "csv"), 4)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().v == "2.0000"
    write_csv(s.read().limit(0), str(tmp_path / "empty"))
    write_json(s.read(), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().k == "a"


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "k long, v long", "k", 16)
    s.write(spark.range(400).selectExpr("id k", "id v"))
    assert len(s._snapshot()["at"]) == 16
    n = s.upsert(spark.createDataFrame([(7, 70), (1000, 1)], "k long, v long"))
    fresh = [b for b, at in s._snapshot()["at"].items() if at == n]
    assert 1 <= len(fresh) <= 2 and s.read().count() == 401 and s.read().where("k = 7").first().v == 70
    gone = s._snapshot()
    s.delete(spark.range(1001).selectExpr("id k"))
    assert s.read().count() == 0 and s._snapshot()["at"] == {} and s.read(1).count() == 400
    assert s.restore(n) and s._snapshot() == gone
    s.vacuum(2)
    assert s.read().count() == 401
    with pytest.raises(Exception, match="exist"):
        s._publish(s.versions()[-1], gone)


def test_sqlite_records(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "old.db")
    db.execute("CREATE TABLE chunk_versions (chunk_id TEXT PRIMARY KEY, document_name TEXT, version TEXT, version_date TEXT, source_file TEXT, chunk_index INTEGER, checksum TEXT, ingested_at TEXT)")
    db.executemany("INSERT INTO chunk_versions VALUES (?, 'd', ?, '2024-02-01', 'f.md', ?, 's', '2024-03-01T10:00:00')", [(f"c{i}", f"v{i % 2}", i) for i in range(30)])
    db.commit()
    db.close()
    rows = readers.sqlite_records(spark, str(tmp_path / "old.db"))
    assert rows.count() == 30 and readers.sqlite_records(spark, str(tmp_path / "old.db"), version="v1").count() == 15
    store = Store(spark, str(tmp_path / "s"), RECORDS, "chunk_id", 4)
    store.write(rows)
    r = store.read().where("chunk_id = 'c7'").first()
    assert (str(r.version_date), r.chunk_index, r.section_header, r.page_number, r.ingested_at.hour) == ("2024-02-01", 7, None, None, 10)


def test_report_lines(spark, capsys):
    df = spark.createDataFrame([("BM25", 0.5, 3), ("A longer name", 0.25, None)], "model string, hit double, n long")
    show(df, 2)
    assert capsys.readouterr().out.splitlines() == ["model         | hit  | n", "--------------+------+--", "A longer name | 0.25 |", "BM25          | 0.50 | 3"]


def test_stream_is_the_batch(spark, tmp_path):
    """Two scans by the stream and by the batch leave the same stores: shorter files lose their tails, unchanged chunks are not embedded again."""
    from quarry.sources.store import RECORDS, VECTORS, ingest

    folder = tmp_path / "in"
    stores = {s: tuple(Store(spark, str(tmp_path / s / k), schema, "chunk_id", 4) for k, schema in (("records", RECORDS), ("vectors", VECTORS))) for s in ("stream", "batch")}
    embedded = []

    def embed(text):
        embedded.append(1)
        return hashed_embedding(text)

    long = lambda *marks: "\n\n".join(PARA.format(m) * 8 for m in marks)
    scans = [{"a 5.3.1.md": long("p", "q", "r"), "b 5.3.1.md": long("s"), "c 5.3.2.md": long("t", "u")}, {"a 5.3.1.md": long("p", "x"), "b 5.3.1.md": long("s"), "c 5.3.2.md": "\n", "d 5.3.1.md": long("q")}]
    for i, scan in enumerate(scans):
        own = folder / f"scan{i}"
        own.mkdir(parents=True)
        for name, text in scan.items():
            put(own, name, text)
        assert ingest_stream(markdown_files(spark, str(folder), 2), str(tmp_path / "cp"), *stores["stream"], embed).awaitTermination(240)
        ingest(readers.markdown_chunks(spark.createDataFrame(list(scan.items()), "source_file string, text string")), *stores["batch"], embed)
        got = {s: [sorted(map(tuple, store.read().select(*columns).collect())) for store, columns in zip(pair, (("chunk_id", "checksum", "changed_flag", "version_date"), ("chunk_id", "checksum", "text", "embedding")), strict=True)] for s, pair in stores.items()}
        for a, b in zip(got["stream"], got["batch"], strict=True):
            assert [x for x in a if x not in b] == [] == [x for x in b if x not in a]
            assert len(a) == len(b) > 0
    flags = {r.chunk_id: r.changed_flag for r in stores["stream"][0].read().collect()}
    assert sorted(flags.values()) != [1] * len(flags) and not any(k.startswith("c 5.3.2") for k in flags)


def test_batch_done_again(spark, tmp_path):
    """A micro-batch that is done again, after its end too, leaves the same stores; of two versions of a file in it the later one counts."""
    from quarry.sources.store import RECORDS, VECTORS
    from quarry.streaming.ingest import SEEN, apply

    seen, records, vectors = (Store(spark, str(tmp_path / k), schema, key, 4) for k, schema, key in (("seen", SEEN, "source_file"), ("records", RECORDS, "chunk_id"), ("vectors", VECTORS, "chunk_id")))
    long = lambda *marks: "\n\n".join(PARA.format(m) * 8 for m in marks)
    batch = lambda *rows: spark.createDataFrame(rows, "source_file string, text string, arrived int, path string")
    apply(batch(("a 5.3.1.md", long("p", "q", "r"), 0, "x"), ("b 5.3.1.md", long("s"), 0, "y")), 0, seen, records, vectors, hashed_embedding)
    second = batch(("a 5.3.1.md", long("p", "x"), 2, "x"), ("a 5.3.1.md", long("z"), 1, "y"), ("c 5.3.1.md", None, 1, "z"))
    got = []
    for _ in range(2):
        apply(second, 1, seen, records, vectors, hashed_embedding)
        got.append((sorted(map(tuple, records.read().drop("ingested_at").collect()), key=repr), sorted(map(tuple, vectors.read().collect()), key=repr)))
    assert got[0] == got[1]
    flags = {(r.source_file, r.chunk_index): r.changed_flag for r in records.read().collect()}
    assert flags == {("a 5.3.1.md", 0): 0, ("a 5.3.1.md", 1): 1, ("b 5.3.1.md", 0): 1}
    assert sorted(r.chunk_id for r in vectors.read().collect()) == sorted(r.chunk_id for r in records.read().collect())


def test_json_arrays_are_read_once(spark, tmp_path):
    """As Spark's reader of JSON over several lines gives them, to the spelling of what is kept as text, without its going back to the file."""
    schema = "_id string, n int, sub struct<a: string, b: int>, l array<string>"
    texts = {"plain": '[{"_id": {"$oid": "1"}, "n": 1, "sub": {"a": 5, "b": 2}, "l": ["x", {"y": 1.50}]},\n {"_id": 7}]', "one": '{"_id": "o"}', "none": "[]", "empty": "", "blank": " \n", "broken": '[{"_id": "b"', "wrong": '[{"_id": "w", "n": "text", "sub": {"a": "k", "b": "no"}}, {"_id": "v", "n": 3}]', "other": "what", "marked": "\ufeff" + '{"_id": "o"}'}
    texts["long"] = "[" + ",\n".join('{"_id": {"$oid": "%d"}, "n": %d}' % (i, i) for i in range(2000)) + "]\n"
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text, encoding="utf-8")
        old = spark.read.schema(schema).json(str(tmp_path / name), multiLine=True).collect()
        assert sorted(map(str, readers.json_records(spark, str(tmp_path / name), schema).collect())) == sorted(map(str, old)), name
    read = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).getRawFileSystem()  # counts what all tasks of this process read
    total = lambda: sum(s.getBytesRead() for s in read.getAllStatistics() if s.getScheme() == "file")
    before = total()
    readers.json_records(spark, str(tmp_path / "long"), schema).agg(F.max("_id")).collect()
    assert total() - before < 3 * len(texts["long"])
