import hashlib
import random
import re

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import decontaminate, queries
from quarry.llm.decontaminate import WuManber, contamination, windows_of, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(len(iw), window)
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == iw[i : i + n]:
                        hit.update(range(j, j + n))
                        own.add(str(item))
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_words_are_the_contract_s():
    for t in ["a-B c_d É1  x \x7f{z}", "", None, "[A]^`q'", "x\x00y"]:
        assert [w.decode() for w in words_of(t)] == words(t)


def test_wu_manber_against_scanning():
    rng = random.Random(1)
    alphabet = [b"a", b"b", b"c"]
    for length in (1, 2, 3, 5, 8):
        patterns = {tuple(rng.choice(alphabet) for _ in range(length)): [i] for i in range(6)}
        text = [rng.choice(alphabet) for _ in range(3000)]
        want = [(i, patterns[tuple(text[i : i + length])]) for i in range(len(text) - length + 1) if tuple(text[i : i + length]) in patterns]
        assert list(WuManber(patterns).search(text)) == want


ITEMS = [(1, " ".join(f"w{i}" for i in range(30))), (2, "short item here"), (3, None), (4, "..."), (10, "One"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 end"), (1, "another text of item one that is quite long indeed yes"), (None, "nobody owns this")]
DOCS = [
    (1, "start " + " ".join(f"W{i}" for i in range(3, 25)) + " stop"), (2, "a short, ITEM here! and short item here"), (3, None), (4, ""), (5, "one"), (5, "one"), (6, "nothing of it"), (None, " ".join(f"w{i}" for i in range(5, 15))),
    (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (8, "x " * 50_000 + " ".join(f"w{i}" for i in range(30))), (9, "short item here short item here short item"), (11, "nobody owns this"),
]


@pytest.mark.parametrize("at_once", [500_000, 20])
def test_matches_brute_force(spark, at_once):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, found int")
    found = contamination(df, items, patterns_at_once=at_once)
    assert found.select("row.*").columns == df.columns
    found = found.select("row.doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(DOCS, [i for i in ITEMS if i[0] is not None])


def test_items_without_an_id_hit_as_in_the_sql(spark, tmp_path):
    items = [*ITEMS, (None, "a text without an id"), (7, "a text without an id"), (None, " ".join(f"w{i}" for i in range(20)))]
    docs = [(d, t and t.replace("x " * 48_000, "")) for i, (d, t) in enumerate(DOCS) if d is not None and i != 4] + [(20, "here is a text without an id"), (21, "short item here and nobody owns this")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for name in ("benchmark", "documents"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.execute(queries.oracle_sql()["op8_decontaminate"]).fetchall())
    assert sorted(map(tuple, queries.op8_decontaminate(spark, str(tmp_path)).collect())) == want
    assert (11, 3, 3, 1, hashlib.sha256(b"").hexdigest(), True) in want
    found = contamination(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), patterns_at_once=40, null_ids=True)
    assert sorted((*r, r[2] > 0) for r in found.select("row.doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256").collect()) == want
    kept = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in want if not r[5]]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert contamination(df.limit(0), items).count() == 0 and contamination(df.limit(0), items, patterns_at_once=30).count() == 0
    assert {r[0] for r in contamination(df, items.limit(0)).select("found.n_hit").collect()} == {0}


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    """Many blocks: each is of bounded size, and gone before the next is read."""
    items = spark.createDataFrame([(i, " ".join(f"p{i}x{j}" for j in range(30))) for i in range(60)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"before p{i}x3 " + " ".join(f"p{i}x{j}" for j in range(5, 20)) + " after") for i in range(60)], "doc_id long, text string")
    live, most, blocks = set(), [], []
    real = decontaminate.patterns_of

    def read(table, block):
        assert not live, "the last block is still held"
        blocks.append(real(table, block))
        return blocks[-1]

    class Watched:
        def __init__(self, value):
            self.inner = send(value)
            live.add(id(self))
            most.append(len(live))

        @property
        def value(self):
            return self.inner.value

        def destroy(self):
            live.discard(id(self))
            self.inner.destroy()

        def __reduce__(self):
            return self.inner.__reduce__()

    send = spark.sparkContext.broadcast
    monkeypatch.setattr(decontaminate, "patterns_of", read)
    monkeypatch.setattr(spark.sparkContext, "broadcast", Watched)
    found = contamination(df, items, patterns_at_once=400).select("row.doc_id", "found.n_hit", "found.n_items").collect()
    assert sorted(map(tuple, found)) == [(i, 15, 1) for i in range(60)]
    assert len(blocks) == 7 and max(most) == 1 and max(map(len, blocks)) < 400 and not live


def test_windows():
    assert windows_of([b"a", b"b"], 10) == [(b"a", b"b")] and windows_of([], 10) == [] and len(windows_of([b"x"] * 12, 10)) == 3
