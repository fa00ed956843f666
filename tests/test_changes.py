import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import changes as C

SCHEMA = "chunk_id string, document_name string, version string, version_date date, section_header string, source_file string, chunk_index int, checksum string"
import datetime as dt

DAY = dt.date(2024, 1, 1)


def chunk(i, version, name, header, file, index, sum_):
    return (i, name, version, DAY, header, file, index, sum_)


def brute(rows, old, new):
    def side(v):
        seen, out = set(), []
        for r in sorted((r for r in rows if r[2] == v), key=lambda r: (r[5], r[6], r[0])):
            if (r[6], r[7]) not in seen:
                seen.add((r[6], r[7]))
                out.append(r)
        return out

    a, b = side(old), side(new)
    key = lambda r: (r[1].lower().strip(), r[4].lower().strip())
    first = lambda rs: {key(r): r for r in reversed(rs)}
    fa, fb = first(a), first(b)
    common = fa.keys() & fb.keys()
    modified = sum(fa[k][7] != fb[k][7] for k in common)
    a, b = [r for r in a if r not in [fa[k] for k in common]], [r for r in b if r not in [fb[k] for k in common]]
    la, lb = {r[6]: r for r in a}, {r[6]: r for r in b}
    common = la.keys() & lb.keys()
    modified += sum(la[k][7] != lb[k][7] for k in common)
    deleted, added = len([r for r in a if r not in [la[k] for k in common]]), len([r for r in b if r not in [lb[k] for k in common]])
    return added, deleted, modified, added + deleted + modified


def detect(spark, rows, pairs=(("a", "b"),), **k):
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.detect_changes(df, spark.createDataFrame(list(pairs), "old string, new string"), **k).collect()
    return {(r.old, r.new): (r.added, r.deleted, r.modified, r.detected) for r in out}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [chunk(f"{v}{i}", v, rng.choice("xyz"), f"H{rng.randrange(5)}", f"f{rng.randrange(3)}", rng.randrange(7), f"s{rng.randrange(9)}") for v in "abc" for i in range(30)]
    pairs = [("a", "b"), ("b", "c"), ("a", "missing")]
    got = detect(spark, rows, pairs)
    assert got == {p: brute(rows, *p) for p in pairs}
    rng.shuffle(rows)
    assert detect(spark, rows, pairs) == got


def test_named_cases(spark):
    rename = [chunk("1", "a", "doc one", "H", "f", 0, "s"), chunk("2", "b", "doc two", "H", "g", 0, "s")]
    assert detect(spark, rename)["a", "b"] == (0, 0, 0, 0)
    twice = [chunk("1", "a", "d", "H", "f", 0, "s"), chunk("2", "a", "d", "H", "f2", 0, "s"), chunk("3", "b", "d", "H", "f", 0, "s")]
    assert detect(spark, twice)["a", "b"] == (0, 0, 0, 0)
    assert detect(spark, [chunk("1", "a", "d", "H", "f", 0, "s"), chunk("2", "b", "v2.0 - d", " h ", "f", 3, "t")])["a", "b"] == (0, 0, 1, 1)
    shrink = [chunk("1", "a", "d", "H1", "f", 0, "s"), chunk("2", "a", "d", "H2", "f", 1, "t"), chunk("3", "b", "d", "H1", "f", 0, "s")]
    assert detect(spark, shrink)["a", "b"] == (0, 1, 0, 1)


def test_embeddings_spare_what_is_alike(spark):
    rows = [chunk("1", "a", "x", "H", "f", 0, "s"), chunk("2", "b", "y", "H", "g", 0, "t")]
    assert detect(spark, rows)["a", "b"] == (0, 0, 1, 1)
    near = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.95, 0.05])], "chunk_id string, embedding array<double>")
    assert detect(spark, rows, embeddings=near)["a", "b"] == (0, 0, 0, 0)
    assert detect(spark, rows, embeddings=near.where("chunk_id = '1'"))["a", "b"] == (0, 0, 1, 1)


def test_tolerance_rounds_half_to_even(spark):
    found = spark.createDataFrame([("a", "b", 0, 0, 22, 12), ("c", "d", 0, 0, 3, 3), ("e", "f", 0, 0, 0, 15)], "old string, new string, added int, deleted int, modified int, detected int")
    truth = spark.createDataFrame([("a", "b", 0, 0, 15, 12), ("e", "f", 0, 0, 0, 12)], "old string, new string, added int, deleted int, modified int, total int")
    got = {r.old: (r.actual, r.correct) for r in C.within_tolerance(found, truth).collect()}
    # a: 22 against 15 is 7 off; 2 (20 % of 12) + 4 (30 % of 15, half to even) = 6. e: 3 off, 2 allowed.
    assert got == {"a": (12, False), "c": (3, True), "e": (12, False)}


def test_scores_skip_pairs_without_overlap(spark):
    rows = [chunk("1", "a", "d", "H", "f", 0, "s"), chunk("2", "b", "d", "H", "f", 0, "t"), chunk("3", "a", "d", "H", "f", 1, "u"), chunk("4", "b", "d", "H", "f", 1, "u")]
    out = C.change_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", "b"), ("a", "z")], "old string, new string"), F.lit(True)).collect()
    got = {r.new: (r.precision, r.recall) for r in out}
    assert got == {"b": (0.5, 1.0), "z": (None, None)}


def test_history_and_pairs(spark):
    rows = [("1", "d", "a", dt.date(2024, 1, 1), "H", "f", 0, "s"), ("2", "d", "b", dt.date(2024, 3, 1), "H", "f", 0, "t")]
    targets = spark.createDataFrame([("early", dt.date(2023, 1, 1)), ("mid", dt.date(2024, 2, 1)), ("late", dt.date(2024, 3, 1))], "target string, target_date date")
    assert {(r.target, r.chunk_id) for r in C.history(spark.createDataFrame(rows, SCHEMA), targets).collect()} == {("mid", "1"), ("late", "2")}
    v = spark.createDataFrame([("p", "v3.4.4", dt.date(2024, 10, 20)), ("p", "v3.5.3", dt.date(2024, 9, 25)), ("p", "v3.3.4", dt.date(2023, 12, 1))], "product string, version string, version_date date")
    assert [(r.old, r.new) for r in C.consecutive_pairs(v).orderBy("new").collect()] == [("v3.5.3", "v3.4.4"), ("v3.3.4", "v3.5.3")]


def test_efficiency(spark):
    stats = spark.createDataFrame([("a", 10, 1, 9), ("b", 0, 0, 0)], "version string, total long, updated long, skipped long")
    assert {r.version: r.efficiency for r in C.update_efficiency(stats).collect()} == {"a": 0.1, "b": 0.0, "all": 0.1}
