import hashlib
import random
import re

import pytest

from quarry.llm import exact_dedup
from quarry.llm.exact_dedup import deduplicate

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        sha, left = hashlib.sha256(body.encode()).hexdigest(), True
        for r in own:
            kept = left and r == keep
            left = left and not kept
            out.append((r[0], keep[0], len(own), kept, sha))
    return sorted(out, key=repr)


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in deduplicate(df, **k).select(*COLUMNS).collect()), key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b"), (7, "x" * 300_000), (8, "x" * 300_000 + " "), (9, "é "), (10, "é"), (11, "ab"), (11, "ab"), (3, " a\tb\n"), (None, "only"), (None, "only"), (12, "Ab")]


def test_edge_cases(spark):
    assert run(spark, ROWS) == brute(ROWS)


@pytest.mark.parametrize("memory", [2_000, 100_000])
def test_spills_and_hot_groups(spark, memory):
    rng = random.Random(3)
    rows = [(i, "hot text" + " " * rng.randrange(4) if i % 3 == 0 else f"text {rng.randrange(400)}") for i in range(3000)]
    assert run(spark, rows, memory_bytes=memory) == brute(rows)


def test_grace_levels_in_one_task():
    """Deep recursion without Spark: a budget that holds a few texts."""
    rng = random.Random(5)
    records = []
    for i in range(2000):
        content = f"t{rng.randrange(700)}".encode()
        records.append((exact_dedup._hash(hashlib.sha256(content).digest()), content, rng.randrange(9), i, i, 1))
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        got = list(exact_dedup._resolve(iter(records), 1500, 0, folder))
    assert sorted(r[0] for r in got) == list(range(2000))
    sizes = {}
    for r in records:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    by_id = {r[3]: r for r in records}
    for record, keep, size, keeps, chars, sha in got:
        own = by_id[record]
        assert size == sizes[own[1]] and sha == hashlib.sha256(own[1]).hexdigest()
        best = min((r for r in records if r[1] == own[1]), key=lambda r: (-r[2], r[3]))
        assert (keep, chars) == (best[3], best[2]) and keeps == (record == keep)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", "h", 5), (2, "a", "k", 6)], "doc_id long, text string, h string, members long")
    assert sorted(r["kept"] for r in deduplicate(df).collect()) == [False, True]
    with pytest.raises(ValueError):
        deduplicate(df.drop("text"))


def test_matches_sql_digest(spark):
    df = spark.createDataFrame(ROWS[:12], "doc_id long, text string")
    from pyspark.sql import functions as F

    native = {r[0]: r[1] for r in df.select("doc_id", exact_dedup.squeezed_sha256(F.coalesce("text", F.lit("")))).collect()}
    assert all(native[r["doc_id"]] == r["text_sha256"] for r in deduplicate(df).collect())


def test_ids_of_a_hot_text_stay_apart(spark):
    """Half of the rows are one text: no row that is dealt out by content carries more than a count, however many copies a task has."""
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    real = exact_dedup.stash
    exact_dedup.stash = lambda frame, tag: seen.append(real(frame, tag)) or seen[-1]
    try:
        out = deduplicate(df)
        assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr) == brute(rows)
    finally:
        exact_dedup.stash = real
    hot = [len(r.members) for r in seen[0].where("decode(content, 'utf-8') = 'hot'").select("members").collect()]
    assert len(hot) == 5 and sum(hot) == 2000
