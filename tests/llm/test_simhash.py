import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import connected_components


def brute_fingerprint(text, width=4, seed=42, words=1):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    parts = [" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)] if len(tokens) >= width else [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    out = 0
    for w in range(words):
        own = [again(h, w) for h in hashes]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) << 64 * w
    return out


def again(h, word):
    """splitmix64's finaliser, in Python's integers."""
    if word:
        h = (h + word * 0x9E3779B97F4A7C15) % 2**64
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
        h ^= h >> 31
    return h


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


TEXTS = ["", None, " ", "a", "A b", "É É x y z", "w" * 700 + " b c d e", "one two three four", "one two three four five"] + [" ".join(f"word{(i * j) % 97}" for i in range(j)) for j in range(1, 700, 37)]


@pytest.mark.parametrize("words", [1, 4])
def test_fingerprints_match_brute_force(words):
    got = simhash.fingerprints(TEXTS, words=words)
    assert [sum(int(x) << 64 * w for w, x in enumerate(row)) for row in got] == [brute_fingerprint(t, words=words) for t in TEXTS]


def test_vectorised_hash_of_every_length():
    data = bytes(random.Random(1).randrange(256) for _ in range(400)) * 40
    for n in (1, 3, 4, 7, 8, 12, 31, 32, 33, 40, 63, 64, 65, 100):
        starts = np.arange(0, 300, 3)
        got = simhash.hash_slices(data, starts, np.full(len(starts), n), 42)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s in starts.tolist()]


@pytest.mark.parametrize("distance,words", [(4, 1), (8, 1), (3, 1), (23, 2)])
@pytest.mark.parametrize("n", [100, 10**7, 10**11])
def test_every_plan_finds_every_pair(n, distance, words):
    """Whatever bits differ, the balls meet in some segment."""
    plan = simhash.plan_all(n, distance, words)
    assert sorted(b for bits, _ in plan for b in bits) == list(range(64 * words))
    rng = random.Random(2)
    for _ in range(3000):
        differing = set(rng.sample(range(64 * words), distance))
        assert any(len(differing.intersection(bits)) <= 2 * ball for bits, ball in plan)


@pytest.mark.parametrize("n", [100, 10**5, 10**7, 10**9])
def test_plan_with_recall(n):
    """As many pairs at the sought distance meet as was asked for; keys grow with n, and work far more slowly."""
    plan = simhash.plan_for(n, 4, 39, 0.95)
    rng, met = random.Random(5), 0
    for _ in range(2000):
        differing = set(rng.sample(range(256), 39))
        met += any(len(differing.intersection(bits)) <= 2 * ball for bits, ball in plan)
    assert met > 0.935 * 2000
    look_ups, unlike = simhash.work(plan, n)
    assert all(ball >= 1 and len(set(bits)) == len(bits) <= 44 for bits, ball in plan)
    assert look_ups < 60 * max(1, n / 1000) ** 0.25 and unlike < 3000 * max(1, n / 10**5) ** 0.3


def test_segment_values_and_balls_of_a_pair():
    rng = random.Random(1)
    fp = np.array([[rng.getrandbits(64) for _ in range(2)] for _ in range(50)], np.uint64)
    for bits in (tuple(range(3, 17)), tuple(range(60, 70)), (1, 5, 64, 99, 127)):
        want = [sum((int(f[b // 64]) >> b % 64 & 1) << k for k, b in enumerate(bits)) for f in fp]
        assert simhash.segment_values(fp, bits).tolist() == want
    for size, radius in ((10, 1), (12, 2)):
        flips = simhash.ball(size, radius)
        assert len(flips) == simhash.ball_size(size, radius)
        for _ in range(200):
            a = b = rng.getrandbits(size)
            for i in rng.sample(range(size), 2 * radius):
                b ^= 1 << i
            assert set((np.uint64(a) ^ flips).tolist()) & set((np.uint64(b) ^ flips).tolist())


def links_frame(spark, fps, words):
    signed = [[(x - 2**64 if x >= 2**63 else x) for x in ((f >> 64 * w) & (2**64 - 1) for w in range(words))] for f in fps]
    schema = "doc_id long, " + ", ".join(f"w{w} long" for w in range(words))
    return spark.createDataFrame([(i, *s) for i, s in enumerate(signed)], schema).withColumn("fp", simhash.node(words))


def components_of(df, links, n):
    by = {r["doc_id"]: r["fp"] for r in df.select("doc_id", "fp").collect()}
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    got = {}
    for i in range(n):
        got.setdefault(roots.get(by[i], by[i]), []).append(i)
    smallest = {i: min(g) for g in got.values() for i in g}
    return [smallest[i] for i in range(n)]


@pytest.mark.parametrize("distance,words", [(4, 1), (23, 2)])
def test_components_match_brute_force(spark, distance, words):
    rng = random.Random(4)
    size = 64 * words
    base = [rng.getrandbits(size) for _ in range(25)]
    fps = []
    for i in range(900):
        f = base[i % 3] if i < 500 else rng.choice(base)
        for b in rng.sample(range(size), rng.randrange(2 * distance)):
            f ^= 1 << b
        fps.append(f)
    df = links_frame(spark, fps, words)
    links = simhash.near_links(df.drop("doc_id").distinct(), distance, simhash.plan_all(len(set(fps)), distance, words), words)
    value = {r["fp"]: fps[r["doc_id"]] for r in df.collect()}
    assert all((value[r.a] ^ value[r.b]).bit_count() <= distance and r.a != r.b for r in links.collect())
    assert components_of(df, links, 900) == brute_components(range(900), fps, distance)


def families(rng, words, distance):
    """One large family of copies, one whose members reach each other only through others, and texts of their own."""
    size = 64 * words
    a, b = rng.getrandbits(size), rng.getrandbits(size)
    fps = []
    for _ in range(300):
        f = a
        for k in rng.sample(range(size), rng.randrange(distance)):
            f ^= 1 << k
        fps.append(f)
    for i in range(300):  # each some bits further on than the last, some steps being too long
        for k in rng.sample(range(size), distance + 1 if i % 50 == 0 else rng.randrange(1, distance)):
            b ^= 1 << k
        fps.append(b)
    return fps + [rng.getrandbits(size) for _ in range(100)]


@pytest.mark.parametrize("distance,words,hot,leaders", [(4, 1, 8, 3), (9, 2, 40, 64)])
def test_crowded_entries_are_split_without_loss(spark, distance, words, hot, leaders):
    fps = list(dict.fromkeys(families(random.Random(9), words, distance)))
    df = links_frame(spark, fps, words)
    plan = simhash.plan_all(len(fps), distance, words)
    own = df.drop("doc_id")
    assert simhash.crowded(own, plan, words, hot).count() > 0
    entries = simhash.look_ups(own, plan, words).groupBy("key").count().where(f"count > {hot}").select("key")
    assert entries.join(simhash.crowded(own, plan, words, hot), "key", "left_anti").count() == 0
    links = simhash.near_links(own, distance, plan, words, hot, leaders)
    assert components_of(df, links, len(fps)) == brute_components(range(len(fps)), fps, distance)


def test_no_task_gets_a_whole_crowded_entry(spark, monkeypatch):
    """What is compared in one piece stays below the bound, though one entry has 300 members."""
    fps = list(dict.fromkeys(families(random.Random(9), 1, 4)))
    df = links_frame(spark, fps, 1)
    real, sizes = simhash._verified, []

    def seen(rows, *more):
        sizes.append(rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return real(rows, *more)

    monkeypatch.setattr(simhash, "_verified", seen)
    simhash.near_links(df.drop("doc_id"), 4, simhash.plan_all(len(fps), 4, 1), 1, 40, 4)
    assert len(sizes) == 2 and max(sizes) <= 80  # two blocks of 20 and what hashing makes of it


def test_query_and_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text + " more"), (9, text), (9, text), (7, None), (8, ""), (None, "lonely one two three four"), (1, "x y z"), (1, "p q r s t")]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, w0 string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).withColumn("fingerprint", simhash.as_hex(F.col("w0"))).collect()), key=repr)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components([d for d, _ in rows], fps), strict=True)), key=repr)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    stays = simhash.near_duplicates(df).where("stays")
    assert stays.count() == len(set(brute_components(range(len(rows)), fps)))
    kept = simhash.keep_one(df.withColumn("n", F.lit("x")), width=4, distance=4, words=1, sought=None)
    assert kept.columns == ["doc_id", "text", "w0", "n"] and kept.count() == stays.count()
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [r.doc_id for r in stays.collect()]))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_path_graph_components(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[1001] == 1000
