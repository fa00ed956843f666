"""SimHash near-deduplication by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles: one word of 64 bits, and further words from
the same hashes mixed again. Two fingerprints within ``distance`` bits are found without comparing all of them: segments of the bits
are the keys of tables, and every fingerprint is entered in each table under all values of a small Hamming ball around its own, so
that two meet if the segment differs by at most twice the ball's radius. What shares a table entry is verified over all bits.

Which segments: for few bits, as many as make sure that any pair within the distance agrees in one (plan_all). For a distance of
many bits that would leave short keys, whose entries fill up with the number of texts; there segments grow with the logarithm
of that number, and so many are taken, over several orders of the bits, that a pair at ``sought`` bits is met with the
probability ``recall`` (plan_for). Closer pairs are met more surely, and groups have more than one link.

Equal fingerprints are one entry. An entry gives the links of a spanning tree, as many as it has members, not all of their
pairs. Entries of more than HOT members are split before any task gets them (dense_links).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, give_back, numbered, require, stash
from quarry.llm.components import connected_components

#: XXH64's primes (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
BLOCK = 1 << 18


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_same_length(words: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of the strings of one length at ``starts``; words[i] is the little-endian 64-bit word at byte i."""
    at, left = starts, length
    if length >= 32:
        firsts = (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))
        acc = [np.full(starts.shape, s % 2**64, np.uint64) for s in firsts]
        while left >= 32:
            acc = [_round(a, words[at + 8 * i]) for i, a in enumerate(acc)]
            at, left = at + 32, left - 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros_like(h), a)) * P1 + P4
    else:
        h = np.full(starts.shape, (seed + int(P5)) % 2**64, np.uint64)
    h = h + np.uint64(length)
    zero = np.zeros(starts.shape, np.uint64)
    while left >= 8:
        h = _rotl(h ^ _round(zero, words[at]), 27) * P1 + P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _rotl(h ^ ((words[at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, left = at + 4, left - 4
    while left:
        h = _rotl(h ^ ((words[at] & np.uint64(0xFF)) * P5), 11) * P1
        at, left = at + 1, left - 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hash_slices(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buffer[start:start+length] for each pair, a vector at a time for each length that is frequent."""
    out = np.empty(len(starts), np.uint64)
    low, high = int(starts.min()), int((starts + lengths).max())
    words = np.ndarray((high - low,), "<u8", buffer[low:high] + bytes(8), strides=(1,)).copy()
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        length = int(lengths[own[0]])
        if len(own) < 24:
            out[own] = [xxhash.xxh64_intdigest(buffer[s : s + length], seed) for s in starts[own].tolist()]
        else:
            out[own] = xxh64_same_length(words, starts[own] - low, length, seed)
    return out


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of h that begins at a start: in how many values each of the 64 bits is set. Shape (runs, 64).

    Eight counters of a byte each are added at once in a 64-bit word, over at most 255 values."""
    ends = np.append(starts[1:], len(h))
    pieces = -(-(ends - starts) // 255)
    first = np.cumsum(pieces) - pieces
    inner = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.empty((len(starts), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), inner)
        out[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(starts), 64)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes for a further word: splitmix64's finaliser of h plus so many golden ratios; h itself for word 0."""
    if not word:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(texts: list[str | None], width: int = 4, seed: int = 42, words: int = 1) -> np.ndarray:
    """SimHash of each text as uint64, of shape (texts, words). Memory beyond the texts and their word offsets is bounded by
    BLOCK shingles, whatever a text's length."""
    joined = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    counts, totals = np.zeros((words, len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    group: list[int] = []

    def count(docs: list[int]) -> None:
        buffer = b" ".join(joined[d] for d in docs) + b" "
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        begins = np.concatenate(([0], spaces[:-1] + 1))
        n_words = np.array([joined[d].count(b" ") + 1 for d in docs])
        n = np.maximum(n_words - width + 1, 1)
        first_word = np.cumsum(n_words) - n_words
        first = np.cumsum(n) - n
        word = np.repeat(first_word, n) + np.arange(n.sum()) - np.repeat(first, n)
        last = word + np.repeat(np.minimum(n_words, width), n) - 1
        starts, lengths = begins[word], spaces[last] - begins[word]
        doc_of = np.repeat(np.arange(len(docs)), n)
        for at in range(0, len(starts), BLOCK):
            own = slice(at, at + BLOCK)
            h = hash_slices(buffer, starts[own], lengths[own], seed)
            runs = np.flatnonzero(np.diff(doc_of[own], prepend=-1))
            for w in range(words):
                counts[w, np.array(docs)[doc_of[own][runs]]] += bit_counts(mixed(h, w), runs)
        totals[docs] = n

    held = 0
    for d, text in enumerate(joined):
        if text:
            group.append(d)
            held += len(text)
            if held > 1 << 20:
                count(group)
                group, held = [], 0
    if group:
        count(group)
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0].T


def fingerprint(text: Column, width: int = 4, seed: int = 42, words: int = 1) -> Column:
    """The SimHash of a text column as a struct of signed longs w0, ... Null counts as empty; a text without words has fingerprint 0."""

    @F.pandas_udf(f"struct<{', '.join(f'w{i}: long' for i in range(words))}>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame(fingerprints(s.tolist(), width, seed, words).view(np.int64), columns=_names(words))
        give_back()

    return run(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: A segment: which bits make the key, and the radius of the ball. Bit b is bit b % 64 of word b // 64.
Plan = list[tuple[tuple[int, ...], int]]
#: What a comparison of two fingerprints costs, in look-ups: both were measured.
COMPARISON = 0.0075


def plan_all(n: int, distance: int, words: int = 1) -> Plan:
    """Disjoint segments for n distinct fingerprints: the radii are such that every pair within ``distance`` meets in some table. The
    cheapest plan is chosen, by its look-ups and what they are expected to meet."""
    best = None
    for k in range(2, 6):  # segments of a word, each with a ball
        for large in range(k + 1):
            sizes = [2] * large + [1] * (k - large)
            if words * sum(2 * x + 1 for x in sizes) <= distance:
                continue
            base, more = divmod(64, k)
            bits = [base + (i < more) for i in range(k)]
            keys = [ball_size(b, x) for b, x in zip(bits, sizes, strict=True)]
            cost = sum(c * (1 + COMPARISON * n * c / 2**b) for b, c in zip(bits, keys, strict=True))
            plan = [(tuple(range(64 * w + sum(bits[:i]), 64 * w + sum(bits[: i + 1]))), sizes[i]) for w in range(words) for i in range(k)]
            best = min(best or (cost, plan), (cost, plan))
    if best is None:
        raise ValueError(f"no plan for {distance} of {64 * words} bits")
    return best[1]


def ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, i) for i in range(radius + 1))


def meets(bits: int, differing: int, segment: int, ball: int) -> float:
    """The probability that a segment of so many of the bits holds at most 2 * ball of the differing ones."""
    return sum(comb(differing, i) * comb(bits - differing, segment - i) for i in range(min(2 * ball, segment) + 1)) / comb(bits, segment)


def plan_for(n: int, words: int, sought: int, recall: float) -> Plan:
    """Segments for n distinct fingerprints by which a pair that differs in ``sought`` bits meets with probability ``recall``. Of all
    lengths and balls the cheapest is taken; keys become longer, and tables more, as n grows: look-ups and comparisons of a
    fingerprint by about the fourth root of n."""
    bits, best = 64 * words, None
    for length in range(10, 45):
        for ball in (1, 2):
            p = meets(bits, sought, length, ball)
            tables = ceil(log(1 - recall) / log1p(-p)) if p < 1 else 1
            cost = tables * (ball_size(length, ball) + COMPARISON * n * ball_size(length, 2 * ball) / 2**length)
            if tables < 1 << 14:
                best = min(best or (cost, length, ball, tables), (cost, length, ball, tables))
    _, length, ball, tables = best
    order, plan, each = list(range(bits)), [], bits // length
    rng = Random(17)
    while len(plan) < tables:
        plan += [(tuple(sorted(order[k * length : (k + 1) * length])), ball) for k in range(min(each, tables - len(plan)))]
        rng.shuffle(order)
    return plan


def work(plan: Plan, n: int) -> tuple[int, float]:
    """Look-ups of a fingerprint, and how many unlike ones of n it is expected to meet."""
    return sum(ball_size(len(b), r) for b, r in plan), sum(n * ball_size(len(b), 2 * r) / 2 ** len(b) for b, r in plan)


def segment_values(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The segment's bits of fingerprints (n, words) as numbers."""
    first = bits[0]
    if bits == tuple(range(first, first + len(bits))) and first // 64 == bits[-1] // 64:
        return (fp[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << len(bits)) - 1)
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def ball(bits: int, radius: int) -> np.ndarray:
    """The masks to flip."""
    from itertools import combinations

    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


#: A table's number stands above its keys, which have at most 44 bits.
TABLE = 48


def _names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def _schema(words: int, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{n} long" for n in _names(words))


def _batch(batch: pa.RecordBatch, words: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(words)], 1)


def look_ups(fps: DataFrame, plan: Plan, words: int) -> DataFrame:
    """Rows (key, words of the fingerprint): each fingerprint under the values of its balls."""
    flips = [ball(len(bits), radius) for bits, radius in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _batch(batch, words)
            for at in range(0, len(every), 1024):
                fp = every[at : at + 1024]
                for k, (bits, _) in enumerate(plan):
                    own = segment_values(fp, bits) + np.uint64(k << TABLE)
                    for f in range(0, len(flips[k]), 64):
                        flip = flips[k][f : f + 64]
                        key = (own[:, None] ^ flip[None, :]).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(fp[:, w], len(flip)).view(np.int64)) for w in range(words))], ["key", *_names(words)])

    return fps.select(*_names(words)).mapInArrow(run, f"key long, {_schema(words)}")


def crowded(fps: DataFrame, plan: Plan, words: int, hot: int) -> DataFrame:
    """The keys whose entries may hold more than ``hot`` fingerprints: those in the ball of a value that more than hot / (size of a
    ball) fingerprints have, for no other entry can. Values are counted with one row a table, not one a look-up."""
    least = hot / max(ball_size(len(bits), radius) for bits, radius in plan)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _batch(batch, words)
            for k, (bits, _) in enumerate(plan):
                yield pa.RecordBatch.from_arrays([pa.array((segment_values(fp, bits) + np.uint64(k << TABLE)).view(np.int64))], ["key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                bits, radius = plan[key >> TABLE]
                yield pa.RecordBatch.from_arrays([pa.array((np.uint64(key) ^ ball(len(bits), radius)).view(np.int64))], ["key"])

    many = fps.select(*_names(words)).mapInArrow(values, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return many.select("key").mapInArrow(around, "key long").distinct()


SMALL, SQUARE = 24, 1024  # buckets compared by shifting them against themselves, and as a square


def _verify(distance: int, words: int):
    """Rows sorted by key, each bucket in one partition -> links that span each bucket's groups."""

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits; the last axis of a and b holds the words."""
        return np.bitwise_count(a ^ b).astype(np.int16).sum(-1)

    def small(bucket: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(1, min(SMALL, len(bucket))):
            same = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(same):
                return
            near = same[apart(fp[same], fp[same + d]) <= distance]
            yield fp[near], fp[near + d]

    def square(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All links of a bucket, unless they are so many that a tree says the same in fewer."""
        total = np.zeros((len(fp), len(fp)), np.uint8)
        for w in range(words):
            total += np.bitwise_count(fp[:, None, w] ^ fp[None, :, w])
        a, b = np.nonzero(np.triu(total <= distance, 1))
        return (fp[a], fp[b]) if len(a) <= 4 * len(fp) else None

    def tree(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grows each group from a seed: a member is compared with what no group has reached yet, a vector at a time."""
        todo, links = fp, ([], [])
        while len(todo):
            queue, todo = [todo[0]], todo[1:]
            while queue and len(todo):
                member = queue.pop()
                near = apart(todo, member) <= distance
                if near.any():
                    found, todo = todo[near], todo[~near]
                    links[0].append(np.broadcast_to(member, found.shape))
                    links[1].append(found)
                    queue.extend(found)
        none = np.empty((0, words), np.uint64)
        return np.concatenate(links[0] or [none]), np.concatenate(links[1] or [none])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        sizes = np.diff(cuts)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        keep = (sizes[bucket] > 1) & (sizes[bucket] <= SMALL)
        found = list(small(bucket[keep], fp[keep]))
        for i in np.flatnonzero(sizes > SMALL):
            own = fp[cuts[i] : cuts[i + 1]]
            found.append((square(own) if len(own) <= SQUARE else None) or tree(own))
        a, b = (np.concatenate([x[i] for x in found] or [np.empty((0, words), np.uint64)]).view(np.int64) for i in (0, 1))
        if len(a):
            swap = np.zeros(len(a), bool)  # the smaller one first, word by word
            tied = ~swap
            for w in range(words):
                swap |= tied & (a[:, w] > b[:, w])
                tied &= a[:, w] == b[:, w]
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            both = np.unique(np.concatenate((a, b), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(2 * words)], [f"{side}{n}" for side in "ab" for n in _names(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + words))
            now = [key, np.stack(fp, 1).view(np.uint64)]
            last = np.flatnonzero(key != key[-1])
            whole = int(last[-1]) + 1 if len(last) else 0  # what comes after may go on in the next batch
            if held and (whole or held[-1][0][-1] != key[0]):
                yield from links(*(np.concatenate(x) for x in zip(*held, [x[:whole] for x in now], strict=True)))
                held = []
            elif whole:
                yield from links(*(x[:whole] for x in now))
            held.append([x[whole:] for x in now])
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        give_back()

    return run


def node(words: int, side: str = "") -> Column:
    """A fingerprint as one long: itself, or a hash of its words."""
    return F.col(f"{side}w0") if words == 1 else F.xxhash64(*(f"{side}{n}" for n in _names(words)))


#: Members of a table entry that one task takes whole; more are split. Fingerprints that stand for such an entry.
HOT, LEADERS = 8192, 64


def _verified(rows: DataFrame, distance: int, words: int) -> DataFrame:
    """Links (a, b) of rows (key, words) that share a key."""
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(distance, words), f"{_schema(words, 'a')}, {_schema(words, 'b')}")
    return found.select(node(words, "a").alias("a"), node(words, "b").alias("b"))


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, seen: the leaders that one member is near to, as masks by first leader) -> (key, leader, part): leaders that members join
    are one part, named by its first leader."""
    for f in frames:
        rows = []
        for key, seen in zip(f["key"], f["seen"], strict=True):
            part: dict[int, int] = {}

            def root(i: int, part: dict[int, int] = part) -> int:
                while part.setdefault(i, i) != i:
                    i = part[i]
                return i

            for s in seen:
                mask = s["mask"] % (1 << 64)
                for i in range(64):
                    if mask >> i & 1:
                        a, b = sorted((root(s["first"]), root(i)))
                        part[b] = a
            rows += [(key, i, root(i)) for i in part]
        yield pd.DataFrame(rows, columns=["key", "leader", "part"])


def dense_links(rows: DataFrame, distance: int, words: int, hot: int, leaders: int) -> DataFrame:
    """Links that join the same fingerprints as all pairs within distance do, from rows (key, words) of entries with many members.

    A few members lead each entry. Every member is compared with them, where it lies, and linked to the first one near it; leaders
    that a member joins are one part of the entry. As a rule an entry is a family of copies, and ends up as one part. Otherwise
    members of different parts, and members near no leader, are still to be compared: parts are cut into blocks, and each pair of
    blocks that may hold a new link is a task's work. No task holds more than two blocks, no pairs are written.
    """
    names = _names(words)
    rows = stash(rows, "dense")
    h = F.xxhash64(*names)
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(h, *names))).where(F.col("rank") <= leaders)
    led = stash(first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", *names))).alias("leaders")), "dense-leaders")
    apart = lambda x: sum((F.bit_count(x[n].bitwiseXOR(F.col(n))) for n in names[1:]), F.bit_count(x["w0"].bitwiseXOR(F.col("w0"))))
    near = F.filter("leaders", lambda x: apart(x) <= distance)
    seen = rows.join(led, "key").withColumn("near", near).select(
        "key", *names, F.get("near", F.lit(0)).alias("lead"), F.aggregate("near", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["rank"] - 1))).alias("mask"),
    )
    seen = stash(seen.withColumn("first", F.col("lead.rank") - 1), "dense-seen")
    to_lead = seen.where("lead is not null").select(node(words).alias("a"), (F.col("lead.w0") if words == 1 else F.xxhash64(*(f"lead.{n}" for n in names))).alias("b"))
    joins = seen.where("lead is not null").groupBy("key", "first").agg(F.bit_or("mask").alias("mask"))  # at most one row for each leader
    parts = joins.groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("seen")).mapInPandas(_joined, "key long, leader int, part int")
    parts = stash(parts, "dense-parts")
    name = lambda i: F.element_at("leaders", F.col(i) + 1)
    ends = parts.where("leader <> part").join(led, "key").select(*(F.struct(*(name(i)[n].alias(n) for n in names)).alias(side) for side, i in (("x", "leader"), ("y", "part"))))
    between = ends.select(*((F.col(f"{s}.w0") if words == 1 else F.xxhash64(*(f"{s}.{n}" for n in names))).alias(side) for s, side in (("x", "a"), ("y", "b"))))

    # members by part; -1: near no leader
    lone = F.lit(-1)
    member = seen.join(parts.withColumnRenamed("leader", "first"), ["key", "first"], "left").select("key", *names, F.coalesce("part", lone).alias("part"))
    member = stash(member, "dense-members")
    sizes = member.groupBy("key", "part").agg(F.count("*").alias("n"))
    open_keys = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.min("part").alias("least")).where((F.col("parts") > 1) | (F.col("least") == lone)).select("key")
    size = max(2, hot // 2)
    n_blocks = F.ceil(F.col("n") / size)
    counted = stash(sizes.join(open_keys, "key").select("key", "part", n_blocks.alias("blocks")), "dense-blocks")
    blocks = counted.select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    side = lambda s: blocks.select("key", F.struct("part", "block").alias(s))
    pairs = side("x").join(side("y"), "key").where((F.col("x") <= F.col("y")) & ((F.col("x.part") != F.col("y.part")) | (F.col("x.part") == lone)))
    pairs = pairs.select("key", F.xxhash64("key", "x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    placed = member.join(counted, ["key", "part"]).select("key", *names, F.struct("part", F.pmod(h, F.col("blocks")).alias("block")).alias("at"))
    rest = placed.join(pairs, ["key", "at"]).select(F.col("pair").alias("key"), *names)
    out = stash(to_lead.unionAll(between).unionAll(_verified(rest, distance, words)).where("a <> b"), "dense-links")
    for old in (rows, led, seen, parts, member, counted):
        discard(old)
    return out


def near_links(fps: DataFrame, distance: int, plan: Plan, words: int = 1, hot: int = HOT, leaders: int = LEADERS) -> DataFrame:
    """A stashed table of links (a, b) between the nodes of distinct fingerprints (w0, ...): their components are those of all pairs within
    distance that the plan's tables bring together."""
    rows, full = look_ups(fps, plan, words), stash(crowded(fps, plan, words, hot), "crowded")
    if full.isEmpty():
        return stash(_verified(rows, distance, words).distinct(), "simhash-links")
    dense = dense_links(rows.join(full, "key", "left_semi"), distance, words, hot, leaders)
    out = stash(_verified(rows.join(full, "key", "left_anti"), distance, words).unionAll(dense).distinct(), "simhash-links")
    discard(dense)
    return out


def _classes(rows: DataFrame, distance: int, words: int, sought: int | None, recall: float) -> DataFrame:
    """A stashed table (fp, component_id, keep): the smallest id of the component, and the number n of the row that stays. rows: stashed,
    with n, id, tie, fp and the fingerprint's words."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "n")).alias("first")
    distinct = stash(rows.groupBy("fp", *_names(words)).agg(first), "simhash-distinct")
    n = distinct.count()
    links = near_links(distinct, distance, plan_all(n, distance, words) if sought is None else plan_for(n, words, sought, recall), words)
    roots = connected_components(links, "a", "b")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "simhash-rooted")
    first = F.min(F.struct("first.none", "first.id", "fp", "first.n"))
    best = stash(rooted.groupBy("root").agg(first.alias("best")), "simhash-best")  # a table, so that a large group's rows can be split in the join
    classes = stash(rooted.join(best, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.n").alias("keep")), "simhash-classes")
    for old in (distinct, links, roots, rooted, best):
        discard(old)
    return classes


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4, words: int = 1, sought: int | None = None, recall: float = 0.95
) -> DataFrame:
    """One row per row of df: doc_id, w0, ... (the fingerprint's words as signed longs), component_id (the smallest id that links
    lead to, itself included) and stays (true for one row of each component: the smallest id, then the smallest fingerprint).

    Fingerprints have ``words`` words of 64 bits and link at up to ``distance`` differing bits: all pairs, or, if ``sought`` is
    given, those that the tables of plan_for() find. Null texts count as empty. Texts without words have fingerprint zero and are
    linked like any other. A text may be of any length; all of its shingles count. Rows that repeat an id each get a row, and
    of rows with id and fingerprint of the one that stays, one stays. Null ids are kept and are no component's smallest id
    unless all of its ids are null. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    require(df, id_col, text_col)
    names = _names(words)
    made = df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, seed, words).alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = stash(made.select("n", "id", F.lit(0).alias("tie"), "f.*").withColumn("fp", node(words)), "simhash")
    classes = _classes(rows, distance, words, sought, recall)
    return rows.join(classes, "fp").select(F.col("id").alias("doc_id"), *names, "component_id", (F.col("n") == F.col("keep")).alias("stays"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, distance: int = 48, words: int = 4, sought: int | None = 39, recall: float = 0.95) -> DataFrame:
    """The rows of df, with its columns, less all but one of each component of near_duplicates(): the smallest id stays, then the smallest
    fingerprint, then the smallest hash of the whole row. Nulls, repeats, ties and long texts are as there; columns may have any
    names. Texts are fingerprinted once and not shuffled where the rows that go are few enough to be broadcast by Spark."""
    require(df, id_col, text_col)
    names = _names(words)
    rows = numbered(df, "near-rows", F.col(id_col).alias("id"), F.xxhash64(*df.columns).alias("tie"), fingerprint(F.col(text_col), width, seed, words).alias("f"))
    flat = rows.select("n", "id", "tie", "f.*").withColumn("fp", node(words))
    classes = _classes(flat.select("n", "id", "tie", "fp", *names), distance, words, sought, recall)
    gone = stash(flat.select("n", "fp").join(classes, "fp").where("n <> keep").select("n"), "near-gone")
    return rows.join(gone, "n", "left_anti").select("row.*")
