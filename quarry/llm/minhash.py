"""MinHash near-duplicates: universal hash minima, bands, signatures, full sets, components.

Each text's set of word shingles gets ``MINIMA`` minima under universal hash functions, of which eight bits each are its
signature; six of them in a row are a band's key. Texts with equal sets are one node. Nodes that share a key are compared
by size and signature where the key's nodes meet; the texts of those that may be near enough go to a task that builds their full
sets and confirms a link only by these. Links are joined by large-star and small-star steps.

A family of copies shares most of its keys, and all pairs of it must not be compared. So a first round compares each
node with one other: of the leaders of its keys (the member with the smallest hash) the one that leads most of them. What this
joins is a part. The second round takes every key whose nodes are still in different parts: large parts are cut into blocks, all others
share blocks, and each pair of blocks that may hold a link between parts is one unit of work, with all of its pairs judged in
the first key that they share. Links inside a part cannot change the components, so none that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, give_back, require, stash
from quarry.llm.components import connected_components

#: Bands of six bytes. A pair with a resemblance of 0.8 shares none of them with a probability of 3e-6, one of 0.85 of 2e-9.
BANDS, ROWS = 42, 6
MINIMA = BANDS * ROWS

#: Nodes and shingles that a block of a unit holds.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19

_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
_MASK = (1 << 64) - 1


class _Hashes(dict):
    """XXH64 of words. Remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, known: _Hashes, width: int = 2) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words than ``width`` are one shingle, none are none."""
    body = (text or "").encode("utf-8", "surrogatepass").lower().translate(_WHITE)
    parts, at = [], 0
    while at < len(body):  # pieces, so that a very long text is never one list of words
        end = len(body) if len(body) - at <= 1 << 20 else body.find(b" ", at + (1 << 20))
        end = len(body) if end < 0 else end
        words = body[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(len(words), width)):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def functions(seed: int, n: int = MINIMA) -> tuple[np.ndarray, np.ndarray]:
    """n functions x -> ((a * x + b) mod 2**64) >> 32 of 32-bit keys, drawn from a strongly universal family."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, n), np.uint64, endpoint=False)
    return a[:, None], b[:, None]


def signature(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Eight bits of the smallest value of each function over a set."""
    a, b = family
    keys, best = found >> np.uint64(32), np.full(len(a), _MASK, np.uint64)
    for at in range(0, len(keys), 512):
        x = a * keys[at : at + 512]
        x += b
        np.minimum(best, x.min(1), out=best)  # the order of the high halves is that of the whole numbers
    return (best >> np.uint64(32)).astype(np.uint8)


def sets(text: Column, width: int, seed: int) -> Column:
    """Of a text column: the size of its set, a key that equal sets share, and the signature."""

    @F.arrow_udf("struct<size: long, set: binary, signature: binary>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, family = _Hashes(), functions(seed)
        for texts in it:
            size, key, sig = [], [], []
            for text in texts:
                found = shingles(text.as_py(), known, width)
                size.append(len(found))
                key.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig.append(signature(found, family).tobytes())
            yield pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["size", "set", "signature"])
        del known
        give_back()

    return run(text)


def _matrix(signatures: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, MINIMA)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) -> (key, node) for each band: its number and its six bytes."""
    for batch in batches:
        sig = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.int64)
        key = np.arange(BANDS, dtype=np.int64) << 48 | (sig << 8 * np.arange(ROWS)).sum(2)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, of batches that are sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        at = 0
        for end in ends if len(unit) else []:
            if held and held[-1].column(0)[0].as_py() != unit[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(size: np.ndarray, sig: np.ndarray, part: np.ndarray, percent: int, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of different parts, i < j, whose sizes allow a resemblance of percent / 100 and whose signatures agree in as many places as
    all but 1 in 3e6 of such pairs do (five standard deviations); with ``band``, those that share no key before."""
    share = percent / 100
    need = MINIMA * (share - 5 * (share * (1 - share) / MINIMA) ** 0.5)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(size), 32):
        own = slice(at, at + 32)
        fits = (part[own, None] != part) & (100 * np.minimum(size[own, None], size) >= percent * np.maximum(size[own, None], size))
        fits &= np.arange(at, min(at + 32, len(size)))[:, None] < np.arange(len(size))
        i, j = np.nonzero(fits)
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096] + at, j[k : k + 4096]
            same = sig[a] == sig[b]
            ok = np.count_nonzero(same, 1) >= need
            if band is not None:
                ok &= same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            out.append((a[ok], b[ok]))
    return np.concatenate([x[0] for x in out] or [np.zeros(0, int)]), np.concatenate([x[1] for x in out] or [np.zeros(0, int)])


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return rows.column("size").to_numpy(), _matrix(rows.column("signature")), rows.column("part").to_numpy()


def _candidates(percent: int):
    """Units (unit, band, node, part, size, signature) -> their rows that have a partner to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in _units(batches):
            if rows.num_rows > 1:
                band = rows.column("band")[0].as_py()
                wanted = np.unique(np.concatenate(pairs_of(*_columns(rows), percent, None if band < 0 else band)))
                if len(wanted):
                    held.append(rows.take(wanted))
                    n += len(wanted)
            if n >= 4096:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
        give_back()

    return run


def _confirm(percent: int, width: int):
    """Units with texts -> links (a, b) that join parts, each confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a, b = _Hashes(), [], []
        for rows in _units(batches):
            band, node = rows.column("band")[0].as_py(), rows.column("node").to_numpy()
            size, sig, part = _columns(rows)
            found = [shingles(t, known, width) for t in rows.column("text").to_pylist()]
            above: dict[int, int] = {}

            def root(x: int, above: dict[int, int] = above) -> int:
                while (up := above.get(x, x)) != x:
                    above[x] = above.get(up, up)
                    x = up
                return x

            for i, j in zip(*(x.tolist() for x in pairs_of(size, sig, part, percent, None if band < 0 else band)), strict=True):
                x, y = root(int(part[i])), root(int(part[j]))
                if x != y:
                    both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                    if 100 * both >= percent * (len(found[i]) + len(found[j]) - both):
                        above[x] = y
                        a.append(node[i])
                        b.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    return run


_UNIT = "unit long, band int, node long, part long, size long, signature binary"


def confirmed(units: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int, tag: str) -> DataFrame:
    """A stashed table of links (a, b) of units (unit, band, node, part); band -1: pairs are judged whatever keys they share."""
    rows = units.join(nodes.select("node", "size", "signature"), "node").select("unit", "band", "node", "part", "size", "signature")
    order = F.xxhash64("node")
    few = rows.repartition("unit").sortWithinPartitions("unit", order).mapInArrow(_candidates(percent), _UNIT)
    few = stash(few, f"{tag}-candidates")
    full = few.join(texts, "node").select("unit", "band", "node", "part", "size", "signature", "text")
    out = stash(full.repartition("unit").sortWithinPartitions("unit", order).mapInArrow(_confirm(percent, width), "a long, b long"), f"{tag}-links")
    discard(few)
    return out


def _first_round(live: DataFrame, leads: DataFrame) -> DataFrame:
    """Units of each node and the node that leads most of its keys: blocks of those that have one leader, each with the leader."""
    led = live.join(leads, "key").groupBy("node", "size", "leader").agg(F.count("*").alias("keys"))
    best = led.groupBy("node", "size").agg(F.max(F.struct("keys", "leader"))["leader"].alias("leader")).where("leader <> node")
    best = stash(best, "minhash-leaders")
    blocks = _blocks(best.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")))
    blocks = stash(blocks.select("leader", "blocks"), "minhash-leader-blocks")
    unit = F.xxhash64("leader", "block").alias("unit")
    members = best.join(blocks, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "blocks").alias("block")).select(unit, "node")
    heads = blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(unit, F.col("leader").alias("node"))
    return members.unionAll(heads).select("unit", F.lit(-1).alias("band"), "node", F.col("node").alias("part"))


def _blocks(sizes: DataFrame) -> DataFrame:
    """With (n, shingles): how many blocks they take."""
    return sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("long"))


def _second_round(live: DataFrame, parts: DataFrame) -> DataFrame:
    """Units of every pair of blocks of a key that may hold pairs of different parts."""
    labelled = stash(live.join(parts, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("part")), "minhash-labelled")
    split = stash(labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key"), "minhash-split")
    rows = stash(labelled.join(split, "key"), "minhash-open")
    large = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large = stash(large.where((F.col("n") > BLOCK_NODES) | (F.col("shingles") > BLOCK_SHINGLES)).select("key", "part", F.lit(True).alias("large")), "minhash-large")
    lone = F.lit(-1).cast("long")
    rows = rows.join(large, ["key", "part"], "left").select("key", "node", "size", "part", F.when(F.col("large"), F.col("part")).otherwise(lone).alias("own"))
    rows = stash(rows, "minhash-owned")
    blocks = stash(_blocks(rows.groupBy("key", "own").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))).select("key", "own", "blocks"), "minhash-blocks")
    each = blocks.select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    side = lambda s: each.select("key", F.struct("own", "block").alias(s))
    pairs = side("x").join(side("y"), "key").where((F.col("x") <= F.col("y")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.own") == lone)))
    pairs = pairs.select("key", F.xxhash64("key", "x", "y").alias("unit"), F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    placed = rows.join(blocks, ["key", "own"]).select("key", "node", "part", F.struct("own", F.pmod(F.xxhash64("node"), "blocks").alias("block")).alias("at"))
    return placed.join(pairs, ["key", "at"]).select("unit", F.shiftright("key", 48).cast("int").alias("band"), "node", "part")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """One row per row of df: doc_id, n_shingles (the size of its set), component_id (the smallest id that links lead to, itself included) and
    kept (whether it is that id).

    Texts are linked when their sets of distinct shingles of ``width`` words have a resemblance of percent / 100 or more, which is
    confirmed on the full sets; pairs at the threshold are missed with a probability of 3e-6, nearer ones with less. Words lie
    between ASCII white space, A-Z are lower-cased; fewer words are one shingle. Texts without words and null texts have an
    empty set and are linked with nothing. Equal sets are always linked. Texts may be of any length, all of their
    shingles count. Rows that repeat an id each get a row, all kept if one is. Null ids are kept and are no component's smallest
    id unless all of its ids are null. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    require(df, id_col, text_col)
    rows = df.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), sets(F.col(text_col), width, seed).alias("s"))
    rows = stash(rows.select("n", "id", "text", "s.*"), "minhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("n").alias("node"), "size", "signature")).alias("first")
    nodes = stash(rows.where("size > 0").groupBy("set").agg(first).select("set", "first.*"), "minhash-nodes")
    buckets = stash(nodes.select("node", "signature").mapInArrow(_bands, "key long, node long"), "minhash-bands")
    leads = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("leader"), F.count("*").alias("n"))
    leads = stash(leads.where("n > 1").select("key", "leader"), "minhash-leads")
    live = stash(buckets.join(leads.select("key"), "key").join(nodes.select("node", "size"), "node"), "minhash-live")
    discard(buckets)
    texts = rows.select(F.col("n").alias("node"), "text")
    near = confirmed(_first_round(live, leads), nodes, texts, percent, width, "minhash-first")
    parts = connected_components(near, "a", "b")
    more = confirmed(_second_round(live, parts), nodes, texts, percent, width, "minhash-second")
    roots = connected_components(near.unionAll(more), "a", "b")
    rooted = stash(nodes.join(roots, "node", "left").select("set", "none", "id", F.coalesce("root", "node").alias("root")), "minhash-rooted")
    best = stash(rooted.groupBy("root").agg(F.min(F.struct("none", "id"))["id"].alias("component_id")), "minhash-best")  # a table, so that a large group's rows can be split in the join
    classes = stash(rooted.join(best, "root").select("set", "component_id"), "minhash-classes")
    for old in (leads, live, near, parts, more, roots, rooted, best):
        discard(old)
    out = rows.select("id", "size", "set").join(classes, "set", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
