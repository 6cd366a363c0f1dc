"""MinHash near-dedup with odd sketches.

A document's set holds its distinct five-word shingles; documents of one set are a class,
and what follows compares classes.  Classes that share a MinHash band share a bucket.  In
every bucket, in blocks of bounded size, the XOR population count of odd sketches tells
which pairs may reach the threshold, and a forest of these pairs remains; the trees of all
buckets together are areas.  So two classes that share a bucket and may be similar are in
one area, and a chance meeting in a bucket joins no areas.  In an area of one block all
pairs are compared on their full sets, unless links found before connect them.  A larger
area is first compared around its nodes' smallest neighbours, and then, in blocks, what
that left apart: its smaller parts with all of it.

Words are hashed to 64 bits by a function that mixes eight bytes at a time, shingles by a
mixed sum of these; two different shingles of a pair of documents are taken for one with a
probability of 2**-64.

Cases: null or empty text, or text without words: set of size 0, linked with nothing.
Null doc_id: own row, component null, linked with nothing.  Rows that repeat a doc_id are
one node: what links with one of them is in the component of all, empty ones too.  Extra
columns are not read.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U64, buffers, int64, materialize, mix, row_keys, skew_join, slices, small_or_shuffled, text_array, word_hashes
from cairn.llm.graph import components

WORDS = 5
BANDS, ROWS = 25, 5
SAMPLES = 250
BITS = 512
#: Share of the pairs at the threshold that the sketches may lose.
LOST = 1e-9
#: Classes, and shingles, in one block of an area.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Rows of small buckets, and shingles of small areas, that one group holds, about.
BIN, BIN_SHINGLES = 2_000, 40_000
_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
SALTS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
STEP = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, of = word_hashes(data, off)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1] * STEP[0]
        for i in range(1, width):
            rolled = rolled + words[i : len(words) - width + 1 + i] * STEP[i % WORDS]
        rolled = mix(rolled)
    else:
        rolled = words[:0]
    out = []
    for a, b in zip(of[:-1], of[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(((words[a:b] * STEP[: b - a]).sum(dtype=np.uint64) + U64(b - a))[None]))
        else:
            out.append(words[:0])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES by len(sets); the sets are not empty."""
    low = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, spun = np.empty((SAMPLES, len(sets)), dtype=np.uint32), np.empty_like(low)
    for i, m in enumerate(MULTIPLIERS):
        np.multiply(low, m, out=spun)
        np.minimum.reduceat(spun, at, out=out[i])
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    wide = mins[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, -1)
    key = np.arange(BANDS, dtype=np.uint64)[:, None] + U64(77)
    for r in range(ROWS):
        key = mix(key * U64(0x2545F4914F6CDD1D) + wide[:, r])
    return key.T


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """BITS / 64 words per set: bit b is the parity of the samples that fall on b."""
    bit = (mix(mins.astype(np.uint64) + SALTS[:, None]) % U64(BITS)).astype(np.int64)
    n = mins.shape[1]
    odd = np.bincount((bit + np.arange(n) * BITS).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def differing_bits(threshold: float) -> np.ndarray:
    """The distribution of the XOR population count of a pair at threshold.

    Each sample differs with probability 1 - threshold and then turns over two random bits; the
    number of odd bits goes up or down by one with each turn.
    """
    odd = np.zeros(BITS + 1)
    odd[0] = 1.0
    up, down = 1 - np.arange(BITS + 1) / BITS, np.arange(BITS + 1) / BITS
    chance, out = (threshold**SAMPLES if threshold < 1 else 1.0), np.zeros(BITS + 1)
    for k in range(SAMPLES + 1):
        out += chance * odd
        chance *= (SAMPLES - k) / (k + 1) * (1 - threshold) / threshold
        for _ in range(2):
            odd = np.concatenate(([0.0], (odd * up)[:-1])) + np.concatenate(((odd * down)[1:], [0.0]))
    return out


def most_differing(threshold: float, lost: float = LOST) -> int:
    """The XOR population count that a pair at threshold exceeds with probability lost at most."""
    above = np.cumsum(differing_bits(threshold)[::-1])[::-1]  # at this count or above
    return int(np.flatnonzero(above > lost)[-1])


def _digest(one: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(one.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (row_keys), n_shingles, set_a, set_b (null for an empty set), bands, sketch."""
    names = ["doc_id", "k1", "k2", "n_shingles", "set_a", "set_b", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*buffers(text_array(batch.column("text"))))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                a, b = [None] * len(sets), [None] * len(sets)
                if full:
                    mins = minhashes([sets[i] for i in full])
                    for i, k, o in zip(full, int64(band_keys(mins)), int64(odd_sketches(mins))):
                        keys[i], sketch[i] = k, o
                        a[i], b[i] = _digest(sets[i])
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *made], names)

    k1, k2 = row_keys()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """k1, k2 and the shingle hashes of rows (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*buffers(text_array(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "k2", "shingles"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, shingles binary")


class Forest:
    """Union of nodes 0, 1, ...; the smallest names its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        x, y = self.find(i), self.find(j)
        self.root[max(x, y)] = min(x, y)
        return x != y

    def names(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root.copy()


def similar_pairs(run: np.ndarray, apart: np.ndarray, block: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int, most: int) -> np.ndarray:
    """A forest, as pairs of places, of the pairs in equal runs (adjacent places) that sketches leave possible.

    Where apart, only pairs of different blocks count.
    """
    forest, found, n = Forest(len(run)), [], len(run)
    name, named = forest.names(), 0
    for d in range(1, n):
        a = np.flatnonzero(run[d:] == run[:-d])
        if not len(a):
            break
        b = a + d
        if len(found) > named:
            name, named = forest.names(), len(found)
        ok = (name[a] != name[b]) & (~apart[a] | (block[a] != block[b])) & (np.minimum(size[a], size[b]) * den >= num * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= most
        found += [(i, j) for i, j in zip(a[near].tolist(), b[near].tolist()) if forest.join(i, j)]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, over the members that at least two of them have."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    shared = (many > 1)[at]
    at, row = place[at[shared]], row[shared]
    out = np.zeros((len(sets), max(1, (int((many > 1).sum()) + 63) // 64)), dtype=np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), U64(1) << (at & 63).astype(np.uint64))
    return out


def links_among(ids: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], num: int, den: int, most: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links between the rows, less what equal labels, if given, connect already.

    Every pair that the sketches leave possible is compared on the full sets, unless
    links found before already connect it.  With side, rows of side 1 are compared with those of
    side 2, and with those of side 0 whose ids are smaller, and no others.
    """
    n = len(ids)
    forest, size, links = Forest(n), np.array([len(s) for s in sets]), []
    for same in (ids, label):
        if same is not None and len(np.unique(same)) < n:
            _, first, of = np.unique(same, return_index=True, return_inverse=True)
            for i, j in enumerate(first[of.ravel()].tolist()):
                forest.join(i, j)
    bits = bitmaps(sets)
    for i in range(n):
        if side is None:
            other = np.arange(i + 1, n)
        elif side[i] == 1:
            other = np.flatnonzero((side == 2) | ((side == 0) & (ids < ids[i])))
        else:
            continue
        other = other[np.minimum(size[other], size[i]) * den >= num * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        differing = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        order = np.argsort(differing, kind="stable")
        other = other[order][: int(np.searchsorted(differing[order], most, side="right"))]
        step, name, named = 1, forest.names(), len(links)
        while len(other):
            if len(links) > named:
                name, named = forest.names(), len(links)
            other = other[name[other] != name[i]]
            now, other = other[:step], other[step:]
            if not len(now):
                break
            common = np.bitwise_count(bits[now] & bits[i]).sum(axis=1, dtype=np.int64)
            links += [(int(ids[i]), int(ids[j])) for j in now[common * den >= num * (size[now] + size[i] - common)] if forest.join(i, int(j))]
            step *= 4
    return links


def _by_group(compare: Callable[[pa.Table], list[tuple[int, int]]]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        found = compare(group)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _sketches(group: pa.Table) -> np.ndarray:
    return group.column("sketch").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).view(np.uint64)


def _alike(classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): forests of the classes that share a bucket and whose sketches leave them possible."""
    banded = classes.select("cls", F.explode("bands").alias("key"))
    whose = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *whose).filter("m > 1")
    # of buckets that hold the same classes, one
    buckets = materialize(buckets.groupBy("m", "h0", "h1").agg(F.min("key").alias("key")).select("key", "m", F.col("m").alias("weight")), "buckets")
    total = buckets.agg(F.sum("m")).first()[0] or 0
    held = skew_join(banded, buckets, ["key"], "weight", BANDS * n)
    held = held.join(classes.select("cls", "n", "sketch"), "cls").withColumn("parts", F.ceil(F.col("m") / F.lit(BLOCK_DOCS)).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("cls", "key"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("cls", "n", "sketch", "key", "block", "parts", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(1 + total // BIN))).otherwise(F.xxhash64("key", "i", "j"))
    most = most_differing(num / den)

    def compare(rows: pa.Table) -> list[tuple[int, int]]:
        rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cls", "ascending")])
        key, i, j, cls = (rows.column(c).to_numpy() for c in ("key", "i", "j", "cls"))
        run = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        pairs = similar_pairs(run, i != j, rows.column("block").to_numpy(), rows.column("n").to_numpy(), _sketches(rows), num, den, most)
        return [(int(a), int(b)) for a, b in cls[pairs]]

    return held.withColumn("g", group).groupBy("g").applyInArrow(_by_group(compare), "a long, b long")


def _linked(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): forests of the links in each (g, run) of members (g, run, cls, sketch, shingles; label and side or neither)."""
    most = most_differing(num / den)
    labelled = "label" in members.columns

    def compare(rows: pa.Table) -> list[tuple[int, int]]:
        rows, found = rows.sort_by([("run", "ascending"), ("cls", "ascending")]), []
        run = rows.column("run").to_numpy()
        for some in np.split(np.arange(len(run)), np.flatnonzero(run[1:] != run[:-1]) + 1):
            part = rows.slice(int(some[0]), len(some))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("shingles").to_pylist()]
            more = [part.column(c).to_numpy() for c in ("label", "side")] if labelled else []
            found += links_among(part.column("cls").to_numpy(), _sketches(part), sets, num, den, most, *more)
        return found

    return members.groupBy("g").applyInArrow(_by_group(compare), "a long, b long")


def _parts(count: str = "n_rows", shingles: str = "n_all") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(BLOCK_DOCS)), F.ceil(F.col(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    """key, parts (blocks that its rows need), n_rows, n_all (shingles)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_all")).withColumn("parts", _parts())


def _compare_areas(docs: DataFrame, classes: DataFrame, alike: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect whatever classes links connect."""
    areas = materialize(components(alike, "a", "b", "area"), "areas")
    n_near = areas.count()
    members = classes.select("cls", "n", "sketch", "k1", "k2").join(areas.withColumnRenamed("node", "cls"), "cls")
    k1, k2 = row_keys()
    wanted = members.select("k1", "k2")
    texts = docs.select("text", k1.alias("k1"), k2.alias("k2")).join(small_or_shuffled(wanted, n_near, 16), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    sizes = materialize(_sizes(members, "area"), "area-sizes")
    held = skew_join(members, sizes.select("area", "parts", "n_rows"), ["area"], "n_rows", n_near)
    held = materialize(held.join(_sets(texts), ["k1", "k2"]).drop("k1", "k2"), "sets")
    shingles, big = sizes.agg(F.sum("n_all"), F.count_if(F.col("parts") > 1)).first()
    few = held.filter("parts = 1").withColumn("g", F.pmod(F.xxhash64("area"), F.lit(1 + (shingles or 0) // BIN_SHINGLES))).withColumn("run", F.col("area"))
    first = _linked(few.select("g", "run", "cls", "sketch", "shingles"), num, den)
    if not big:
        return first
    # large areas: all that have the same smallest neighbour, in blocks, each with that neighbour
    held = held.filter("parts > 1").drop("parts")
    lower = alike.select(F.greatest("a", "b").alias("cls"), F.least("a", "b").alias("hub")).groupBy("cls").agg(F.min("hub").alias("hub"))
    led = held.join(lower, "cls", "left").withColumn("hub", F.coalesce("hub", "cls"))
    rooms = materialize(_sizes(led, "hub"), "rooms")
    dealt = skew_join(led, rooms.select("hub", "parts", "n_rows"), ["hub"], "n_rows", n_near).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    heads = held.join(rooms.select(F.col("hub").alias("cls"), "parts"), "cls").withColumn("hub", F.col("cls")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = [x.select(F.xxhash64("hub", "part").alias("g"), F.col("hub").alias("run"), "cls", "sketch", "shingles") for x in (dealt, heads)]
    first = materialize(first.unionByName(_linked(rows[0].unionByName(rows[1]), num, den)), "first-links")
    # what is still apart in a large area: all parts but the largest, each with everything
    joined = components(first, "a", "b", "label")
    named = materialize(held.select("cls", "area", "n").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labels")
    counted = named.groupBy("area", "label").agg(F.count(F.lit(1)).alias("c"))
    split = counted.groupBy("area").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("n_rows")).filter("labels > 1")
    split = materialize(split.select("area", F.col("top.label").alias("largest"), "n_rows"), "split")
    if split.isEmpty():
        return first
    open_ = skew_join(named, split, ["area"], "n_rows", n_near).withColumn("minor", F.col("label") != F.col("largest"))
    minors = _sizes(open_.filter("minor"), "area").select("area", F.col("parts").alias("chunks"))
    rooms = materialize(_sizes(open_, "area").join(minors, "area").select("area", "parts", "chunks", "n_rows"), "rooms")
    open_ = skew_join(open_, rooms, ["area"], "n_rows", n_near).select("cls", "area", "label", "minor", "parts", "chunks").join(held.select("cls", "sketch", "shingles"), "cls")
    everyone = open_.withColumn("p", F.pmod(F.xxhash64("cls"), "parts").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    again = open_.filter("minor").withColumn("c", F.pmod(F.xxhash64("cls", F.lit(1)), "chunks").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a small part's rows meet those of the largest, and of two of small parts the larger number meets the smaller
    everyone = everyone.withColumn("side", F.when(F.col("minor"), 0).otherwise(2))
    rows = [x.select(F.xxhash64("area", "p", "c").alias("g"), F.col("area").alias("run"), "cls", "label", "side", "sketch", "shingles") for x in (everyone, again.withColumn("side", F.lit(1)))]
    return first.unionByName(_linked(rows[0].unionByName(rows[1]), num, den))


def grouped(docs: DataFrame, num: int, den: int, ids_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, n_shingles, set_a, set_b), classes (set_a, set_b, cls, m, best) and links (a, b) of classes.

    best is the least (no id, doc_id, k1, k2) of a class; with ids_only rows without id are in no class.
    """
    sig = materialize(signatures(docs), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
    usable = sig.filter("set_a is not null and doc_id is not null" if ids_only else "set_a is not null")
    made = usable.groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("m"), best, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(made.withColumn("cls", F.monotonically_increasing_id()).withColumn("k1", F.col("best.k1")).withColumn("k2", F.col("best.k2")), "classes")
    alike = materialize(_alike(classes, classes.count(), num, den), "alike")
    links = materialize(_compare_areas(docs, classes, alike, num, den), "links")
    return sig, classes, links


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; documents link if den * intersection >= num * union."""
    sig, classes, links = grouped(docs, num, den, True)
    own = sig.filter("set_a is not null and doc_id is not null").select("doc_id", "set_a", "set_b")
    place = F.struct("set_a", "set_b")
    repeated = materialize(own.groupBy("doc_id").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("rows")).filter("x <> y").select("doc_id", "rows"), "repeated")
    numbers = classes.select("set_a", "set_b", "cls", "m")
    if not repeated.isEmpty():  # the classes of one id are one node
        n = sig.count()
        several = skew_join(skew_join(own, repeated, ["doc_id"], "rows", n).distinct(), numbers, ["set_a", "set_b"], "m", n)
        several = materialize(several.select("doc_id", "cls"), "several")
        first = several.groupBy("doc_id").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("rows"))
        links = links.unionByName(skew_join(several, first, ["doc_id"], "rows", n).select(F.col("cls").alias("a"), "b"))
    joined = components(links, "a", "b", "top").withColumnRenamed("node", "cls")
    named = classes.select("set_a", "set_b", "cls", "m", F.col("best.doc_id").alias("low")).join(joined, "cls", "left")
    named = materialize(named.withColumn("top", F.coalesce("top", "cls")), "named")
    least = materialize(named.groupBy("top").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("rows")), "least")
    low = materialize(skew_join(named, least, ["top"], "rows", classes.count()).select("set_a", "set_b", "least", "m"), "low")
    rows = sig.count()
    out = skew_join(sig.select("doc_id", "n_shingles", "set_a", "set_b"), low, ["set_a", "set_b"], "m", rows, "left")
    empty = sig.filter("set_a is null and doc_id is not null").select("doc_id").distinct()
    n_empty = empty.count()
    if n_empty:  # an empty row of an id that has others
        others = out.filter("set_a is not null").join(small_or_shuffled(empty, n_empty, 8), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("least").alias("of_id"))
        out = out.join(others, "doc_id", "left").withColumn("least", F.coalesce("least", "of_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def surplus(docs: DataFrame, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(k1, k2) of the rows that are not the first of their group of near copies, by id and then row_keys; and of first ones that occur more than once.

    Here rows are what links, whatever their ids, and rows without id take part, after all others.
    """
    sig, classes, links = grouped(docs, num, den, False)
    joined = components(links, "a", "b", "top").withColumnRenamed("node", "cls")
    named = classes.select("set_a", "set_b", "cls", "m", "best").join(joined, "cls", "left")
    named = materialize(named.withColumn("top", F.coalesce("top", "cls")), "named")
    first = materialize(named.groupBy("top").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("rows")), "first")
    kept = materialize(skew_join(named.drop("best"), first, ["top"], "rows", classes.count()).select("set_a", "set_b", "m", F.col("first.k1").alias("x"), F.col("first.k2").alias("y")), "kept")
    rows = sig.filter("set_a is not null").select("k1", "k2", "set_a", "set_b")
    judged = materialize(skew_join(rows, kept, ["set_a", "set_b"], "m", sig.count()).select("k1", "k2", ((F.col("k1") == F.col("x")) & (F.col("k2") == F.col("y"))).alias("stays")), "judged")
    return judged.filter("not stays").select("k1", "k2").distinct(), judged.filter("stays").groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
