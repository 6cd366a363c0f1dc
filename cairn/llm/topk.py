"""Exact top-k by integer inner product, with a uniform threshold in three phases.

A score is the sum of the partial scores of SLICES runs of components, and each slice is a
table of its own: it holds its components of all vectors and knows nothing of the others.
Phase 1 gathers from each slice the list of the k highest partial scores of every query.
The whole scores of what the lists name give a cutoff, the k-th best of them, that no answer
is below.  The cutoffs go to all slices with the queries.  Phase 2 collects from each slice
the entries whose partial score reaches cutoff / slices: what does so in no slice sums to
less than the cutoff.  Phase 3 drops the entries that cannot reach the cutoff even with
all that a slice not naming them may hide, fetches the missing partial scores of the others,
and ranks.

Equal vectors are one candidate, with the k + 1 smallest of its ids (a query may be one of
them), so a vector that many rows share is compared, and collected, once.

Cases: vectors null, empty or holding null or non-finite components take no part; vectors
of another length than the query are no candidates of it; null ids take no part; of rows
that repeat an id each is a candidate, but never for its own id, and the one with the
smallest vector asks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize

SLICES = 2
QUERIES, ROWS = 1024, 8192
#: Bytes of query components that are broadcast at most; beyond, they are shuffled to groups of row blocks.
BROADCAST, GROUP = 64 << 20, 32
#: Stands for no second id, and for no cutoff.
NONE = -(1 << 62)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and the floored components of vectors that take part, with their number."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size(v).alias("width"))


def candidates(whole: DataFrame, k: int) -> DataFrame:
    """key, width, v, low, low2 (NONE if there is none), members (vec_id, copies): a row for each distinct vector.

    members are its k + 1 smallest ids, copies (k at most) how often each occurs.
    """
    counted = whole.groupBy("width", "v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("width", "v").orderBy("vec_id"))
    few = counted.withColumn("place", place).filter(F.col("place") <= k + 1)
    made = few.groupBy("width", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("members"))
    ids = [F.coalesce(F.get("members", F.lit(i))["vec_id"], F.lit(NONE)) for i in (0, 1)]
    return made.select(F.monotonically_increasing_id().alias("key"), "width", "v", ids[0].alias("low"), ids[1].alias("low2"), "members")


def bounds(width: int, s: int, slices: int) -> tuple[int, int]:
    """The components of slice s; a vector of fewer components than slices has only as many."""
    own = min(slices, width)
    return (width * s // own, width * (s + 1) // own) if s < own else (0, 0)


def blocks(rows: DataFrame, longs: list[str], size: int, s: int, slices: int) -> DataFrame:
    """width, n, the named longs and the matrix of slice s (row-major little-endian 64-bit) of runs of up to size rows of equal width."""
    names = ["width", "n", *longs, "matrix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}

        def out(width: int) -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held.pop(width))]
            return pa.RecordBatch.from_arrays([pa.array([width]), pa.array([len(cols[0])]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names)

        for batch in batches:
            wide, flat = batch.column("width").to_numpy(), batch.column("v").flatten().to_numpy()
            of = np.concatenate(([0], np.cumsum(wide)))
            for width in np.unique(wide).tolist():
                low, high = bounds(width, s, slices)
                for at in np.array_split(np.flatnonzero(wide == width), -(-int((wide == width).sum()) // size)) if high > low else ():
                    m = flat[of[at][:, None] + np.arange(low, high)]
                    held.setdefault(width, []).append([*(batch.column(c).to_numpy()[at] for c in longs), m])
                    if sum(len(x[0]) for x in held[width]) >= size:
                        yield out(width)
        for width in list(held):
            yield out(width)

    kinds = ", ".join(f"{n} {'long' if n in names[:2] else 'binary'}" for n in names)
    return rows.select(*longs, "v", F.col("width").cast("long").alias("width")).mapInArrow(run, kinds)


def _partial(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: by floats where sums stay below 2**53, else by integers."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    return q.astype(kind) @ x.astype(kind).T


def _visit(rows: DataFrame, queries: DataFrame, small: bool, choose: Callable[..., tuple[np.ndarray, np.ndarray]], slices: int) -> DataFrame:
    """(query_id, key, part) of what choose(partial scores, cuts, slices of the width) picks in every block of one slice (own marks a query's own vector).

    Rows stay where they are if the queries are small; else queries go to groups of row blocks.
    """
    asked = queries.withColumnsRenamed({"matrix": "query_matrix", "n": "n_queries"})
    if small:
        met = rows.join(F.broadcast(asked), "width")
    else:
        groups = max(1, rows.count() // GROUP)
        met = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).join(asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), ["width", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, nq, n = (batch.column(c)[i].as_py() for c in ("width", "n_queries", "n"))
                read = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.int64)  # noqa: E731, B023
                qid, cut, key, low, low2 = read("query_id"), read("cut"), read("key"), read("low"), read("low2")
                part = _partial(read("query_matrix").reshape(nq, -1), read("matrix").reshape(n, -1))
                own = (low == qid[:, None]) & (low2 == NONE)
                a, b = choose(part, own, cut, min(slices, width))
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(key[b]), pa.array(part[a, b].astype(np.int64))], ["query_id", "key", "part"])

    return met.select("width", "n", "n_queries", "query_id", "cut", "query_matrix", "key", "low", "low2", "matrix").mapInArrow(run, "query_id long, key long, part long")


def highest(k: int) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """Places of the k highest partial scores of each query in a block."""

    def choose(part: np.ndarray, own: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
        part = np.where(own, np.iinfo(np.int64).min if part.dtype == np.int64 else -np.inf, part)
        near = np.argpartition(part, part.shape[1] - k, axis=1)[:, -k:] if part.shape[1] > k else np.tile(np.arange(part.shape[1]), (len(part), 1))
        a, b = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel()
        keep = ~own[a, b]
        return a[keep], b[keep]

    return choose


def least_part(cut: np.ndarray, slices: int) -> np.ndarray:
    """The smallest whole number of at least cut / slices."""
    return -(-cut // slices)


def reaching(part: np.ndarray, own: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the partial scores of at least cutoff / slices."""
    return np.nonzero((part >= least_part(cut, slices)[:, None]) & ~own)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def phases(vectors: DataFrame, k: int = 10, every: int = 100, slices: int = SLICES) -> dict[str, DataFrame]:
    """The three phases: cutoffs (query_id, cut), collected (query_id, key, known, mask), fetched (those whose missing parts were), top."""
    whole = integers(vectors)
    rows = materialize(candidates(whole, k), "candidates")
    asking = whole.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("width", "v")).alias("x"))
    asking = materialize(asking.select(F.col("vec_id").alias("query_id"), "x.width", F.col("x.v").alias("v")), "queries")
    n, cells = asking.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    small = cells * 8 <= BROADCAST
    parts = [materialize(blocks(rows, ["key", "low", "low2"], ROWS, s, slices), f"slice-{s}") for s in range(slices)]

    def visit(queries: DataFrame, choose: Callable, s: int) -> DataFrame:
        return _visit(parts[s], blocks(queries.repartition(max(1, -(-n // QUERIES))), ["query_id", "cut"], QUERIES, s, slices), small, choose, slices)

    def whole_score(pairs: DataFrame, known: Column | None = None, mask: Column | None = None) -> DataFrame:
        """pairs with score: known and the parts that are not in mask."""
        out = pairs.join(rows.select("key", "v", "width"), "key").join(asking.select("query_id", F.col("v").alias("q")), "query_id")
        own, score = F.least("width", F.lit(slices)), F.lit(0).cast("long") if known is None else known
        for s in range(slices):
            low, high = (F.floor(F.col("width") * (s + i) / own).cast("int") for i in (0, 1))
            part = _dot(F.slice("v", low + 1, high - low), F.slice("q", low + 1, high - low))
            here = (F.lit(s) < own) if mask is None else (F.lit(s) < own) & (mask.bitwiseAND(1 << s) == 0)
            score = score + F.when(here, part).otherwise(F.lit(0).cast("long"))
        return out.withColumn("score", score).drop("v", "q")

    # phase 1
    uncut = asking.withColumn("cut", F.lit(NONE).cast("long"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "key"))
    lists = None
    for s in range(slices):
        one = visit(uncut, highest(k), s).withColumn("place", place).filter(F.col("place") <= k).select("query_id", "key")
        lists = one if lists is None else lists.union(one)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    scored = whole_score(materialize(lists.distinct(), "lists"))
    cuts = materialize(scored.withColumn("place", best).filter(F.col("place") == k).select("query_id", F.col("score").alias("cut")), "cutoffs")
    # phase 2
    cutting = asking.join(cuts, "query_id", "left").withColumn("cut", F.coalesce("cut", F.lit(NONE).cast("long")))
    entries = None
    for s in range(slices):
        one = visit(cutting, reaching, s).withColumn("bit", F.lit(1 << s))
        entries = one if entries is None else entries.union(one)
    collected = materialize(entries.groupBy("query_id", "key").agg(F.sum("part").alias("known"), F.bit_or("bit").alias("mask")), "collected")
    # phase 3
    judged = collected.join(cutting.select("query_id", F.least("width", F.lit(slices)).cast("long").alias("own"), "cut"), "query_id")
    missing = F.col("own") - F.bit_count("mask")
    most = F.col("known") + missing * (F.ceil(F.col("cut") / F.col("own")).cast("long") - 1)
    able = judged.filter((F.col("cut") == NONE) | (missing == 0) | (most >= F.col("cut")))
    done = able.filter(missing == 0).select("query_id", "key", "cut", F.col("known").alias("score"))
    fetched = whole_score(able.filter(missing > 0), F.col("known"), F.col("mask")).select("query_id", "key", "cut", "score")
    found = done.unionByName(fetched).filter(F.col("score") >= F.col("cut"))
    named = found.join(rows.select("key", "low", "low2", "members"), "key").withColumn("id", F.when(F.col("low") == F.col("query_id"), F.col("low2")).otherwise(F.col("low")))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    named = named.withColumn("place", first).filter(F.col("place") <= k).select("query_id", "score", F.explode("members").alias("m"))
    named = named.select("query_id", "score", F.col("m.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.copies").cast("long"))).alias("copy")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return {"cutoffs": cuts, "collected": collected, "fetched": fetched, "top": top}


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for each query (vec_id divisible by every)."""
    return phases(vectors, k, every)["top"]
