"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are taken target / source_size times each on average: the whole
part outright, the fraction by sampling.  The flight phase moves the fractions of three
documents at a time along the null space of the two balancing constraints (documents,
tokens) until each is 0 or 1.  It runs in blocks of documents; what few fractions a block
leaves fly again with those of the other blocks, and the last ones of a source land on the
side that keeps its tokens nearest to their total, trimmed by turning over a few settled
ones (ballast).

Draws are seeded from the block, and documents are in order there, so reruns agree.
Cases: null text has size 0; a null source is a source, last in order; null doc_ids come
first in a block; rows that are equal in id, text and source are rows of their own, counted
together and dealt over the blocks by number; extra columns are not read; an empty table
gives no rows; a source of size 0 has target 0 and takes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, repeated, row_keys

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 5_000
EDGE = 1e-9
#: Settled rows of a source's first block that may be turned over at the end, and how many are.
BALLAST, TURNS = 200, 4


def words(text: Column) -> Column:
    r"""The number of [^\x20\x09-\x0D]+ in text, null as empty."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_no, source_size, target: one row per source.

    A target is min(MOST * size, level * weight); the level is found by trying, in the order in
    which rising levels cap them, how many sources are capped.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # a row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    cap = F.col("source_size") * F.lit(MOST)
    by = by.withColumn("weight", weight).withColumn("cap", cap).withColumn("capped_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("capped_at", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source, by level at which it is capped, that the level of the rest does not cap
    by = by.withColumn("level", F.first(F.when(F.col("level") <= F.col("capped_at"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return by.select("source", "source_no", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """pi with all but at most two entries at 0 or 1; sums of pi and of pi * size are kept."""
    out = pi.tolist()
    weight = size.astype(np.float64).tolist()
    draws, used = rng.random(4096), 0
    held: list[int] = []
    for i, p in enumerate(out):
        if EDGE < p < 1 - EDGE:
            held.append(i)
        else:
            out[i] = float(round(p))
        while len(held) == 3:
            a, b, c = held
            u = (weight[c] - weight[b], weight[a] - weight[c], weight[b] - weight[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(held, u):
                if d > 0:
                    up, down = min(up, (1 - out[k]) / d), min(down, out[k] / d)
                elif d < 0:
                    up, down = min(up, out[k] / -d), min(down, (1 - out[k]) / -d)
            if used == len(draws):
                draws, used = rng.random(4096), 0
            go = up if draws[used] * (up + down) < down else -down
            used += 1
            for k, d in zip(held, u):
                out[k] += go * d
            left = [k for k in held if EDGE < out[k] < 1 - EDGE]
            for k in held:
                if k not in left:
                    out[k] = float(round(out[k]))
            held = left
    return np.array(out)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last few fractions, at most two, to 0 or 1: the choice nearest to their tokens, then to their number."""
    open_ = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE))
    out = pi.copy()
    want, many = float((pi[open_] * size[open_]).sum()), float(pi[open_].sum())
    choices = [np.array([(c >> k) & 1 for k in range(len(open_))], dtype=np.float64) for c in range(1 << len(open_))]
    out[open_] = min(choices, key=lambda s: (abs(float((s * size[open_]).sum()) - want), abs(float(s.sum()) - many)))
    return out.round()


def trim(size: np.ndarray, pi: np.ndarray, ballast: np.ndarray) -> np.ndarray:
    """Land pi, then turn over a few ballast rows as long as that brings the tokens nearer to their total."""
    done = landing(pi, size)
    over = float(((done - pi) * size).sum())
    for _ in range(TURNS):
        change = np.where(ballast & (size > 0), np.where(done == 1, -size, size), np.inf)
        at = int(np.argmin(np.abs(over + change)))
        if not abs(over + change[at]) < abs(over):
            break
        done[at] = 1 - done[at]
        over += change[at]
    return done


_KEPT = ["doc_id", "size", "source_no", "whole", "k1", "k2", "no"]
_OUT = "doc_id long, size long, source_no int, whole long, k1 long, k2 long, no long, pi double, ballast boolean"


def _fly(last: bool):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "size", "pi", "k1", "k2", "no")])
        pi, size = group.column("pi").to_numpy(), group.column("size").to_numpy()
        rng = np.random.default_rng([k.as_py() for k in key] + [group.num_rows])
        order = np.argsort(-size, kind="stable")
        out = np.empty(len(pi))
        out[order] = flight(pi[order], size[order], rng)
        if last:
            ballast = np.array(group.column("ballast").to_pylist(), dtype=bool)
            out = trim(size, out, ballast)
        else:
            ballast = np.zeros(len(pi), dtype=bool)
            if key[1].as_py() == 0:
                free = order[(pi[order] > EDGE) & (pi[order] < 1 - EDGE)]
                ballast[free[:: max(1, len(free) // BALLAST)]] = True
        return group.select(_KEPT).append_column("pi", pa.array(out)).append_column("ballast", pa.array(ballast))

    return run


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken is size times the copies it gets."""
    return decide(docs).drop("k1", "k2")


def decide(docs: DataFrame) -> DataFrame:
    """The rows of mix, with k1 and k2 (row_keys of id, text and source)."""
    k1, k2 = row_keys("doc_id", "text", "source")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("size"), "source", k1.alias("k1"), k2.alias("k2"))
    counted = materialize(rows.groupBy("doc_id", "size", "source", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")), "counted")
    sized = repeated(counted, "rows", "no").drop("rows")
    targets = materialize(source_targets(sized), "targets")
    n_sources = targets.count()
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(BLOCK))).cast("int")
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")).select(F.col("source").alias("of"), blocks.alias("blocks"))
    known = targets.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    known = known.withColumnRenamed("source", "of")
    if n_sources <= 10_000:
        known = F.broadcast(known)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ready = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    ready = ready.select("doc_id", "size", "source_no", F.floor("rate").cast("long").alias("whole"), "k1", "k2", "no", (F.col("rate") - F.floor("rate")).alias("pi"), F.pmod(F.xxhash64("k1", "k2", "no"), F.col("blocks")).cast("int").alias("block"))
    flown = materialize(ready.groupBy("source_no", "block").applyInArrow(_fly(False), _OUT), "flight")
    settled, open_ = [], (F.col("pi") > EDGE) & (F.col("pi") < 1 - EDGE)
    left, ballast = flown.filter(open_), flown.filter(~open_ & F.col("ballast"))
    settled.append(flown.filter(~open_ & ~F.col("ballast")))
    while True:
        most = left.groupBy("source_no").count().agg(F.max("count")).first()[0] or 0
        if most <= BLOCK:
            break
        deal = F.pmod(F.xxhash64("k1", "k2", "no", F.lit(5 + len(settled))), F.lit(-(-most // BLOCK) * 2)).cast("int")
        flown = materialize(left.withColumn("block", deal + 1).groupBy("source_no", "block").applyInArrow(_fly(False), _OUT), "flight")
        settled.append(flown.filter(~open_))
        left = flown.filter(open_)
    settled.append(left.withColumn("ballast", F.lit(False)).unionByName(ballast).groupBy("source_no").applyInArrow(_fly(True), _OUT))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    named = targets.select("source_no", "source_size", "target")
    if n_sources <= 10_000:
        named = F.broadcast(named)
    taken = (F.col("size") * (F.col("whole") + F.round("pi").cast("long"))).alias("taken")
    return out.join(named, "source_no").select("doc_id", "size", "source_size", "target", taken, (F.col("whole") + F.round("pi").cast("long")).alias("copies"), "source_no", "k1", "k2")
