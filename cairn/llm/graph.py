"""Connected components: small graphs in one task, others by alternating large-star and small-star rounds in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairn.llm.common import SMALL, discard, materialize, skew_join


def _lowest(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the smallest v of u; hubs, whose edges would fill a task, are split."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return skew_join(edges, low, ["u"], "degree", n)


def _largest(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above u gets the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _smallest(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of u, and u, get the smallest of them."""
    down = _lowest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
    return down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).distinct()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (u, v) of one task."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], ["node", "low"])


def components(edges: DataFrame, a: str, b: str, name: str = "component", rounds: int = 60) -> DataFrame:
    """(node, name) for every node of at least one edge; name is the smallest node of its component.

    Up to SMALL edges, which are counted, one task joins them: 16 bytes each.  More go through the rounds;
    the edges of a round never outnumber those of the last one; each round is written to the shared folder
    and the one before it deleted.  Edges with a null end and loops are left out.
    """

    def settled(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("hash")), "edges")
        return out, (seen.get["n"], seen.get["hash"])

    now, state = settled(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct())
    if state[0] <= SMALL:
        return now.coalesce(1).mapInArrow(_small, "node long, low long").withColumnRenamed("low", name)
    before = None
    for _ in range(rounds):
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias(name)).union(now.select("v", "v")).distinct()
        before, last = state, now
        wide = materialize(_largest(last, state[0]), "edges")
        now, state = settled(_smallest(wide, state[0]))
        discard(last)
        discard(wide)
    raise RuntimeError("components did not settle")
