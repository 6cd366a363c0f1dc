"""Decisions about documents brought back to whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import cube, odd_sketch
from cairn.llm.common import materialize, repeated, row_keys, small_or_shuffled


def take_copies(docs: DataFrame) -> DataFrame:
    """Rows of docs as often as the mix takes them; of rows equal in id, text and source one stands for all."""
    names = ("doc_id", "text", "source")
    totals = cube.decide(docs).groupBy("k1", "k2").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    totals = materialize(totals.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), "copies")
    n = totals.count()
    k1, k2 = row_keys(*names)
    keyed = docs.withColumn("_k1", k1).withColumn("_k2", k2)
    single = keyed.join(small_or_shuffled(totals.filter("_rows = 1").drop("_rows"), n, 24), ["_k1", "_k2"])
    single = single.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    many = totals.filter("_rows > 1").drop("_rows")
    if many.isEmpty():
        return single.select(*docs.columns)
    one = keyed.join(small_or_shuffled(many, n, 24), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return single.select(*docs.columns).unionByName(repeated(materialize(one, "equal-rows"), "_copies", "_no").select(*docs.columns))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, and all rows without words: rows go, not ids.

    The row with the smallest id stays, of rows without id any; of rows equal in id and text one.
    """
    gone, twice = (materialize(x, "surplus") for x in odd_sketch.surplus(docs))
    k1, k2 = row_keys()
    keyed = docs.withColumn("_k1", k1).withColumn("_k2", k2)
    named = lambda x: small_or_shuffled(x.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), x.count(), 16)
    out = keyed.join(named(gone), ["_k1", "_k2"], "left_anti")
    if not twice.isEmpty():
        one = out.join(named(twice), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
        out = out.join(named(twice), ["_k1", "_k2"], "left_anti").unionByName(one)
    return out.select(*docs.columns)
