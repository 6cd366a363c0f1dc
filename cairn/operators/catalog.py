"""The catalogue: exact dedup of contents, stable ids, directory tree, constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify
from cairn.functions.paths import ancestors, file_name, name_extension, parent, stem
from cairn.operators.ordering import numbered


def blobs_of(files: DataFrame) -> DataFrame:
    """(hash, size, n_files, logical_bytes): one row per content."""
    return files.groupBy("hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("logical_bytes"))


def blob_ids(files: DataFrame, order: str = "file_id") -> DataFrame:
    """(hash, first, size, blob_id): contents numbered by their first file, whose size they take."""
    first = files.groupBy("hash").agg(F.min(F.struct(F.col(order).alias("first"), F.col("size"))).alias("x"))
    return numbered(first.select("hash", "x.first", "x.size"), [F.col("first").asc()], "blob_id")


def with_blobs(files: DataFrame, order: str = "file_id", blobs: DataFrame | None = None) -> DataFrame:
    """files with blob_id and new_blob (the first file of its content); blobs is blob_ids of them, if it is known."""
    blobs = blob_ids(files, order) if blobs is None else blobs
    return files.join(blobs.select("hash", "first", "blob_id"), "hash").withColumn("new_blob", F.col(order) == F.col("first")).drop("first")


def directories(files: DataFrame, root: str = "") -> DataFrame:
    """(path, name, parent_path, depth) of the root and every directory above a file."""
    above = files.select(F.explode(ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    made = above.select("path", file_name(F.col("path")).alias("name"), parent(F.col("path")).alias("parent_path"), F.size(F.split("path", "/")).alias("depth"))
    top = files.sparkSession.createDataFrame([("", root, None, 0)], "path string, name string, parent_path string, depth int")
    return top.unionByName(made)


def directory_ids(files: DataFrame, root: str = "") -> DataFrame:
    """directories with id (depth-first, a parent before its children) and parent_id."""
    made = numbered(directories(files, root), [F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")).asc()], "id")
    up = made.select(F.col("path").alias("_up"), F.col("id").alias("parent_id"))
    return made.join(up, F.col("parent_path") == F.col("_up"), "left").drop("_up")


def subtree(dirs: DataFrame, path: str) -> DataFrame:
    """The directories at and below path."""
    return dirs.filter((F.col("path") == path) | F.startswith("path", F.lit(path + "/" if path else "")))


def subtree_files(files: DataFrame, path: str, breadth_first: bool = False) -> DataFrame:
    """files at and below path with place, from 1: folder by folder in pre-order, or level by level; a folder's own files by path."""
    below = files.filter(F.startswith("path", F.lit(path + "/" if path else "")))
    folder = F.split(parent(F.col("path")), "/")
    keys = [folder.asc(), F.col("path").asc()]
    return numbered(below, [F.size(folder).asc(), *keys] if breadth_first else keys, "place")


def subtree_totals(files: DataFrame) -> DataFrame:
    """(path, n_files, n_bytes) of every directory, all levels below it counted."""
    every = files.select(F.explode(F.array_union(F.array(F.lit("")), ancestors(F.col("path")))).alias("path"), "size")
    return every.groupBy("path").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def catalogue(files: DataFrame, root: str = "", blobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """directories, files and blobs from files numbered in write order (path, size, hash, mime, file_id); blobs is blob_ids of them, if it is known."""
    dirs, blobs = directory_ids(files, root), blob_ids(files) if blobs is None else blobs
    placed = with_blobs(files, blobs=blobs).withColumn("_dir", parent(F.col("path")))
    ids = dirs.select(F.col("path").alias("_at"), F.col("id").alias("directory_id"))
    name = file_name(F.col("path"))
    rows = placed.join(ids, F.col("_dir") == F.col("_at")).select(F.col("file_id").alias("id"), stem(name).alias("name"), F.coalesce("mime", F.lit(classify.DEFAULT)).alias("mime"), name_extension(name).alias("extension"), "blob_id", "directory_id")
    return {
        "directories": dirs.select("id", "name", "parent_id"),
        "files": rows,
        "blobs": blobs.select(F.col("blob_id").alias("id"), "size", F.unhex("hash").alias("hash")),
    }


def checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): keys that repeat and references without target, of all three tables."""
    d, f, b = tables["directories"], tables["files"], tables["blobs"]

    def repeated(df: DataFrame, *key: str) -> DataFrame:
        return df.groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))

    def orphan(df: DataFrame, key: str, to: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).join(to.select(F.col("id").alias("_to")), F.col(key) == F.col("_to"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))

    found = {
        "directories id": repeated(d, "id"), "directories parent_id name": repeated(d, "parent_id", "name"), "files id": repeated(f, "id"), "files directory_id name extension": repeated(f, "directory_id", "name", "extension"), "blobs id": repeated(b, "id"), "blobs hash": repeated(b, "hash"),
        "directory parent": orphan(d, "parent_id", d), "file blob": orphan(f, "blob_id", b), "file directory": orphan(f, "directory_id", d),
    }
    out = None
    for name, df in found.items():
        row = df.select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def write(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each; an existing catalogue is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
