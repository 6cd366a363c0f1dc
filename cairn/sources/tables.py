"""Tables read as virtual file trees: path, content, size, hash and, by name or content, mime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import classify
from cairn.functions.content import content_hash
from cairn.functions.paths import file_name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source/lang/doc_id.txt."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content")).withColumn("size", F.octet_length("content").cast("long")).withColumn("hash", content_hash(F.col("content")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as host and path of their address, without query and fragment; page_id stays, as paths repeat."""
    p = read(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"(?d)^[a-z]+://|[?#].*\z", "")  # as in SQL: only \n ends a line, and only the end is the end
    return p.select("page_id", path.alias("path"), F.col("html").alias("content")).withColumn("name", file_name(F.col("path"))).withColumn("size", F.octet_length("content").cast("long")).withColumn("hash", content_hash(F.col("content")))


def typed(files: DataFrame) -> DataFrame:
    """files with mime (null if neither name nor content tells) and categories."""
    named = files if "name" in files.columns else files.withColumn("name", file_name(F.col("path")))
    return classify.with_categories(classify.with_type(named))
