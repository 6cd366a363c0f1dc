"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import packing, quality, rows, secret_net
from cairn.llm.common import materialize, table
from cairn.llm.queries import WORD_TOKENIZER
from cairn.llm.tokens import tokenizer_path
from cairn.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and those without words (null, empty or blank texts).

    Rows are judged one by one, so null and repeated ids make no difference; an empty table stays empty.
    """
    ship(spark)
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows go, not ids: another text under the id of one that goes stays.  Rows without words stay; of rows
    without id that are near copies of each other one stays, if none with an id is among them.
    """
    ship(spark)
    return rows.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, null and empty texts as they are."""
    ship(spark)
    return secret_net.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows of size 0 are taken as their source's rate has it; a null source is a source; equal rows are
    taken as often as all of them together.
    """
    ship(spark)
    return rows.take_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; null and empty texts are their end id, rows without id come first."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Training and sampling have no SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
