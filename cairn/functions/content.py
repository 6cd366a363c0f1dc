"""Content hashes, archive names and readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of exactly the content's bytes."""
    return F.sha2(content.cast("binary"), 256)


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def archive_name(digest: Column) -> Column:
    """Content-addressed name, in one of 256 folders."""
    return F.concat(F.lit("files/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def size_unit(size: Column) -> Column:
    """Index of the unit: divided by 1024 while strictly more than that."""
    steps = F.lit(0)
    for k in range(1, len(UNITS)):
        steps = steps + F.when(size > F.lit(float(1024**k)), 1).otherwise(0)
    return steps


def size_value(size: Column) -> Column:
    return size.cast("double") / F.pow(F.lit(1024.0), size_unit(size))


def human_size(size: Column, decimals: int = 2) -> Column:
    """The value and its unit, null for a null size; a value halfway between two goes to the even digit, where Java's formats go up."""
    unit = F.element_at(F.array(*[F.lit(u.rjust(2)) for u in UNITS]), size_unit(size) + 1)
    return F.when(size.isNotNull(), F.concat(F.format_string(f"%.{decimals}f ", F.bround(size_value(size), decimals)), unit))
