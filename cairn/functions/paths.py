"""Path and name expressions; separators are / and \\, and parts keep their blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[/\\]"


def stem(name: Column) -> Column:
    """What stands before the last dot; the whole name if it has none."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(?s)(.*)[.]([^.]*)$", 1)).otherwise(name)


def name_extension(name: Column) -> Column:
    """What stands after the last dot of a name, case kept; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(?s)(.*)[.]([^.]*)$", 2)).otherwise(F.lit(""))


def path_extension(path: Column) -> Column:
    """The extension of a path's last part; dots before the last separator do not count."""
    return F.regexp_extract(path, r"[.]([^./\\]*)$", 1)


def parts(path: Column) -> Column:
    """The parts between separators, without empty ones."""
    return F.filter(F.split(path, SEPARATORS), lambda x: x != "")


def is_directory(path: Column) -> Column:
    return path.rlike(r"[/\\]\z")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    """The path up to the last separator, without it; empty for a single part."""
    return F.regexp_extract(path, r"^(?s)(.*)[/\\][^/\\]*$", 1)


def relative_to(path: Column, root: Column) -> Column:
    """path below root, null if it is not below it."""
    base = F.rtrim(root, F.lit("/"))
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2))


def ancestors(path: Column) -> Column:
    """The paths of all directories above path, outermost first; nothing for a single part."""
    split = F.split(path, "/")
    return F.when(F.size(split) > 1, F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda i: F.array_join(F.slice(split, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
