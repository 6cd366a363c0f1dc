import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import content, paths


@pytest.mark.parametrize(
    "name, stem, extension",
    [("a", "a", ""), ("a.", "a", ""), (".a", "", "a"), ("a.b.c", "a.b", "c"), ("README", "README", ""), ("A.TXT", "A", "TXT"), (" x .y ", " x ", "y ")],
)
def test_names(spark, name, stem, extension):
    n = F.lit(name)
    assert tuple(spark.range(1).select(paths.stem(n), paths.name_extension(n)).first()) == (stem, extension)


def test_paths(spark):
    def one(e):
        return spark.range(1).select(e.alias("x")).first()["x"]

    assert one(paths.path_extension(F.lit("a.b/c"))) == ""
    assert one(paths.path_extension(F.lit("a.b\\c.d"))) == "d"
    assert one(paths.parts(F.lit("a\\ b//c/"))) == ["a", " b", "c"]
    assert one(paths.is_directory(F.lit("a/"))) and not one(paths.is_directory(F.lit("a")))
    assert one(paths.slashed(F.lit("a\\b"))) == "a/b"
    assert one(paths.relative_to(F.lit("/r/a/b"), F.lit("/r/"))) == "a/b"
    assert one(paths.relative_to(F.lit("/rx/a"), F.lit("/r"))) is None
    assert one(paths.ancestors(F.lit("a/b/c"))) == ["a", "a/b"] and one(paths.ancestors(F.lit("a"))) == []
    assert one(content.content_hash(F.lit(""))) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(content.as_hex(F.lit(b"\x0a\xff"))) == "0aff"


@pytest.mark.parametrize("size, text", [(0, "0.00  B"), (1, "1.00  B"), (1023, "1023.00  B"), (1024, "1024.00  B"), (1025, "1.00 KB"), (1048576, "1024.00 KB"), (1048577, "1.00 MB"), (5 << 40, "5.00 TB")])
def test_sizes(spark, size, text):
    assert spark.range(1).select(content.human_size(F.lit(size).cast("long"))).first()[0] == text


@pytest.mark.parametrize("size, text", [(1152, "1.12 KB"), (9856, "9.62 KB"), (1408, "1.38 KB"), (1153, "1.13 KB"), (1151, "1.12 KB"), ((1 << 20) + (1 << 17), "1.12 MB"), ((1 << 20) + (1 << 17) + 1, "1.13 MB"), (None, None)])
def test_sizes_halfway_go_to_the_even_digit(spark, size, text):
    assert spark.range(1).select(content.human_size(F.lit(size).cast("long"))).first()[0] == text


def test_path_forms_of_halfway_sizes_as_in_sql(spark, tmp_path):
    import __spark_entry__ as entry

    sizes = [None, 0, 1, 1023, 1024, *range(1025, 4000), 9856, *range((1 << 20) - 2, (1 << 20) + 3), *range(1 << 20, 1 << 22, 1 << 17)]
    rows = [(k, f"https://a.example.com/en/{k}{'/' if k % 2 else ''}?x", None if n is None else "x" * n) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["path_forms"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(entry.oracle_sql()["path_forms"])
    assert got.columns == [c[0] for c in wanted.description]
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_path_forms_of_odd_addresses_as_in_sql(spark, tmp_path):
    import __spark_entry__ as entry

    ends = ["", "/", "\\", "\n", "/\n", "\\\n", "\r", "/\r\n", "/\u0085", "/\u2028", "?a\rb", "#a\u2028b", "?a\nb", "?a\n", "?#", "\\/", "/.example./"]
    urls = [None, *ends, *(start + end for start in ("https://a.example.com/x", "a\\b", "x\ny", "x?y\n") for end in ends)]
    rows = [(k, url, "<html>") for k, url in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["path_forms"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(entry.oracle_sql()["path_forms"]).fetchall())
