"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import random

import pytest

import corpus_pipeline
from cairn.llm import cube, hnsw, huffman, licenses, odd_sketch, packing, prefix_counts, quality, secret_net, topk
from cairn.llm.tokens import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
BYTES = tokenizer_path("byte_bpe_50k.json")
r = random.Random(4)
LONG = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(120_000))
PROSE = "The ther ing and that of for with one. Some other words stand here, and they go on for a while."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, size long, score double, copies long, turn int, words string, block int, spans string"
ROWS = [(1, None, "en", "a"), (2, "", "en", None), (None, PROSE + " x", None, "b"), (None, None, None, None), (3, " \n\t ", "en", "a"), (4, LONG, "en", "b"), (5, PROSE, "en", "c"), (6, PROSE, "en", "c"), (7, PROSE + " more", "en", "c"), (7, PROSE + " more", "en", "c"), (8, "one two", "en", "\U0001f642"), (9, "password=hunter2hunter2 and \U0001f642中文 cc by", "en", "z")]


def table(spark, rows):
    return spark.createDataFrame([(*x, len(x[1]) if x[1] else None, None, 5, 6, 0.5, 1, 2, "w", 3, "s") for x in rows], SCHEMA).repartition(3)


OPERATORS = {
    "quality": quality.score,
    "mix": cube.mix,
    "pack": lambda d: packing.pack(d, WORDS),
    "secrets": secret_net.scan,
    "counts": lambda d: prefix_counts.token_counts(d, BYTES),
    "licenses": licenses.scan,
    "near": odd_sketch.near_duplicates,
}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, name):
    got = OPERATORS[name](docs).collect()
    if name == "pack":
        assert sorted({(x["doc_id"] is None, x["doc_id"]) for x in got}) == sorted({(x[0] is None, x[0]) for x in ROWS})
        assert max(x["length"] for x in got) <= 4096
    else:
        assert len(got) == len(ROWS)
    by = {x["doc_id"]: x for x in got}
    if name == "quality":
        assert by[1]["kept"] is False and by[3]["score"] == 0
    if name == "mix":
        assert by[1]["size"] == 0 and all(x["taken"] <= 2 * x["size"] for x in got)
    if name == "secrets":
        assert by[9]["n_assign"] == 1 and by[1]["spans"] == ""
    if name == "licenses":
        assert by[9]["base_labels"] == "cc-by" and by[1]["n_words"] == 0
    if name == "near":
        assert by[5]["kept"] and by[6]["component_id"] == 5 and by[1]["n_shingles"] == 0
        assert by[None]["component_id"] is None and by[8]["n_shingles"] == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_files_of_ids(spark, docs, tmp_path):
    for k, d in enumerate((docs, table(spark, []))):
        path = f"file://{tmp_path}/{k}"
        huffman.write(d, path, WORDS)
        got = huffman.read(spark, path).orderBy("start").collect()
        assert len(got) == d.count()
        assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


VECTORS = [(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, []), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (9, [float("inf"), 1.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, True, 3) for x in rows], "vec_id long, embedding array<double>, label int, n_links long, kept boolean, rank int")


def test_vectors(spark):
    got = {x["vec_id"]: x for x in hnsw.near_vectors(vectors(spark, VECTORS)).collect()}
    assert (got[1]["n_links"], got[1]["component_id"], got[2]["component_id"], got[100]["component_id"]) == (3, 1, 1, 1)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9))
    assert got[100]["n_links"] == 3  # each of the two rows is a vector of its own
    assert got[None]["component_id"] is None
    top = topk.top_k(vectors(spark, VECTORS)).orderBy("rank").collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in top if x["rank"] <= 2} == {(100, 1, 1, 1 << 20), (100, 2, 2, 1024 * 1013)}
    assert hnsw.near_vectors(vectors(spark, [])).count() == 0 and topk.top_k(vectors(spark, [])).count() == 0


def test_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, now, "")
        if name != "packing":
            assert got.columns == docs.columns
            now = got.cache()
        else:
            assert got.count() > 0
        empty = stage(spark, table(spark, []), "")
        assert empty.count() == 0
