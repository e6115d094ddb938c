"""Null ids, repeated rows, null sources and extra columns: one row out for each row in, nothing crashes."""

import pytest
from pyspark.sql import functions as F

from prospecta.llm import chat_format, exact_dedup, fm_index, mixing, piece_bpe, ppm, simhash, sketches, suffix_bwt, weak_quality
from prospecta.llm.queries import model_path

LONG = " ".join(f"w{i % 37}" for i in range(90))
ROWS = [(None, LONG, None), (3, None, "a"), (7, LONG, "a"), (7, LONG, "a"), (9, "", "b"), (2**40, "short text", ""), (-4, LONG + " tail", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    names = ["anchor", "digest", "fp", "size", "spans", "n_words", "keep", "block", "part", "_kept_"]
    return rows.withColumns({n: F.lit("x") for n in names})


QUERIES = {
    "words": lambda d: fm_index.digests(d, 35),
    "bytes": lambda d: suffix_bwt.digests(d, 200),
    "pieces": lambda d: piece_bpe.coded(d, model_path()),
    "quality": weak_quality.classify,
    "ppm": lambda d: ppm.score(d, ppm.fold(F.col("doc_id")), 3),
    "simhash": simhash.cluster,
    "mixing": mixing.plan,
    "sketches": lambda d: sketches.compare_with_edited(d, parts=3),
    "prints": sketches.fingerprints,
}


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_comes_out(docs, name):
    out = QUERIES[name](docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


def test_exact_rows(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(spark, path).collect()}
    assert out == {(None, 7, 3, False), (7, 7, 3, True), (3, 3, 2, True), (9, 3, 2, False), (2**40, 2**40, 1, True), (-4, -4, 1, True)}


@pytest.mark.parametrize("f", [fm_index.deduplicate, weak_quality.keep_good, exact_dedup.deduplicate, simhash.deduplicate, mixing.sample])
def test_filters_keep_columns(docs, f):
    out = f(docs)
    assert set(docs.columns) - {"n_words", "spans"} <= set(out.columns) and out.count() >= 1


def test_transcripts(spark):
    rows = spark.createDataFrame([(None, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (2, 5, "robot", None, 1)], "conv_id long, turn int, role string, text string, block int")
    assert {r.conv_id for r in chat_format.format_conversations(rows).collect()} == {None, 1}
