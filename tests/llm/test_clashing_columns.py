"""Columns of the caller keep their names and values, whatever the operators call their own."""

import pytest
from pyspark.sql import functions as F

from prospecta.llm import exact_dedup, fm_index, mixing, simhash, sketches, suffix_bwt, weak_quality

NAMES = ["_gone", "before", "_mix", "mix", "own", "_size", "size", "source_size", "target", "part", "class", "none", "key", "row", "file", "_file", "_row", "_spans", "_id", "digest", "fp", "copies", "at", "to", "new"]
TEXTS = ["a b c d", "a  b c d", "other text", None, " ".join(f"w{i}" for i in range(60))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    return rows.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in NAMES})


@pytest.mark.parametrize("f", [fm_index.deduplicate, suffix_bwt.deduplicate, weak_quality.keep_good, exact_dedup.deduplicate, simhash.deduplicate, mixing.sample])
def test_columns_come_through(docs, f):
    out = f(docs).collect()
    assert out
    for r in out:
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
        assert r.text == TEXTS[r.doc_id]


def test_many_rows_of_one_id(spark):
    """Rows without id fill many parts; every row comes out with the text that follows by hash."""
    texts = [f"text number {i} of many rows without any id" for i in range(60)]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    placed = sketches.with_next(rows, 8).where("not guest").groupBy("part").count().collect()
    assert len(placed) > 4 and sum(r["count"] for r in placed) == 60
    assert [r.edited_sha256 for r in sketches.compare_with_edited(rows, parts=8).orderBy("edited_sha256").collect()] == [r.edited_sha256 for r in sketches.compare_with_edited(rows, parts=1).orderBy("edited_sha256").collect()]
