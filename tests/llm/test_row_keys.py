"""Null and repeated doc_ids are no row keys: what stays is decided by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prospecta.llm import exact_dedup, fm_index, simhash, suffix_bwt
from prospecta.llm.common import number_files

from .helpers import covered

A, B = "one two three four five six", "quite other words stand in here now"
ROWS = [
    (None, A), (5, A), (None, B), (None, "unique and clean"),  # a copy without id, and others without id
    (7, "left one"), (7, "right one"), (8, "left one"),  # one id, two texts
    (9, "said twice"), (9, "said twice"),  # repeated rows
    (None, "never numbered"), (None, "never numbered"), (None, None), (None, ""),
]
STAY = [(5, A), (None, B), (None, "unique and clean"), (7, "left one"), (7, "right one"), (9, "said twice"), (None, "never numbered"), (None, "")]


def weak(t):
    return F.unhex(F.when(F.length(t) % 2 == 0, "00").otherwise("01"))


def check(out):
    assert sorted(str((r.doc_id, r.text or "")) for r in out.collect()) == sorted(map(str, STAY))


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, weak])
def test_exact_dedup_by_row(spark, digest):
    check(exact_dedup.deduplicate(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3), digest))


def test_near_dedup_by_row(spark):
    check(simhash.deduplicate(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)))


@pytest.mark.parametrize("scanned", [False, True])
@pytest.mark.parametrize("ids", [[None], [1], [None, 1, 2]])
def test_repeats_by_row(spark, tmp_path, ids, scanned):
    """Rows of one id, null or not, with texts of their own lose only their own repeats."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(20, 120)) for _ in range(9)] + [prose(k) + " " + passage + " " + prose(30) for k in (3, 40, 7)]
    docs = spark.createDataFrame([(ids[i % len(ids)], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    if scanned:
        docs.write.parquet(str(tmp_path / "documents"))
        docs = number_files(spark.read.parquet(str(tmp_path / "documents")))
        assert docs.select("_row_number").distinct().count() == len(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    words, data = [t.encode().split() for t in texts], [t.encode() for t in texts]
    kept = sorted(sha(b" ".join(x for x, y in zip(w, m) if not y)) for w, m in zip(words, covered(words, 35)))
    assert sorted(r.kept_sha256 for r in fm_index.digests(docs, 35).collect()) == kept
    kept = sorted(sha(bytes(x for x, y in zip(b, m) if not y)) for b, m in zip(data, covered(data, 200)))
    assert sorted(r.kept_sha256 for r in suffix_bwt.digests(docs, 200).collect()) == kept
