import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospecta.llm import mixing, piece_bpe, simhash, weak_quality
from prospecta.llm.queries import model_path

SF = "/root/testdata/sf0.001"


def first_of_groups(texts):
    """The least id of each group linked by five-word shingles: Jaccard 0.8 or more, or fingerprints within two bits; all pairs are looked at."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    prints = {i: simhash.simhash(t.encode(), 5) for i, t in texts.items()}
    first = {}
    for i in sorted(texts):
        todo, first[i] = [i] if i not in first else [], first.get(i, i)
        while todo:
            a = todo.pop()
            for b in texts:
                common = len(sets[a] & sets[b])
                near = common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)
                if b not in first and (near or bin(prints[a] ^ prints[b]).count("1") <= 2):
                    first[b] = i
                    todo.append(b)
    return set(first.values())


def test_pipeline_against_steps(spark):
    """Each stage's rows are what its operator decides on the rows that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality classifier":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in weak_quality.classify(before).where("keep").collect()}
        if name == "exact dedup":
            text = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
            assert {r.doc_id for r in docs.collect()} == {r.m for r in before.groupBy(text).agg(F.min("doc_id").alias("m")).collect()}
        if name == "simhash near dedup":
            assert {r.doc_id for r in docs.collect()} == first_of_groups({r.doc_id: r.text or "" for r in before.collect()})
        if name == "mix sources":
            wanted = {r.doc_id: r.copies for r in mixing.plan(before).where("copies > 0").collect()}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == wanted
        if name == "sentencepiece":
            codec = piece_bpe.codec(model_path())
            counts = {r.doc_id: len(codec.library.encode(r.text)) + 1 for r in before.collect()}
            assert {r.doc_id: r.n_tokens for r in docs.collect()} == counts and docs.count() == before.count()
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("stage", [corpus_pipeline.keep_quality, corpus_pipeline.drop_near_copies, corpus_pipeline.tokenize])
def test_workers_get_texts_in_bounded_batches(spark, stage):
    """30 MB of long texts in one partition reach a worker in parts, not as one batch of all rows."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        found = [r["size"] for r in long.mapInArrow(sizes, "size long").collect()]
    finally:
        spark.conf.set(setting, before)
    assert sum(found) > 3e7 and max(found) < 1.1 * corpus_pipeline.BATCH
