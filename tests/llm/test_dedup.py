import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prospecta.llm import exact_dedup, simhash

from .helpers import DOCS, empty, frame, odd_texts


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(normal(t), []).append(i)
    return {i: (g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def as_map(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_decisions(spark, tmp_path, weak):
    """Also with a digest that collides: full bytes decide."""
    texts = odd_texts() + ["one  two three", "one two\tthree"]
    path = str(tmp_path / "documents.parquet")
    frame(spark, texts).write.parquet(path)
    digest = (lambda t: F.unhex(F.when(F.length(t) % 2 == 0, "00").otherwise("01"))) if weak else exact_dedup.sha256_digest
    assert as_map(exact_dedup.decisions(spark, path, digest)) == expected(texts)


def test_state_goes_on(spark, tmp_path):
    """A second run over new files of the same folder updates the state that is kept."""
    path = str(tmp_path / "documents.parquet")
    rows = lambda ids: spark.createDataFrame([(i, "t%d" % (i % 3), "en", "s", 2) for i in ids], DOCS)
    rows([5, 6, 7]).write.parquet(path)
    point = "file://" + str(tmp_path / "state")
    stream = lambda: exact_dedup.read_stream(spark, path, rows([1]).schema)
    first = {r.keep_id: r.group_size for r in exact_dedup.stream_state(stream(), checkpoint=point).collect()}
    assert first == {5: 1, 6: 1, 7: 1}
    rows([2, 8]).write.mode("append").parquet(path)
    again = {r.keep_id: r.group_size for r in exact_dedup.stream_state(stream(), checkpoint=point).collect()}
    assert again == {2: 3, 6: 1, 7: 1}


def test_exact_filter_keeps_columns(spark):
    docs = frame(spark, ["a b", "a  b", None, "", "c"]).withColumn("keep_id", F.lit("own")).withColumn("digest", F.lit(1))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("shard", [60_000, 5])
def test_simhash_clusters(spark, shard):
    """One shard, and a deep upper tree with queries over the borders."""
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(3, 80))) for _ in range(25)]
    texts = odd_texts() + base + [t + " " + rng.choice("ab") for t in base for _ in range(3)]
    texts = [t if t is None or len(t) < 20_000 else t[:9_000] for t in texts]
    got = simhash.cluster(frame(spark, texts), shard=shard).collect()
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert prints == {i: slow_simhash(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in got} == slow_components(prints)


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_forest_matches_all_pairs():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = np.concatenate([prints, *[prints ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(6)]])
    prints = np.unique(near)
    rng.shuffle(prints)
    root = slow_components({i: int(p) for i, p in enumerate(prints)})
    assert simhash.shard_forest(prints, np.ones(len(prints), bool), 2, leaf=8).tolist() == [root[i] for i in range(len(prints))]


def test_simhash_filter(spark):
    docs = frame(spark, ["a b c d", "a b c d", None, "", "other words here now"])
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 2, 4]
    assert simhash.cluster(empty(spark)).count() == 0
