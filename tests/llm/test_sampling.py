import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospecta.llm import mixing, sketches

from .helpers import empty, frame, odd_texts


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if most * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {"a": 0, "b": 5, None: 50}, {"é": 3, "z": 100, "Z": 7, "a": 1, "b": 2, None: 4}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_mix(spark):
    texts = [" ".join(["w"] * (i % 90 + 1)) for i in range(600)] + odd_texts()
    docs = frame(spark, texts, ("a", "b", "c", "d", None))
    rows = mixing.plan(docs).collect()
    sizes, taken, target = {}, {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) if texts[r.doc_id] != "b\x00c" else True
        assert r.taken in (r.size * k for k in range(4))
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert {r.source_size for r in rows} == set(sizes.values())
    assert target == pytest.approx(water_fill(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + 2 * max(r.size for r in rows if source[r.doc_id] == s)
    assert sorted(mixing.plan(docs).collect()) == sorted(rows)


def test_sample_emits_copies(spark):
    docs = frame(spark, [f"w {i}" for i in range(50)]).withColumn("target", F.lit(1)).withColumn("size", F.lit("x"))
    drawn = mixing.sample(docs)
    assert drawn.columns == docs.columns
    wanted = {r.doc_id: r.taken // r.size for r in mixing.plan(docs.drop("size")).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()} == wanted
    assert mixing.plan(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_estimates():
    rng = np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 10**6, 6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    data = [t.encode() for t in (a, b, a, "", "x y")]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    one, two, same, none, short = sketches.sketch_batch(np.frombuffer(b"".join(data), np.uint8), offsets)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert sketches.resemblance(one, two) == pytest.approx(true, abs=0.13)
    assert sketches.containment(one, two) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(a)), abs=0.2)
    assert sketches.distinct_count(one) == pytest.approx(len(shingles(a)), rel=0.3)
    assert one.tolist() == same.tolist() and len(none) == 0 and len(short) == 1
    assert sketches.resemblance(none, none) == 1.0 and sketches.resemblance(none, short) == 0.0
    assert sketches.from_hex(sketches.to_hex(one)).tolist() == one.tolist()


def test_merge_of_parts(spark):
    docs = frame(spark, [" ".join(f"{i}.{k}" for k in range(300)) for i in range(6)])
    parts = sketches.fingerprints(docs).withColumn("doc_id", F.lit(1))
    merged = sketches.from_hex(sketches.merged_fingerprints(parts).first().fingerprint)
    every = np.concatenate([sketches.from_hex(r.fingerprint) for r in parts.collect()])
    assert merged.tolist() == np.unique(every)[: sketches.K].tolist()


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_edited_texts(spark, parts):
    texts = odd_texts()
    rows = {r.doc_id: r for r in sketches.compare_with_edited(frame(spark, texts), parts=parts).collect()}
    n = len(texts)
    assert len(rows) == n
    for i in range(n):
        own, following = texts[i] or "", texts[(i - 1) % n] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        if own == edited:
            assert rows[i].fingerprint == rows[i].edited_fingerprint and rows[i].near_edited == 1.0
        after = rows[(i - 1) % n].fingerprint
        assert rows[i].near_next == sketches.resemblance(sketches.from_hex(rows[i].fingerprint), sketches.from_hex(after))
    assert sketches.compare_with_edited(empty(spark)).count() == 0
    assert len(sketches.compare_with_edited(frame(spark, ["only one row of text here"])).collect()) == 1
