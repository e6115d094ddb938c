import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospecta.llm import chat_format, piece_bpe, ppm, weak_quality
from prospecta.llm.queries import model_path

from .helpers import empty, frame, odd_texts

SF = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_ppm_tables_follow_the_trie(spark):
    texts = [t if t is None or len(t) < 5000 else t[:4000] for t in odd_texts()]
    got = {r.doc_id: r for r in ppm.score(frame(spark, texts), ppm.fold(F.col("doc_id")), 3, block_bytes=5000).collect()}
    trie, counts = ppm.Trie(3), collections.Counter()
    for i, t in enumerate(texts):
        if not held(i):
            data = (t or "").encode()
            counts.update([*data.lower().split(), None])
            for c, s in trie.walk(data):
                trie.learn(c, s)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        whole = sum(trie.cost(c, s) for c, s in trie.walk((t or "").encode()))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(whole)


def test_ppm_probabilities_sum_to_one():
    trie = ppm.Trie(2)
    for c, s in trie.walk(b"abracadabra"):
        trie.learn(c, s)
    for context in [(97, 98), (120, 97), (120, 121)]:
        assert sum(10 ** trie.cost(context, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_ppm_without_training_and_adaptive(spark):
    docs = frame(spark, ["abc", None])
    rows = ppm.score(docs, F.lit(True), 2).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({0: -4 * math.log10(257), 1: -math.log10(257)})
    again = {r.doc_id: r.score for r in ppm.adaptive(frame(spark, ["la la " * 50, None])).collect()}
    assert again[0] > -300 * math.log10(257) / 2 and again[1] == pytest.approx(-math.log10(257))
    assert ppm.score(empty(spark), ppm.fold(F.col("doc_id"))).count() == 0


def test_pieces_match_the_library(spark):
    codec = piece_bpe.codec(model_path())
    rng = random.Random(1)
    letters = " ▁ab\n\t\x00é中😀　ﬁ  th e​_-..1x"
    texts = odd_texts() + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    got = {r.doc_id: r for r in piece_bpe.coded(frame(spark, texts), model_path()).collect()}
    for i, t in enumerate(texts):
        ids = codec.library.encode(t or "", add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == codec.library.decode(ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest())
    assert piece_bpe.coded(empty(spark), model_path()).count() == 0
    assert piece_bpe.encode(frame(spark, ["a b", None]), model_path()).where("doc_id = 1").first().ids == [2]


def test_both_agendas_agree():
    codec = piece_bpe.codec(model_path())
    rng = random.Random(8)
    chunks = ["▁" + "".join(rng.choice("theanour") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for chunk, ids in zip(chunks, codec.merge_many(chunks)):
        assert [codec.pieces[i] for i in ids] == codec.merged_by_heap(chunk)


def test_estimated_accuracies():
    """Labellers with known accuracies and coverage: posteriors separate the classes."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.85, 0.8, 0.9])
    right = rng.random((20_000, 10)) < accuracy
    v = np.where(rng.random((20_000, 10)) < 0.7, np.where(right, truth[:, None], ~truth[:, None]).astype(int), -1)
    patterns, where, counts = np.unique(weak_quality.pack(v), return_inverse=True, return_counts=True)
    prior, found, post = weak_quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.02 and np.abs(found - accuracy).max() < 0.02
    assert ((post[where] >= 0.5) == truth).mean() > 0.97


def test_quality_on_labels(spark):
    """Labels serve only to measure: most rejected documents are bad ones, no good one is lost."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_quality.classify(docs).join(labels, "doc_id").collect()
    assert sum(r.keep != (r.quality == 1) for r in rows) <= 0.03 * len(rows)
    assert all(r.keep for r in rows if r.quality == 1)


def test_quality_of_odd_texts(spark):
    docs = frame(spark, odd_texts() + ["WORD!! " * 50, "a### b$$$ c%%% d*** e&&& " * 9]).withColumnRenamed("lang", "keep")
    kept = weak_quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert weak_quality.classify(empty(spark)).count() == 0 and weak_quality.keep_good(empty(spark)).count() == 0


def test_sample_is_bounded_where_rows_share_id_and_text(spark):
    """Rows without ids, of one length or of one text, enter up to the bound, not all or none."""
    rows = [(None, "abc")] * 4000 + [(None, "") for _ in range(3000)] + [(None, f"{i:03d}") for i in range(1000)] + [(i, f"text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    source = docs.selectExpr("doc_id", "cast(text AS binary) AS text")
    assert weak_quality.sampled(source, len(rows), 500).count() <= 500
    assert weak_quality.sampled(source, 400, 500).count() == 500
    assert "TakeOrderedAndProject" in weak_quality.sampled(source, len(rows), 500)._jdf.queryExecution().toString()
    spread = docs.where("text rlike '^[0-9]+$'").selectExpr("doc_id", "cast(text AS binary) AS text")
    assert weak_quality.sampled(spread, 1000, 100).count() == 100
    first, again = (weak_quality.train(docs.repartition(n), 200).weights for n in (3, 7))
    assert (first == again).all()


def test_markers():
    for line, role in [("User: hi", 1), ("### Assistant:", 2), ("<|system|>", 0), ("[bot] ok", 2), ("**Q:** why", 1), ("plain text: no", 3), ("a walk", 3), ("A: yes", 2)]:
        assert chat_format.read_line(line)[0] == role


@pytest.mark.parametrize("block", [2, 256])
def test_roles_recovered(spark, monkeypatch, block):
    """Held-out conversations too, in whole blocks and cut into many."""
    monkeypatch.setattr(chat_format, "BLOCK", block)
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    truth = {(r.conv_id, r.turn): (r.role, r.text) for r in conversations.collect()}
    rows = chat_format.format_conversations(conversations).collect()
    assert sum(truth[r.conv_id, r.part][0] == r.role for r in rows) >= 0.98 * len(rows)
    for r in rows:
        if r.turn == 1 and r.role == truth[r.conv_id, r.part][0]:
            assert r.canonical.startswith(f"<|{r.role}|>\n") and r.canonical.endswith("\n<|end|>")


def test_blocks_find_the_whole_best_path():
    """Joined blocks score as one Viterbi run."""
    rng = np.random.default_rng(0)
    model = chat_format.Model.from_counts(rng.random(6), rng.random((6, 6)), rng.random((6, chat_format.OBSERVATIONS)))
    seen = rng.integers(0, chat_format.OBSERVATIONS, 40)
    whole = model.trace(seen, -1, -1)
    score = lambda s: model.start[s[0]] + model.emit[s[0], seen[0]] + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(s, s[1:], seen[1:]))
    first = (model.start + model.emit[:, seen[0]])[:, None] + model.block(seen[1:25])
    second = model.block(seen[25:])
    assert (first.max(axis=0)[:, None] + second).max() == pytest.approx(score(whole))


def test_odd_transcripts(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "hello\n\nUser: x"), (None, 0, "user", "User: who?"), (3, 0, "user", "line\n" * 3000), (3, 0, "user", "line\n" * 3000)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat_format.format_conversations(conversations).collect()
    assert {r.conv_id for r in out} >= {2, None, 3}
    assert chat_format.format_conversations(conversations.limit(0)).count() == 0


def test_rates_against_brute_force():
    """Posteriors are Bayes' over both classes, and no parameters nearby explain the votes better."""
    rng = np.random.default_rng(8)
    for _ in range(6):
        patterns = weak_quality.pack(rng.integers(-1, 2, (12, len(weak_quality.LABELLERS))))
        patterns = np.unique(patterns)
        counts = rng.integers(1, 200, len(patterns)).astype(float)
        start, weight = (0.1, 0.6), 10.0
        prior, rates, post = weak_quality.error_rates(patterns, counts, start=start, weight=weight, rounds=20_000)
        votes = weak_quality.unpack(patterns)

        def chances(p, r, votes=votes):
            out = []
            for v in votes:
                one = [1 - p, p]
                for k, x in enumerate(v):
                    for c in (0, 1):
                        one[c] *= 1 if x < 0 else r[c][k] if x == 0 else 1 - r[c][k]
                out.append(one)
            return np.array(out)

        def gain(p, r, counts=counts, chances=chances):
            belief = sum(weight * (s * np.log(r[c]) + (1 - s) * np.log(1 - r[c])).sum() for c, s in ((1, start[0]), (0, start[1])))
            return counts @ np.log(chances(p, r).sum(axis=1)) + belief + 8 * np.log(p) + 2 * np.log(1 - p)

        both = chances(prior, rates)
        assert np.allclose(both[:, 1] / both.sum(axis=1), post, atol=1e-6)
        best = gain(prior, rates)
        for _ in range(200):
            other = np.clip(rates + rng.normal(0, 0.01, rates.shape), 1e-6, 1 - 1e-6)
            assert gain(min(0.98, max(0.02, prior + rng.normal(0, 0.01))), other) <= best + 1e-6


def test_equal_texts_get_equal_scores():
    """However texts are batched and whatever stands before them."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(3, 400))) for _ in range(3)]
    model = weak_quality.Model(0.8, np.full(10, 0.9), {}, np.random.default_rng(1).normal(0, 1, weak_quality.BUCKETS + 1))
    found = {t: set() for t in texts}
    for _ in range(20):
        batch = [rng.choice(texts) for _ in range(rng.randint(1, 60))]
        for t, s in zip(batch, model.judge(pa.array([x.encode() for x in batch]))[0].tolist()):
            found[t].add(s)
    assert all(len(s) == 1 for s in found.values())
