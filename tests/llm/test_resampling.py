"""Importance resampling against a plain Python version, for one and for three orders."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from prospecta.llm import resampling
from prospecta.llm.common import ROW, number_rows

from .helpers import DOCS, empty, frame, odd_texts

BUCKETS = 50


def grams(text, orders):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]
    return [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)], len(words)


def brute(rows, target, orders, least_words, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % BUCKETS
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, orders)[0]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)}
    out = []
    for doc_id, text in rows:
        own, n_words = grams(text, orders)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[2] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit, 1):
        r.append(place if place <= percent * len(fit) // 100 else None)
    return [(*r[:2], *r[3:5], r[5] if len(r) > 5 else None) for r in out]


def shape(rows):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows), key=str)


@pytest.mark.parametrize("orders", [1, 3])
def test_equals_brute_force(spark, orders):
    texts = [*odd_texts(), "Été 1999: l'été!", "A-b_c`d{e}", "日本 語", *[f"w{i % 7} ab cd e{i} " * 9 for i in range(60)]]
    target = ["ab cd ef ef gh", None, "ÉTÉ été 1999", ""]
    docs = number_rows(frame(spark, texts))
    got = resampling.resample(docs, number_rows(frame(spark, target)), orders, BUCKETS, 20, 40).collect()
    assert shape(got) == sorted(brute(list(enumerate(texts)), target, orders, 20, 40), key=str)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + 40 * sum(grams(t, 1)[1] >= 20 for t in texts) // 100))


def test_repeated_and_null_ids(spark):
    texts = [f"{'ab cd ef ' * 10}{i % 3}" for i in range(40)]
    rows = [(None if i % 2 else i // 8, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = number_rows(spark.createDataFrame(rows, DOCS))
    got = resampling.resample(docs, number_rows(frame(spark, ["ab"])), 1, BUCKETS, 20, 100).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got) == list(range(1, 41))
    assert len({r[ROW] for r in got}) == 40
    assert [x[:4] for x in shape(got)] == [x[:4] for x in sorted(brute([r[:2] for r in rows], ["ab"], 1, 20, 100), key=str)]


def test_empty_tables(spark):
    nothing = number_rows(empty(spark))
    assert resampling.resample(nothing, number_rows(frame(spark, ["ab"]))).count() == 0
    got = resampling.resample(number_rows(frame(spark, ["ab " * 30, None])), nothing).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in got) == [(0, 30, None), (1, 0, None)]


def test_extra_columns_with_clashing_names(spark):
    docs = number_rows(frame(spark, ["ab " * 30, "cd"])).selectExpr("*", "1 AS bucket", "2 AS gain", "3 AS rank", "4 AS score", "5 AS at", "6 AS t", "7 AS size")
    assert sorted(r["n_features"] for r in resampling.resample(docs, docs).collect()) == [1, 30]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 AS v")
    got = resampling.ranked(rows, rows["v"].desc(), rows["id"].asc()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
