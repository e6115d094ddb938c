"""SetSketch near-dedup against all pairs, with large groups of unlike rows, and the registers' estimates."""

import random

import numpy as np
import pytest

from prospecta.llm import setsketch
from prospecta.llm.common import ROW, number_rows

from .helpers import DOCS, empty, frame, odd_texts


def shingle_set(text, words=5):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def shape(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def test_odd_texts(spark):
    texts = [*odd_texts(), "One two", "one TWO", "one two three four five", "one two three four five six"]
    assert shape(setsketch.cluster(number_rows(frame(spark, texts)))) == brute(texts)


@pytest.mark.parametrize("share", [0, 50, 80, 85])
def test_groups_of_unlike_rows(spark, share):
    """300 rows with so much common text in a hundred, half of them in pairs of near copies: no link is lost."""
    rng = random.Random(share)
    common, texts = prose(rng, 4 * share), []
    for _ in range(150):
        one = common + prose(rng, 400 - 4 * share)
        texts += [" ".join(one), " ".join(edited(rng, one, rng.choice([1, 3, 5, 6, 7])))]
    want = brute(texts)
    assert shape(setsketch.cluster(number_rows(frame(spark, texts)), block=64)) == want
    assert sum(not r[3] for r in want) > 100


def test_star_of_near_copies(spark):
    """Copies that are alike to their origin only, by chains of some length."""
    rng = random.Random(3)
    base = prose(rng, 300)
    texts = [" ".join(edited(rng, base, 5)) for _ in range(120)] + [" ".join(base)]
    walk = prose(rng, 300)
    for _ in range(60):
        walk = edited(rng, walk, 4)
        texts.append(" ".join(walk))
    rng.shuffle(texts)
    assert shape(setsketch.cluster(number_rows(frame(spark, texts)), block=50)) == brute(texts)


def test_copies_nulls_and_repeated_ids(spark):
    text, other = " ".join(prose(random.Random(1), 50)), " ".join(prose(random.Random(2), 50))
    rows = [(None, text), (None, text), (7, text), (3, text + " tail"), (7, other), (None, other + " x y"), (None, "alone and no id here now"), (5, None), (None, ""), (9, "\t")]
    docs = number_rows(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS n", "2 AS root", "3 AS kept", "4 AS registers", "5 AS bucket"))
    got = sorted((tuple(r) for r in setsketch.cluster(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    want = [(None, 3, False), (None, 3, False), (7, 3, False), (3, 3, True), (7, 7, True), (None, 7, False), (None, None, True), (5, 5, True), (None, None, True), (9, 9, True)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert setsketch.cluster(number_rows(empty(spark))).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    errors = []
    for overlap in [0, 300, 600, 850, 950] * 8:
        whole = rng.integers(0, 2**63, 2000 - overlap, dtype=np.uint64)
        a, b = whole[:1000], whole[1000 - overlap :]
        x, y = setsketch.sketch(a), setsketch.sketch(b)
        assert np.array_equal(setsketch.merge(x, y), setsketch.sketch(whole))
        up, down = np.array([(x > y).sum()], float), np.array([(x < y).sum()], float)
        j = setsketch.estimate(np.array([1000.0]), np.array([1000.0]), up, down, len(x) - up - down)[0]
        errors.append(j - overlap / (2000 - overlap))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.035
    sizes = np.array([len(set(rng.integers(0, 50, 40).tolist()))], float)
    assert setsketch.estimate(sizes, sizes, np.zeros(1), np.zeros(1), np.array([240.0]))[0] > 0.999


def test_registers_of_sets_of_other_sizes():
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    got = [setsketch.sketch(whole), setsketch.sketch(whole[:1500])]
    up, down = (got[0] > got[1]).sum(), (got[0] < got[1]).sum()
    assert down == 0  # a subset's registers are never greater
    j = setsketch.estimate(np.array([3000.0]), np.array([1500.0]), np.array([float(up)]), np.array([0.0]), np.array([240.0 - up]))[0]
    assert abs(j - 0.5) < 0.08


def test_row_numbers_come_along(spark):
    docs = number_rows(frame(spark, ["a b c d e f", "a b c d e f", "x"]))
    assert {r[ROW] for r in setsketch.cluster(docs).collect()} == {r[ROW] for r in docs.collect()}


@pytest.mark.parametrize("share", [0, 50, 80, 85])
def test_pipeline_stage_loses_no_link(spark, share):
    """The near dedup of the pipeline on groups of 300 unlike rows: 0.8 and five words, against all pairs."""
    from prospecta.llm import simhash

    rng = random.Random(100 + share)
    common, texts = prose(rng, 4 * share), []
    for _ in range(150):
        one = common + prose(rng, 400 - 4 * share)
        texts += [" ".join(one), " ".join(edited(rng, one, rng.choice([1, 4, 6, 8, 40])))]
    want = [i for i, _, _, kept in brute(texts, 80) if kept]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(frame(spark, texts)).collect()) == want and len(want) < 230
