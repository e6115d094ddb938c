import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospecta.llm import fm_index, repeats, suffix_bwt
from prospecta.llm.common import BATCH, ROW, Rolling, byte_units, gram_names, number_rows, word_units

from .helpers import covered, empty, frame, odd_texts


def packed(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def random_texts(rng):
    words = [b"a", b"bb", b"c", b"dd", b"e", b"f"][: rng.choice([2, 3, 6])]
    return [b" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]


def starts(units, width):
    from collections import Counter

    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    return [i + width <= len(u) and seen[tuple(u[i : i + width])] > 1 for u in units for i in range(len(u))]


@pytest.mark.parametrize("seed", range(40))
def test_indexes_against_counting(seed):
    rng = random.Random(seed)
    texts = random_texts(rng)
    raw, offsets = packed(texts)
    one = np.ones(len(texts), int)
    for width in (1, 3, 4, 5, 7, 8, 12):
        assert fm_index.repeated_windows(raw, offsets, one, width)[0].tolist() == starts([t.split() for t in texts], width)
        assert suffix_bwt.repeated_windows(raw, offsets, one, width)[0].tolist() == starts(texts, width)


def test_collection_bwt_against_sorting(tmp_path):
    """The columns after all rounds are those of the sorted list of all suffixes."""
    rng = random.Random(3)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    symbols = np.array(sum(strings, []), np.uint32)
    ends = np.cumsum([len(s) for s in strings])
    previous = np.arange(len(symbols)) - 1
    previous[ends - [len(s) for s in strings]] = -1
    columns = suffix_bwt.collection_bwt(symbols, ends - 1, previous, 99, str(tmp_path))
    place, bwt, lcp = columns.read("place"), columns.read("bwt"), columns.read("lcp")
    suffix = lambda p: symbols[p : ends[np.searchsorted(ends, p, side="right")]].tolist()
    listed = [suffix(p) for p in place[len(strings) :]]
    assert listed == sorted(listed) and len(listed) == len(symbols)
    assert bwt[len(strings) :].tolist() == [0 if previous[p] < 0 else symbols[previous[p]] for p in place[len(strings) :]]
    for i in range(1, len(listed)):
        a, b = listed[i - 1], listed[i]
        assert lcp[len(strings) + i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletTree(symbols, 37)
    at, asked = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert tree.rank(asked, at).tolist() == [(symbols[:i] == s).sum() for i, s in zip(at, asked)]


@pytest.mark.parametrize("units", ["words", "bytes"])
def test_every_window_is_in_one_segment(units):
    rng = random.Random(9)
    for _ in range(30):
        texts, width = random_texts(rng), rng.choice([2, 5, 9])
        s = repeats.segments_of(*packed(texts), units, width, repeats.default_gram(width))
        got = sorted((r, p + k) for r, p, w in zip(s["row"], s["pos"], s["windows"]) for k in range(w))
        assert got == [(r, i) for r, t in enumerate(texts) for i in range(len(t.split() if units == "words" else t) - width + 1)]


def check_words(spark, docs, texts, width, **options):
    got = {r.doc_id: r for r in fm_index.digests(docs, width, **options).collect()}
    words = [(t or "").encode().split() for t in texts]
    for i, (w, m) in enumerate(zip(words, covered(words, width))):
        kept = b" ".join(x for x, y in zip(w, m) if not y)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(m), hashlib.sha256(kept).hexdigest())


def check_bytes(spark, docs, texts, width, **options):
    got = {r.doc_id: r for r in suffix_bwt.digests(docs, width, **options).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (b, m) in enumerate(zip(data, covered(data, width))):
        kept = bytes(x for x, y in zip(b, m) if not y)
        spans = len([x for x in bytes(m).split(b"\0") if x])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(m), spans, hashlib.sha256(kept).hexdigest())


def test_word_windows_of_odd_texts(spark):
    texts = odd_texts()
    check_words(spark, frame(spark, texts), texts, 35)


def test_byte_windows_of_odd_texts(spark):
    texts = [t if t is None or len(t) < 50_000 else t[:20_000] for t in odd_texts()]
    check_bytes(spark, frame(spark, texts), texts, 200)


def test_spread_anchors(spark):
    """With tiny shards every anchor is too frequent; its windows are counted apart."""
    texts = [t for t in odd_texts() if t is None or len(t) < 5000]
    check_words(spark, frame(spark, texts), texts, 20, shard_bytes=100)
    check_bytes(spark, frame(spark, texts), texts, 60, shard_bytes=100)


def test_empty_and_other_columns(spark):
    assert fm_index.digests(empty(spark)).count() == 0
    assert suffix_bwt.digests(empty(spark)).count() == 0
    docs = frame(spark, ["a b c d e f g h", "x a b c d e f g", None]).withColumnRenamed("lang", "n_words")
    rows = {r.doc_id: r for r in fm_index.deduplicate(docs, 5).collect()}
    assert rows[0].kept_text == "h" and rows[1].kept_text == "x" and rows[2].n_removed == 0


@pytest.mark.parametrize("seed", range(12))
def test_indexes_carry_copies(seed):
    """A text of weight two repeats all of its windows, as if it stood there twice."""
    rng = random.Random(100 + seed)
    texts = random_texts(rng)
    raw, offsets = packed(texts)
    copies = np.array([rng.randint(1, 2) for _ in texts])
    for width in (3, 8, 12):
        for index, units in ((fm_index, [t.split() for t in texts]), (suffix_bwt, texts)):
            expected = starts(units + [u for u, c in zip(units, copies) if c > 1], width)[: sum(map(len, units))]
            assert index.repeated_windows(raw, offsets, copies, width)[0].tolist() == expected


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_streamed_columns_in_any_blocks(tmp_path, block):
    rng = np.random.default_rng(block)
    symbols = rng.integers(1, 4, 300).astype(np.uint32)
    previous = np.arange(300) - 1
    previous[::20] = -1
    parts = suffix_bwt.collection_bwt(symbols, np.arange(19, 300, 20), previous, 9, str(tmp_path), block)
    columns = [parts.read(n) for n in suffix_bwt.Columns.KINDS]
    again = suffix_bwt.collection_bwt(symbols, np.arange(19, 300, 20), previous, 9, str(tmp_path), 10_000)
    assert all(np.array_equal(a, again.read(n)) for a, n in zip(columns, suffix_bwt.Columns.KINDS))


def test_strings_whose_polynomials_agree():
    """Thue-Morse strings and their complements, which polynomial hashes modulo a power of two can't tell apart."""
    ones = "".join(str(bin(i).count("1") & 1) for i in range(4096))
    texts = [ones.encode(), ones.translate(str.maketrans("01", "10")).encode()]
    raw, offsets = packed(texts)
    one = np.ones(2, int)
    for width in (1024, 2048):
        assert suffix_bwt.repeated_windows(raw, offsets, one, width)[0].tolist() == starts([t.decode() for t in texts], width)
    values, *_ = word_units(raw, offsets)
    assert values[0] != values[1]


def test_runs_of_a_frequent_anchor():
    """Each window of a segment is in one run, and equal windows have equal keys."""
    rng = random.Random(4)
    line = "a line that stands in very many documents of all kinds " * 2
    keys = {}
    for _ in range(40):
        data = ("".join(rng.choice("xyz ") for _ in range(150)) + line + "".join(rng.choice("xyz ") for _ in range(150))).encode()
        s = repeats.segments_of(*packed([data]), "bytes", 120, 24)
        for b0, b1, n, anchor in zip(s["b0"], s["b1"], s["windows"], s["anchor"]):
            piece, seen = data[b0:b1], []
            for at, size, key, part in repeats.runs_of(piece, int(anchor), "bytes", 120, 24, 10):
                seen += range(at, at + size)
                assert part == piece[at : at + size + 119]
                for k in range(at, at + size):
                    assert keys.setdefault(piece[k : k + 120], (int(anchor), key)) == (int(anchor), key)
            assert seen == list(range(n))


def test_rounds_rewrite_keys_and_prefixes_only(tmp_path, monkeypatch):
    """What a round reads and writes again of each row: nine bytes; places and the BWT come once, by a walk over the links."""
    sizes, put = [], suffix_bwt.Columns.merge
    monkeypatch.setattr(suffix_bwt.Columns, "merge", lambda self, *a, **columns: (sizes.append(sum(np.dtype(self.KINDS[c]).itemsize for c in columns)), put(self, *a, **columns)))
    symbols = np.array([1, 2, 1, 2, 2, 1, 1], np.uint32)
    previous = np.array([-1, 0, 1, 2, -1, 4, 5])
    columns = suffix_bwt.collection_bwt(symbols, np.array([3, 6]), previous, 9, str(tmp_path), 3)
    assert sizes and max(sizes) <= 9
    # empty suffixes first, then 1, 1 1, 1 2, 1 2 1 2 ... in order, each with the symbol before it
    assert columns.read("place").tolist() == [0, 0, 6, 5, 2, 0, 3, 4, 1]
    assert columns.read("bwt").tolist() == [2, 1, 1, 2, 2, 0, 1, 0, 1]


def test_names_of_units_whose_hashes_clash():
    units = np.frombuffer(b"abcabcabdabx", np.uint8)
    ok = np.ones(len(units), bool)
    ok[[4, *range(len(units) - 2, len(units))]] = False
    grams = [bytes(units[i : i + 3]) for i in range(len(units))]
    for hashes in (np.zeros(len(units), np.uint64), np.array([hash(g) & 0xFFFF_FFFF for g in grams], np.uint64)):
        names = gram_names(units, hashes, 3, ok)
        assert not names[~ok].any() and names[ok].all()
        at = np.flatnonzero(ok)
        assert all((names[i] == names[j]) == (grams[i] == grams[j]) for i in at for j in at)


@pytest.mark.parametrize("units", ["bytes", "words"])
def test_no_index_is_larger_than_a_shard(spark, units):
    """A passage of all but a few units of a window, in many surroundings: one key for all of its runs, which are indexed in parts."""
    rng = random.Random(12)
    width, limit = (60, 4000) if units == "bytes" else (20, 1500)
    unit = (lambda: rng.choice("uvwxyz")) if units == "bytes" else (lambda: "".join(rng.choice("uvwxyz") for _ in range(5)) + rng.choice([" ", "  "]))
    prose = lambda n: "".join(unit() for _ in range(n))
    passage = prose(width - 1)
    texts = [prose(30) + passage + prose(30) for _ in range(300)]
    texts += [texts[0][:-5] + "end", texts[7], passage]
    index, sizes = (suffix_bwt if units == "bytes" else fm_index).repeated_windows, spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)

    def watched(raw, offsets, copies, width):
        sizes.add(1)
        most.add(len(raw) > limit)
        return index(raw, offsets, copies, width)

    docs = number_rows(frame(spark, texts))
    found = {r[ROW]: r.spans for r in repeats.repeated_spans(docs, units, width, watched, shard_bytes=limit).collect()}
    rows = {r[ROW]: r.doc_id for r in docs.collect()}
    got = {rows[k]: repeats.merged([s.asDict() for s in spans]) for k, spans in found.items()}
    data = [t.split() if units == "words" else t for t in texts]
    for i, (u, m) in enumerate(zip(data, covered(data, width))):
        mask = bytearray(len(u))
        for a, b in got.get(i, []):
            mask[a:b] = b"\1" * (b - a)
        assert mask == m
    assert sizes.value > 1 and not most.value


def test_an_anchor_goes_to_one_or_to_many_shards_as_a_whole(spark):
    """A window in a long and in a short segment of an anchor: bytes of the long ones together are over a shard's, those of as many short ones aren't."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("uvwxyz") for _ in range(n))
    line = prose(20_000)
    raw, offsets = packed([line.encode()])
    grams = Rolling(byte_units(raw, offsets)[0]).grams(12)
    least = line[grams.argmin() : grams.argmin() + 12]
    texts = [prose(60) + least + prose(60) for _ in range(40)]
    texts += [texts[k][60 - k : 120 - k] for k in (0, 9, 18, 27, 36)]
    check_bytes(spark, frame(spark, texts), texts, 60, shard_bytes=3600)


def test_texts_reach_workers_in_bounded_batches(spark):
    """op5 hands 30 MB of texts of one partition to a worker in parts, not as one batch."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        suffix_bwt.digests(frame(spark, ["a", "b"])).count()
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        found = [r["size"] for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"]) for b in batches), "size long").collect()]
    finally:
        spark.conf.set(setting, before)
    assert sum(found) > 3e7 and max(found) < 1.1 * BATCH
