"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A text's sketch is the ascending list of its k smallest distinct shingle hashes (five
words; a shorter text is one shingle of all its words; no word: an empty sketch).
Sketches of parts merge into that of the whole by taking the k smallest of both.  Where
a sketch holds fewer than k hashes it is the whole set and all estimates are exact.

Cases: null counts as empty text.  Two empty sketches are alike (1.0), an empty one and
another are not (0.0).  Equal texts have equal fingerprints.  The next document of
``with_next`` goes by doc_id descending, ties by the text's hash, null ids last; after the last
comes the first; a table of one row is its own next.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, binary_parts, distinct, slices, word_units

K = 128
WORDS = 5
_LOWEST = -(2**63)


def sketch_batch(raw: np.ndarray, offsets: np.ndarray, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Sketches of texts given as bytes and offsets."""
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        values, at, _, _ = word_units(raw[offsets[i] : offsets[j]], offsets[i : j + 1])
        rolling = Rolling(values)
        grams = rolling.grams(words)
        short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < words))
        whole = dict(zip(short.tolist(), rolling.spans(at[short], at[short + 1]), strict=True))
        for row in range(j - i):
            own = grams[at[row] : max(at[row], at[row + 1] - words + 1)]
            if len(own) > 4 * k:
                part = np.partition(own, 2 * k)[: 2 * k]
                least = distinct(part)
                out.append(least[:k] if len(least) >= k else distinct(own)[:k])
            else:
                out.append(distinct(own)[:k] if len(own) else np.array([whole[row]] if row in whole else [], np.uint64))
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return min(1.0, r * (na + nb) / (1 + r) / na)


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = sketch_batch(*binary_parts(batch.column(1)), k, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_hex(s) for s in sketches], pa.string()), pa.array([distinct_count(s, k) for s in sketches], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged_fingerprints(parts: DataFrame, key: str = "doc_id", k: int = K) -> DataFrame:
    """One fingerprint for each ``key`` from fingerprints of its parts (column ``fingerprint``).

    Hashes are made distinct by key and the k smallest kept by salted partial lists, so that a
    hot key's parts never meet whole in one task.
    """
    hashes = parts.select(key, F.explode(F.expr("regexp_extract_all(fingerprint, '[0-9a-f]{16}', 0)")).alias("h")).distinct()
    smallest = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k)
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64))).groupBy(key, "salt").agg(smallest("h").alias("some"))
    return salted.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k), "").alias("fingerprint"))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, guest, doc_id, id, place, text) rows such that each part, read in order, is followed by its next document.

    Parts are ranges of doc_id, and within an id that fills several of them, of ``place``, the
    text's hash.  The first document of the following part comes along as a ``guest`` row at
    the end, so a part needs no other one; the texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("text"), 11))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 1000 * parts).alias("c")).first()["c"] or []
    cuts = sorted(cuts if parts > 1 else [], reverse=True)  # as many numbers as parts
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    above = F.size(F.filter(bounds, lambda c: F.col("id") < c))
    within = F.size(F.filter(bounds, lambda c: F.col("id") == c))  # parts that the id fills
    placed = rows.withColumn("part", above + F.floor(F.col("place") / F.lit(2.0**53) * within).cast("int"))
    first = F.min(F.struct(F.bitwise_not("id").alias("i"), "place")).alias("first")
    heads = placed.groupBy("part").agg(first).select("part", F.bitwise_not("first.i").alias("id"), "first.place").orderBy("part").collect()  # three numbers for each part
    columns = ["part", "guest", "doc_id", "id", "place", "text"]
    placed = placed.withColumn("guest", F.lit(False)).select(*columns)
    if not heads:
        return placed
    wanted = spark.createDataFrame([(heads[i]["id"], heads[i]["place"], heads[i - 1]["part"]) for i in range(len(heads))], "id long, place long, host int")
    guests = rows.join(F.broadcast(wanted), ["id", "place"]).groupBy("id", "place", "host").agg(F.min("text").alias("text"))
    return placed.unionByName(guests.select(F.col("host").alias("part"), F.lit(True).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "id", "place", "text"))


def compare_with_edited(docs: DataFrame, k: int = K, words: int = WORDS, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text has its last floor(n/3) code points replaced by the first as many (or
    all) of the next document.  Texts stream through a part in order; one row is held back.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, doc_id, text, sketch of the row before

        def emit(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
            data = [t.encode() for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            edited = sketch_batch(np.frombuffer(b"".join(data), np.uint8), offsets, k, words)
            out = [(r[0], r[1], hashlib.sha256(d).hexdigest(), to_hex(r[2]), to_hex(e), resemblance(r[2], e, k), resemblance(r[2], r[3], k)) for r, d, e in zip(rows, data, edited, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sketches = sketch_batch(*binary_parts(batch.column("text")), k, words)
                rows, texts = [], []
                for part, guest, doc_id, text, sketch in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), sketches, strict=True):
                    if held is not None and held[0] == part:
                        n = len(held[2])
                        cut = n // 3
                        rows.append((held[1], n, held[3], sketch))
                        texts.append(held[2][: n - cut] + text[:cut])
                    held = None if guest else (part, doc_id, text, sketch)
                if rows:
                    yield emit(rows, texts)

    ordered = with_next(docs, parts).repartition("part").sortWithinPartitions("part", "guest", F.desc("id"), "place", "text").select("part", "guest", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
