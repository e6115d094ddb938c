"""Substring deduplication with a compressed FM-index per shard.

A shard's index is the Burrows-Wheeler transform of its token strings, held in a
wavelet tree of packed bit planes with block counts.  Documents stream against it in
backward search; a window's matching statistic is the number of its symbols that a
backward search matches before fewer than two places remain, and windows matched
through their whole length in two places or more are reported.  Of segments with equal
contents one is indexed with their number as its weight: an interval counts the weights
of its places.

A symbol is a gram of ``stride`` consecutive words, the strings of a document are its
``stride`` phases, and a window of ``width`` words is ``width / stride`` symbols of one
phase (stride: the largest divisor of the width up to 8; 7 for 35).  Matches of whole
windows are the same as over single words, in fewer and more selective steps.  Within a
shard words and grams are compared as they are, not by hash.

Cases: null or empty text, or fewer words than a window: nothing is removed.  Repeated
rows are documents of their own (their windows are repeats).  doc_ids may be null or
repeated: rows are told apart by ROW.  Other columns pass through ``deduplicate``; its
results replace columns of the same names.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, U64, Rolling, gram_names, mix
from .repeats import attached, merged, numbered, repeated_spans, texts_of


class WaveletTree:
    """Rank over a sequence of symbols below ``sigma``: one packed bit plane per level, most significant first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, U64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.planes.append((words, counts, int(len(bits) - bits.sum())))
            current = np.concatenate([current[~bits], current[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (words, counts, zeros) in zip(range(self.levels - 1, -1, -1), self.planes, strict=True):
            one = ((symbols >> level) & 1).astype(bool)
            for x in (lo, hi):
                block = x >> 6
                ones = counts[block] + np.bitwise_count(words[block] & ((U64(1) << (x & 63).astype(U64)) - U64(1)))
                np.copyto(x, np.where(one, zeros + ones, x - ones))
        return hi - lo


class FMIndex:
    """FM-index of the phase strings of a shard's texts.  ``symbols`` are 1.. (0: no symbol here)."""

    def __init__(self, symbols: np.ndarray, follows: np.ndarray, depth: int, weights: np.ndarray):
        """follows: the position of the next symbol of the same string, or -1; weights: how often each position counts."""
        n = len(symbols)
        self.sigma = int(symbols.max(initial=0)) + 1
        ranks = symbols.astype(np.int64)
        hop, reach = follows, 1
        while reach < depth:  # order by the first ``reach`` symbols, doubled each time
            nxt = np.where(hop >= 0, ranks[hop] + 1, 0)
            _, ranks = np.unique(ranks * (int(nxt.max(initial=0)) + 1) + nxt, return_inverse=True)
            hop = np.where(hop >= 0, follows_at(hop, hop), -1)
            reach *= 2
        real = np.flatnonzero(symbols)
        order = real[np.argsort(ranks[real], kind="stable")]
        before = np.zeros(n, np.int64)
        has = follows >= 0
        before[follows[has]] = symbols[has]
        last = real[follows[real] < 0]
        bwt = np.concatenate([symbols[last], before[order]])  # the empty suffixes come first
        self.tree = WaveletTree(bwt, self.sigma)
        counts = np.bincount(symbols[real], minlength=self.sigma + 1)
        self.first = len(last) + np.concatenate([[0], np.cumsum(counts)])
        self.weight = np.concatenate([np.zeros(len(last) + 1, np.int64), np.cumsum(weights[order])])

    def places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places in the corpus that intervals stand for."""
        return self.weight[hi] - self.weight[lo]

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern from those of the pattern."""
        base = self.first[symbols]
        return base + self.tree.rank(symbols, lo), base + self.tree.rank(symbols, hi)


def follows_at(hop: np.ndarray, index: np.ndarray) -> np.ndarray:
    return hop[index]


def stride_of(width: int, most: int = 8) -> int:
    return max(s for s in range(1, min(width, most) + 1) if width % s == 0)


def word_numbers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a number, equal where the words are, and word offsets by text."""
    known: dict[bytes, int] = {}
    data, out, ends = raw.tobytes(), [], [0]
    base = (offsets - offsets[0]).tolist()
    for a, b in zip(base[:-1], base[1:], strict=True):
        out += [known.setdefault(w, len(known)) for w in data[a:b].split()]
        ends.append(len(out))
    return np.array(out, np.int64), np.array(ends, np.int64)


def matching_statistics(raw: np.ndarray, offsets: np.ndarray, copies: np.ndarray, width: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: symbols of its window matched in two places or more, and the places of the last match; word offsets by text."""
    words, at = word_numbers(raw, offsets)
    n, stride = len(words), stride_of(width)
    steps = width // stride
    matched, places = np.zeros(n, np.int32), np.zeros(n, np.int64)
    if n < width:
        return matched, places, at
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    grams = Rolling(mix(words.astype(U64) + U64(1))).grams(stride)
    ok = np.zeros(n, bool)
    ok[: len(grams)] = row[: len(grams)] == row[stride - 1 :]
    symbols = gram_names(words, grams, stride, ok)
    follows = np.full(n, -1, np.int64)
    both = ok[: n - stride] & ok[stride:] & (row[: n - stride] == row[stride:])
    follows[: n - stride][both] = np.flatnonzero(both) + stride
    index = FMIndex(symbols, follows, steps, np.repeat(copies, np.diff(at)))
    windows = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    for i in range(0, len(windows), block):
        start = windows[i : i + block]
        s = symbols[start + (steps - 1) * stride]
        lo, hi = index.first[s], index.first[s + 1]
        for step in range(steps - 1, -1, -1):
            if step < steps - 1:
                lo, hi = index.extend(symbols[start + step * stride], lo, hi)
            found = index.places(lo, hi)
            live = found > 1
            start, lo, hi = start[live], lo[live], hi[live]
            matched[start] = steps - step
            places[start] = found[live]
    return matched, places, at


def repeated_windows(raw: np.ndarray, offsets: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of words that begin a repeated window, and word offsets by text; each text counts ``copies`` times."""
    matched, _, at = matching_statistics(raw, offsets, copies, width)
    return matched == width // stride_of(width), at


def repeated_word_spans(docs: DataFrame, width: int = 35, **options) -> DataFrame:
    """ROW, spans array<struct<a, b>> in words: all windows of ``width`` words that also start elsewhere."""
    return repeated_spans(docs, "words", width, repeated_windows, **options)


def deduplicate(docs: DataFrame, width: int = 35, **options) -> DataFrame:
    """All rows and columns of ``docs`` with kept_text, n_words, n_removed and removed_spans (merged, in words)."""
    rows = numbered(docs, *[F.col(f"`{c}`") for c in docs.columns if c != ROW])
    spans = repeated_word_spans(rows, width, **options)
    joined = texts_of(rows).join(spans, ROW, "left").withColumn("kept", _keep(F.col("text").cast("string"), F.col("spans")))
    return attached(rows, joined.select(ROW, "kept.*"))


KEPT = "kept_text string, n_words long, n_removed long, removed_spans array<struct<a:int,b:int>>"


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[bytes, int, list[tuple[int, int]]]:
    words = (text or "").encode().split()
    runs = merged(spans or [])
    kept, last = [], 0
    for a, b in runs:
        kept += words[last:a]
        last = b
    return b" ".join(kept + words[last:] if runs else words), len(words), runs


def _keep(text: Column, spans: Column) -> Column:
    @F.pandas_udf(KEPT)
    def keep(texts, found):
        import pandas as pd

        rows = [kept_words(t, s) for t, s in zip(texts, (None if x is None else list(x) for x in found), strict=True)]
        return pd.DataFrame({"kept_text": [k.decode() for k, _, _ in rows], "n_words": [n for _, n, _ in rows], "n_removed": [sum(b - a for a, b in r) for _, _, r in rows], "removed_spans": [[{"a": a, "b": b} for a, b in r] for _, _, r in rows]})

    return keep(text, spans)


def digests(docs: DataFrame, width: int = 35, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: the removal's outcome without the texts."""
    rows = numbered(docs, "doc_id", "text")
    spans = repeated_word_spans(rows, width, **options)
    joined = texts_of(rows).join(spans, ROW, "left").select(ROW, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            spans = batch.column("spans")
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or b"").split()
                runs = merged(spans[i].as_py()) if spans[i].is_valid else []
                removed, last, kept = 0, 0, [] if runs else words
                for a, b in runs:
                    kept += words[last:a]
                    removed, last = removed + b - a, b
                if runs:
                    kept += words[last:]
                n_words.append(len(words))
                n_removed.append(removed)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=[ROW, "n_words", "n_removed", "kept_sha256"])

    found = joined.mapInArrow(run, f"{ROW} long, n_words long, n_removed long, kept_sha256 string")
    return rows.select(ROW, "doc_id").join(found, ROW).drop(ROW)
