"""Repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

All strings of a shard are indexed at once: round j inserts the j-th symbol from the
right of every string, i.e. its suffix of j symbols, into the sorted list of suffixes.
The links to the shorter suffixes and the longest common prefixes of neighbours are
columns kept in files of the task's own: each round reads one generation from front to
back, in blocks, and writes the next one; minima of common prefixes between two rows come
from the same reading.  The Burrows-Wheeler transform and the suffixes' positions are read
off the links when all rows stand.  Neighbours with a common prefix of
a whole window are repeats; of segments with equal contents one is indexed with their number
as its weight.  The files go when the task ends; a lost task is redone.

A symbol is a block of ``stride`` bytes and a text's strings are its ``stride`` phases
(stride: the largest divisor of the width up to 32; 25 for 200), so that a round moves all
phases on by a block; a repeat of ``width`` bytes is one of ``width / stride`` symbols.
Within a shard blocks are compared byte by byte, not by hash alone.

Cases: null text counts as empty; texts under a window's length keep all bytes.  Repeated
rows are documents of their own (their strings are repeats).  doc_ids may be null or
repeated: rows are told apart by ROW.  ``deduplicate`` keeps
the input's other columns; its results replace columns of the same names.  Empty
tables give empty results.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Rolling, byte_units, gram_names, small_batches
from .repeats import attached, merged, numbered, repeated_spans, texts_of


#: Bytes of distinct segments that are indexed at once: their columns take about 26 bytes of a task's own disk for each, and the task some 100 of memory.
SHARD_BYTES = 1 << 20


class Columns:
    """The sorted list's columns as files: one generation is read from the front, block by block, and the next one written."""

    #: key: a suffix's first symbol, and below 32 bits the row of the rest of it
    KINDS = {"key": np.int64, "bwt": np.uint32, "place": np.uint32, "lcp": np.uint8}

    def __init__(self, folder: str, block: int = 1 << 18):
        self.folder, self.block, self.generation, self.rows = folder, block, 0, 0

    def path(self, name: str, generation: int) -> str:
        return os.path.join(self.folder, f"{name}.{generation % 2}")

    def read(self, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.KINDS[name]), *(values for _, values in self.blocks(name))])

    def blocks(self, name: str) -> Iterator[tuple[int, np.ndarray]]:
        """(row, values) from front to back."""
        with open(self.path(name, self.generation), "rb") as file:
            for lo in range(0, self.rows, self.block):
                yield lo, np.fromfile(file, self.KINDS[name], min(self.block, self.rows - lo))

    def begin(self, **columns: np.ndarray) -> None:
        self.rows = len(next(iter(columns.values())))
        self.put(**columns)

    def put(self, **columns: np.ndarray) -> None:
        """Whole columns of this generation."""
        for name, values in columns.items():
            with open(self.path(name, self.generation), "wb") as out:
                values.astype(self.KINDS[name], copy=False).tofile(out)

    def merge(self, behind: np.ndarray, change: dict[str, Callable], **columns: np.ndarray) -> None:
        """Insert rows before the rows ``behind`` (ascending); ``change`` alters old values, given their first row and themselves."""
        with contextlib.ExitStack() as files:
            outs, i = [], 0
            for name in columns:
                # columns only grow: what the generation before last left is written over
                path = self.path(name, self.generation + 1)
                outs.append(files.enter_context(open(path, "r+b" if os.path.exists(path) else "wb")))
            for parts in zip(*map(self.blocks, columns), strict=True):
                lo, end = parts[0][0], parts[0][0] + len(parts[0][1])
                j = int(np.searchsorted(behind, end)) if end < self.rows else len(behind)
                at = behind[i:j] - lo + np.arange(j - i)  # places of the new rows, the same in all columns
                stays = np.ones(end - lo + j - i, bool)
                stays[at] = False
                for (name, new), (_, old), out in zip(columns.items(), parts, outs, strict=True):
                    both = np.empty(len(stays), self.KINDS[name])
                    both[at] = new[i:j]
                    both[stays] = change[name](lo, old) if name in change else old
                    both.tofile(out)
                i = j
        self.generation += 1
        self.rows += len(behind)


class RangeMinimum:
    """Minimum of values over (lo, hi], by doubling."""

    def __init__(self, values: np.ndarray):
        self.width = len(values)
        levels = np.empty((max(1, self.width.bit_length()), self.width), values.dtype)
        levels[0], step = values, 1
        for k in range(1, len(levels)):
            np.minimum(levels[k - 1, : self.width - 2 * step + 1], levels[k - 1, step : self.width - step + 1], out=levels[k, : self.width - 2 * step + 1])
            step *= 2
        self.levels = levels.ravel()

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.width + 1
        return np.minimum(self.levels[row + lo], self.levels[row + hi - (1 << level)])


def streamed_minima(columns: Columns, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of lcp over (lo, hi] for each pair, by one reading of the column from front to back.

    A range is the end of one block, whole blocks, and the front of another one, or lies
    within one; of whole blocks only the minimum is kept.
    """
    size = columns.block
    first, last = (lo + 1) // size, hi // size
    out = np.full(len(lo), 255, np.uint8)
    whole = np.zeros(-(-columns.rows // size), np.uint8)
    small = np.uint16 if len(whole) < 1 << 16 else np.int64  # numbers of 16 bits are sorted by their digits
    by_first, by_last = np.argsort(first.astype(small), kind="stable"), np.argsort(last.astype(small), kind="stable")
    start, stop = (np.append(0, np.cumsum(np.bincount(x, minlength=len(whole)))) for x in (first, last))
    for row, values in columns.blocks("lcp"):
        k = row // size
        whole[k] = values.min()
        opens = by_first[start[k] : start[k + 1]]
        inside = opens[last[opens] == k]
        if len(inside):
            out[inside] = RangeMinimum(values)(lo[inside] - row, hi[inside] - row)
        opens = opens[last[opens] > k]
        if len(opens):
            out[opens] = np.minimum.accumulate(values[::-1])[::-1][lo[opens] + 1 - row]
        closes = by_last[stop[k] : stop[k + 1]]
        closes = closes[first[closes] < k]
        if len(closes):
            out[closes] = np.minimum(out[closes], np.minimum.accumulate(values)[hi[closes] - row])
    far = np.flatnonzero(last - first > 1)
    if len(far):
        out[far] = np.minimum(out[far], RangeMinimum(whole)(first[far], last[far] - 1))
    return out


def collection_bwt(symbols: np.ndarray, last: np.ndarray, previous: np.ndarray, cap: int, folder: str, block: int = 1 << 18) -> Columns:
    """Insert every string's symbols from its last one to its first.

    symbols: 1.. at each position; last: the strings' last positions; previous: the position of
    the symbol before, or -1.  The first rows are the strings' empty suffixes.  ``lcp`` counts
    symbols common with the row above, up to ``cap``.  Returns the columns; ``place`` is the
    position of each suffix (empty suffixes: 0) and ``bwt`` the symbol before it, 0 at a start;
    both are written once all rows have their place, by a walk over the links.
    A round holds one row for each string and one count for each row; the columns stay in files.
    """
    columns = Columns(folder, block)
    n = len(last)
    columns.begin(key=np.arange(n), lcp=np.zeros(n, np.uint8))
    active, row = last, np.arange(n)  # next position to insert, and the row of the suffix after it
    while len(active):
        fresh = (symbols[active].astype(np.int64) << 32) | row
        order = np.argsort(fresh)
        fresh, active, row = fresh[order], active[order], row[order]
        # where each one goes, and the old rows above and below
        behind = np.full(len(fresh), columns.rows)
        above, below = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        i, before = 0, np.int64(0)
        for lo, keys in columns.blocks("key"):
            j = int(np.searchsorted(fresh, keys[-1]))
            at = np.searchsorted(keys, fresh[i:j])
            behind[i:j] = lo + at
            above[i:j] = np.where(at > 0, keys[at - 1], before)
            below[i:j] = keys[at]
            i, before = j, keys[-1]
        above[i:] = before
        joined = np.flatnonzero(behind[1:] == behind[:-1]) + 1  # right below another new row
        above[joined] = fresh[joined - 1]
        lowest = np.ones(len(fresh), bool)
        lowest[joined - 1] = False
        lowest &= behind < columns.rows
        lowest = np.flatnonzero(lowest)
        # common prefixes: of each new row with the one above, and of each old row below a new one
        upper, lower = np.concatenate([above, fresh[lowest]]), np.concatenate([fresh, below[lowest]])
        common = np.zeros(len(upper), np.uint8)
        same = np.flatnonzero(((upper >> 32) == (lower >> 32)) & (lower >> 32 > 0))
        common[same] = np.minimum(streamed_minima(columns, upper[same] & 0xFFFFFFFF, lower[same] & 0xFFFFFFFF) + 1, cap)
        lcp, falls = common[: len(fresh)], common[len(fresh) :]
        # rows of the next generation for those of this one: how many new ones stand above
        shift = np.cumsum(np.bincount(behind, minlength=columns.rows + 1), dtype=np.int32)

        def links(lo: int, keys: np.ndarray, shift=shift) -> np.ndarray:
            linked = keys[max(0, n - lo) :]  # the empty suffixes, which come first, have no link
            linked += shift[linked & 0xFFFFFFFF]
            return keys

        def changed(lo: int, values: np.ndarray, rows=behind[lowest], new=falls) -> np.ndarray:
            i, j = np.searchsorted(rows, [lo, lo + len(values)])
            values[rows[i:j] - lo] = new[i:j]
            return values

        has = previous[active] >= 0
        columns.merge(behind, {"key": links, "lcp": changed}, key=fresh + shift[row], lcp=lcp)
        active, row = previous[active[has]], (behind + np.arange(len(behind)))[has]
    # the links turned round lead each string from its end to its start, over the rows of all its suffixes
    longer = np.zeros(columns.rows, np.int32)
    for lo, keys in columns.blocks("key"):
        own = max(0, n - lo)
        longer[keys[own:] & 0xFFFFFFFF] = np.arange(lo + own, lo + len(keys))
    place, bwt = np.zeros(columns.rows, np.uint32), np.zeros(columns.rows, np.uint32)
    active, row = last, np.arange(n)
    bwt[:n] = symbols[last]
    while len(active):
        row, before = longer[row], previous[active]
        has = before >= 0
        place[row], bwt[row] = active, np.where(has, symbols[before], 0)
        active, row = before[has], row[has]
    columns.put(place=place, bwt=bwt)
    return columns


def stride_of(width: int, most: int = 32) -> int:
    return max(s for s in range(1, min(width, most) + 1) if width % s == 0)


def repeated_windows(raw: np.ndarray, offsets: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of bytes that begin a repeated window, and offsets by text; each text counts ``copies`` times."""
    values, at, _, _ = byte_units(raw, offsets)
    n, stride = len(values), stride_of(width)
    depth = width // stride
    mask = np.zeros(n, bool)
    if n < width:
        return mask, at
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    blocks = Rolling(values).grams(stride)
    del values
    ok = np.zeros(n, bool)
    ok[: len(blocks)] = row[: len(blocks)] == row[stride - 1 :]
    symbols = gram_names(raw, blocks, stride, ok).astype(np.uint32)
    del blocks
    previous = np.full(n, -1, np.int32)
    both = ok[: n - stride] & ok[stride:] & (row[: n - stride] == row[stride:])
    previous[stride:][both] = np.flatnonzero(both)
    last = ok.copy()
    last[: n - stride] &= ~both
    start = np.zeros(n, bool)
    start[: n - width + 1] = row[: n - width + 1] == row[width - 1 :]
    weight = np.where(start, copies[row], 0).astype(np.int32)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        columns = collection_bwt(symbols, np.flatnonzero(last).astype(np.int32), previous, depth, folder)
        # rows with a whole window in common stand together: their windows' weights are summed
        sums, group = np.zeros(columns.rows + 1, np.int32), 0
        pairs = lambda: zip(columns.blocks("lcp"), columns.blocks("place"), strict=True)
        for (lo, lcp), (_, place) in pairs():
            own = np.where(np.arange(lo, lo + len(place)) < int(last.sum()), 0, weight[place])  # empty suffixes have no window
            which = np.cumsum(lcp < depth)
            found = np.bincount(which, own)
            sums[group : group + len(found)] += found.astype(np.int32)
            group += int(which[-1])
        group = 0
        for (_, lcp), (_, place) in pairs():
            which = group + np.cumsum(lcp < depth)
            mask[place[sums[which] > 1]] = True
            group = int(which[-1])
    return mask & start, at


def repeated_byte_spans(docs: DataFrame, width: int = 200, **options) -> DataFrame:
    """ROW, spans array<struct<a, b>> in bytes: all strings of ``width`` bytes that also start elsewhere."""
    return repeated_spans(docs, "bytes", width, repeated_windows, **({"shard_bytes": SHARD_BYTES} | options))


def removal(rows: DataFrame, width: int, full: bool, **options) -> DataFrame:
    """ROW, n_bytes, n_removed, n_spans, kept_sha256 of ``rows(ROW, text)``; if ``full`` also kept (binary) and removed_spans."""
    small_batches(rows.sparkSession)
    spans = repeated_byte_spans(rows, width, **options)
    names = [ROW, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "removed_spans"] if full else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = [], batch.column("spans")
            for row, i in zip(batch.column(ROW).to_pylist(), range(batch.num_rows), strict=True):
                data = batch.column("text")[i].as_py() or b""
                runs = merged(spans[i].as_py()) if spans[i].is_valid else []
                parts, last = [], 0
                for a, b in runs:
                    parts.append(data[last:a])
                    last = b
                kept = b"".join([*parts, data[last:]])
                found = (row, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*found, kept, [{"a": a, "b": b} for a, b in runs]) if full else found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(len(names))], names=names)

    schema = f"{ROW} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed_spans array<struct<a:int,b:int>>" * full
    return texts_of(rows).join(spans, ROW, "left").select(ROW, "text", "spans").mapInArrow(run, schema)


def deduplicate(docs: DataFrame, width: int = 200, **options) -> DataFrame:
    """All rows and columns of ``docs`` with kept (binary), n_bytes, n_removed, n_spans, removed_spans (merged, in bytes), kept_sha256."""
    rows = numbered(docs, *[F.col(f"`{c}`") for c in docs.columns if c != ROW])
    return attached(rows, removal(rows, width, True, **options))


def digests(docs: DataFrame, width: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = numbered(docs, "doc_id", "text")
    return rows.select(ROW, "doc_id").join(removal(rows, width, False, **options), ROW).drop(ROW)
