"""What both repeated-substring operators share: bringing equal windows together.

A window is ``width`` consecutive units (words or bytes) of one text.  Each window
has an anchor, the smallest hash of the grams in it; equal windows have equal
anchors.  Runs of consecutive windows with one anchor form a segment, so that a
corpus makes few segments (about two for each ``width`` units) and every window lies
in exactly one.  The plan is:

1. segments of all texts (row numbers, places and hashes only, no text), written once;
2. anchors seen twice or more, in two segments or within one, by a count with map-side
   sums; other segments hold no repeated window;
3. of segments with the same contents (equal anchor and XXH64 of their bytes, 128 bits)
   one is kept with its number of copies, its weight in the index;
4. the kept segments' bytes go to shards by anchor.  The caller's index (FM-index, or
   collection BWT with common prefixes) finds the windows of weight two or more;
5. the findings return to all segments of the same contents and are gathered by text.

An anchor whose segments have more bytes than a shard should hold is dealt to many shards: its
segments are cut into runs of windows in which the anchor stands in nearly the same
place, and a run goes by the hash of the units that all windows at those places share.
Equal windows still meet in one shard, and the same index finds them there.  (Only a
passage that is all but a unit or two of a window, in a great many different
surroundings, would still meet whole in one shard.)  A shard that comes out larger all the
same is indexed in parts of a shard's size, one after the other (``parts_of``), since an index
needs some hundred bytes of memory for each of its shard.  Every stage is a Spark shuffle on a
well-spread key; lost tasks are recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, ROW, U64, Rolling, binary_parts, byte_units, materialize, number_rows, slices, sliding_min, word_units

UNITS = {"bytes": byte_units, "words": word_units}
SEGMENT_SCHEMA = f"{ROW} long, pos int, b0 int, b1 int, anchor long, content long, inner boolean"
#: Bytes of distinct segments that one shard's index holds.
SHARD_BYTES = 4 << 20
_SEGMENT_ARROW = pa.schema([(ROW, pa.int64()), ("pos", pa.int32()), ("b0", pa.int32()), ("b1", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("inner", pa.bool_())])
_CUT = "shard long, anchor long, content long, at int, copies int, data binary"
_CUT_ARROW = pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("copies", pa.int32()), ("data", pa.binary())])


def default_gram(width: int) -> int:
    """Units in an anchor's gram: long enough to be rare, short enough for few segments."""
    return max(1, min(width // 5, 32))


def default_run(width: int) -> int:
    """Places of the anchor that share a run, where an anchor is dealt to many shards."""
    return max(1, width // 12)


def canonical(raw: np.ndarray, first: np.ndarray, last: np.ndarray, units: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes in which equal units in a row are equal bytes, and each unit's first and last byte (exclusive) there."""
    if units == "bytes" or not len(first):
        return raw.tobytes(), first, last
    kept = ~_IS_SPACE[raw]
    places = np.cumsum(kept) + 0
    number = np.arange(len(first))  # one space after each word
    size = last - first
    out = np.full(int(places[-1]) + len(first), 32, np.uint8)
    begin = np.cumsum(size) - size + number
    solid = raw[kept]
    at = np.arange(len(solid)) + np.repeat(number, size)
    out[at] = solid
    return out.tobytes(), begin, begin + size


def segments_of(raw: np.ndarray, offsets: np.ndarray, units: str, width: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of some texts: text index, first window, windows, byte range, anchor and content hash."""
    values, at, first, last = UNITS[units](raw, offsets)
    rolling = Rolling(values)
    grams, span = rolling.grams(gram), width - gram + 1
    anchors = sliding_min(grams, span)
    n = len(anchors)
    if n == 0:
        return {k: np.zeros(0, np.int64) for k in ("row", "pos", "windows", "b0", "b1", "anchor", "content", "inner")}
    lengths = np.diff(at)
    row = np.repeat(np.arange(len(lengths)), lengths)
    valid = row[:n] == row[width - 1 : width - 1 + n]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (anchors[1:] != anchors[:-1]) | (row[1:n] != row[: n - 1]) | (valid[1:] != valid[:-1])
    heads = np.flatnonzero(change)
    run = np.diff(np.append(heads, n))
    heads, run = heads[valid[heads]], run[valid[heads]]
    pieces = -(-run // width)  # no segment has more than ``width`` windows
    extra = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(heads, pieces) + extra * width
    windows = np.minimum(width, np.repeat(heads + run, pieces) - starts)
    ends = starts + windows - 1 + width
    data, c0, c1 = canonical(raw, first, last, units)
    digest = xxhash.xxh64_intdigest
    content = np.fromiter((digest(data[a:b]) for a, b in zip(c0[starts].tolist(), c1[ends - 1].tolist(), strict=True)), U64, len(starts))
    # equal windows of one segment: its anchor stands in it twice
    edge = np.full(span - 1, ~U64(0))
    at_anchor = np.flatnonzero(grams == ~sliding_min(np.concatenate([edge, ~anchors, edge]), span))
    again = at_anchor[1:][grams[at_anchor[1:]] == grams[at_anchor[:-1]]]
    earlier = at_anchor[:-1][grams[at_anchor[1:]] == grams[at_anchor[:-1]]]
    inner = np.zeros(len(starts), bool)
    if len(again):
        k = np.searchsorted(earlier, starts)  # the first such pair from the segment's start on
        inner = (k < len(again)) & (again[np.minimum(k, len(again) - 1)] < ends - gram + 1)
    base = offsets - offsets[0]
    r = row[starts]
    return {"row": r, "pos": starts - at[r], "windows": windows, "b0": first[starts] - base[r], "b1": last[ends - 1] - base[r], "anchor": anchors[starts].view(np.int64), "content": content.view(np.int64), "inner": inner}


def find_segments(docs: DataFrame, units: str, width: int, gram: int) -> DataFrame:
    """SEGMENT_SCHEMA rows of ``docs(ROW, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = binary_parts(batch.column(1))
            for i, j in slices(offsets):
                s = segments_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1], units, width, gram)
                if len(s["row"]):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(s["row"] + i)), *(pa.array(s[k].astype(np.int32)) for k in ("pos", "b0", "b1")), pa.array(s["anchor"]), pa.array(s["content"]), pa.array(s["inner"])], schema=_SEGMENT_ARROW)

    return docs.select(ROW, F.col("text").cast("binary").alias("text")).mapInArrow(run, SEGMENT_SCHEMA)


def runs_of(piece: bytes, anchor: int, units: str, width: int, gram: int, run: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Of a segment's bytes: first window, windows, bytes that all windows of its kind share, and bytes of each run.

    In a run the anchor's first place in the window is the same but for ``run`` units.
    """
    raw = np.frombuffer(piece, np.uint8)
    values, _, first, last = UNITS[units](raw, np.array([0, len(raw)]))
    data, c0, c1 = canonical(raw, first, last, units)
    windows = np.arange(len(values) - width + 1)
    places = np.flatnonzero(Rolling(values).grams(gram).view(np.int64) == anchor)
    place = places[np.searchsorted(places, windows)]
    kind = (place - windows) // run
    heads = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(windows)], strict=True):
        q, k = int(place[a]), int(kind[a])
        most = min((k + 1) * run, width - gram + 1) - 1
        common = data[c0[q - k * run] : c1[q - most + width - 1]]
        yield a, b - a, b"%d " % k + common, piece[first[a] : last[b + width - 2]]


def dealt(cut: DataFrame, shards: int, units: str, width: int, gram: int) -> DataFrame:
    """_CUT rows from (anchor, content, copies, hot, data): each segment, or each run of a hot anchor's, with its shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            anchor = batch.column("anchor").to_numpy()
            cold = pa.array(~hot)
            shard = (anchor[~hot].view(U64) * U64(0x9E3779B97F4A7C15) >> U64(33)).astype(np.int64) % shards
            kept = batch.filter(cold)
            yield pa.RecordBatch.from_arrays([pa.array(shard), kept.column("anchor"), kept.column("content"), pa.array(np.zeros(len(shard), np.int32)), kept.column("copies"), kept.column("data")], schema=_CUT_ARROW)
            for i in np.flatnonzero(hot).tolist():
                a, c, n = int(anchor[i]), batch.column("content")[i].as_py(), batch.column("copies")[i].as_py()
                found = list(runs_of(batch.column("data")[i].as_py(), a, units, width, gram, default_run(width)))
                keys = [xxhash.xxh64_intdigest(key, a & 0xFFFFFFFF) % shards for _, _, key, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([a] * len(found), pa.int64()), pa.array([c] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([n] * len(found), pa.int32()), pa.array([f[3] for f in found], pa.binary())], schema=_CUT_ARROW)

    return cut.select("anchor", "content", "copies", "hot", "data").mapInArrow(send, _CUT)


def parts_of(table: pa.Table, limit: int, units: str, width: int, gram: int) -> Iterator[tuple]:
    """A shard's _CUT rows in parts of at most ``limit`` bytes, where no two parts have a window in common.

    A part is the pieces' bytes, offsets and copies and, for each place where a piece stands, the piece's number, the row and
    the piece's first window in it.  A shard within the limit is one part.  Of a larger one, equal pieces become one and a part
    takes whole anchors; an anchor beyond the limit is cut into runs, shorter ones if need be, and windows with different
    keys stand apart.  Runs of one window with one key are one piece, so the limit holds for any shard.
    """
    raw, offsets = binary_parts(table.column("data"))
    copies, every = table.column("copies").to_numpy(), np.arange(table.num_rows)
    if offsets[-1] <= limit:
        yield raw, offsets, copies, every, every, np.zeros(len(every), np.int64)
        return
    plain = (lambda piece: piece) if units == "bytes" else (lambda piece: b" ".join(piece.split()))
    groups: dict = {}
    for i, anchor in enumerate(table.column("anchor").to_pylist()):
        groups.setdefault(anchor, {}).setdefault(plain(raw[offsets[i] : offsets[i + 1]].tobytes()), []).append((i, 0))
    todo, part, size = [(anchor, default_run(width), pieces) for anchor, pieces in groups.items()], [], 0
    while todo:
        anchor, run, pieces = todo.pop()
        more = sum(map(len, pieces))
        if more > limit and run and len(pieces) > 1:
            finer: dict = {}
            for piece, places in pieces.items():
                for a, _, key, cut in runs_of(piece, anchor, units, width, gram, run):
                    finer.setdefault(key, {}).setdefault(plain(cut), []).extend((i, first + a) for i, first in places)
            todo += [(anchor, run // 4 or run // 2, found) for found in finer.values()]
            continue
        if part and size + more > limit:
            yield packed(part, copies)
            part, size = [], 0
        part += pieces.items()
        size += more
    yield packed(part, copies)


def packed(part: list[tuple[bytes, list]], copies: np.ndarray) -> tuple:
    """A part of ``parts_of`` from its pieces and their places."""
    many = np.array([len(places) for _, places in part])
    row, first = np.array([place for _, places in part for place in places], np.int64).T
    piece = np.repeat(np.arange(len(part)), many)
    weight = np.minimum(np.bincount(piece, copies[row]), 2).astype(copies.dtype)
    return np.frombuffer(b"".join(p for p, _ in part), np.uint8), np.append(0, np.cumsum([len(p) for p, _ in part])), weight, piece, row, first


def windows_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows: the segment (``at``: their first units), first window and end in it."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run over several segments is cut at their borders
    seg_a, seg_b = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b - 1, side="right") - 1
    many = seg_b - seg_a + 1
    seg = np.repeat(seg_a, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = np.maximum(np.repeat(a, many), at[seg]) - at[seg], np.minimum(np.repeat(b, many), at[seg + 1]) - at[seg]
    full = hi > lo
    return seg[full], lo[full], hi[full]


def repeated_spans(docs: DataFrame, units: str, width: int, index: Callable, *, gram: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """ROW and its repeated spans [(start, end)) in units, one row for each row of ``docs`` that has any.

    ``docs`` has text and ROW, a number of the row's own that stays (``common.number_rows``).  ``index`` is called in a task with the segments' bytes, the
    numbers of copies (1, or 2 for more) and the width, and returns for each segment the repeated windows' mask.
    """
    gram = gram or default_gram(width)
    found = materialize(find_segments(docs, units, width, gram), "segments")
    bytes_of = F.col("b1") - F.col("b0")
    # segments of an anchor; kept apart from the join, so that Spark can split a frequent anchor there
    twice = found.groupBy("anchor").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("n"), F.sum(bytes_of.cast("long")).alias("size")).where("n > 1")
    # an anchor is dealt to many shards as a whole or not at all: equal windows may stand in a long and in a short segment
    twice = materialize(twice.select("anchor", (F.col("size") > shard_bytes).alias("hot")), "anchors")
    shared = materialize(found.drop("inner").join(twice, "anchor"), "shared")
    kept = materialize(shared.groupBy("anchor", "content").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.min(F.struct(ROW, "b0", "b1")).alias("at"), F.first("hot").alias("hot")).select("anchor", "content", "copies", "hot", "at.*"), "contents")
    grown = (width + default_run(width)) // default_run(width)  # bytes of a hot anchor's runs for each of its segments', at most
    total = kept.agg(F.sum(F.when(F.col("hot"), bytes_of * grown).otherwise(bytes_of)).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    wanted = kept.groupBy(ROW).agg(F.collect_list(F.struct("anchor", "content", "copies", "b0", "b1", "hot")).alias("cuts"))
    cut = (
        texts_of(docs)
        .join(wanted, ROW)
        .select("text", F.explode("cuts").alias("s"))
        .select("s.anchor", "s.content", "s.copies", "s.hot", F.expr("substring(text, s.b0 + 1, s.b1 - s.b0)").alias("data"))
    )

    def run(table: pa.Table) -> pa.Table:
        anchor, at, found = table.column("anchor"), table.column("at").to_numpy(), []
        for raw, offsets, copies, piece, row, first in parts_of(table, shard_bytes, units, width, gram):
            seg, lo, hi = windows_of(*index(raw, offsets, copies, width))
            each = np.bincount(seg, minlength=len(offsets) - 1)
            begin, many = (np.cumsum(each) - each)[piece], each[piece]
            has = many > 0
            row, ahead, begin, many = row[has], (at[row] + first)[has], begin[has], many[has]
            ends = np.append(0, np.cumsum(many))
            k = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], many)
            ahead = np.repeat(ahead, many)
            runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array((lo[k] + ahead).astype(np.int32)), pa.array((hi[k] + ahead).astype(np.int32))], ["a", "b"]))
            found.append(pa.table({"anchor": anchor.take(pa.array(row)), "content": table.column("content").take(pa.array(row)), "runs": runs}))
        return pa.concat_tables(found)

    repeated = dealt(cut, shards, units, width, gram).groupBy("shard").applyInArrow(run, "anchor long, content long, runs array<struct<a:int,b:int>>")
    return (
        shared.select(ROW, "pos", "anchor", "content")
        .join(repeated, ["anchor", "content"])
        .select(ROW, "pos", F.explode("runs").alias("r"))
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct((F.col("pos") + F.col("r.a")).alias("a"), (F.col("pos") + F.col("r.b") + (width - 1)).alias("b")))).alias("spans"))
    )


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` and ROW, which is made here unless ``docs`` has it."""
    return docs.select(*columns, ROW) if ROW in docs.columns else number_rows(docs.select(*columns))


def texts_of(docs: DataFrame) -> DataFrame:
    """ROW and the text's bytes: the same columns wherever texts are shuffled by row, so that Spark shuffles them once."""
    return docs.select(ROW, F.col("text").cast("binary").alias("text"))


def attached(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``rows`` but ROW, with those of ``found(ROW, ...)``, which replace columns of the same names."""
    names = [c for c in found.columns if c != ROW]
    own = rows.select(F.col(ROW).alias("at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own"))
    new = found.select(F.col(ROW).alias("to"), F.struct(*names).alias("new"))
    kept = [F.col(f"own.`{c}`") for c in rows.columns if c not in [*names, ROW]]
    return own.join(new, F.col("at") == F.col("to")).select(*kept, "new.*")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping or touching spans, sorted by start, made one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = s["a"], s["b"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
