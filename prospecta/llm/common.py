"""Shared helpers of the training-data operators.

Hashes here are 64-bit polynomial fingerprints modulo 2**64 over a fixed random
byte table, finished with a bit mixer; all of them are computed with numpy over
whole Arrow batches, so no Python loop runs per word or per byte.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D]: what ``bytes.split()`` splits on.
SPACE_REGEX = r"[\x20\x09-\x0D]+"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in slices of about so many bytes, to keep arrays in cache.
SLICE_BYTES = 1 << 20

#: Bytes of texts that go to a Python worker at once, about.  Spark's own limit is 64 MB, which the executor's and each worker's memory hold at once.
BATCH = 4 << 20

#: Column of a row's number: doc_ids may be null or repeated.
ROW = "_row_number"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder ``spark.checkpoint.dir``; one of its own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            root = chosen.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="prospecta-checkpoint-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    Columns in ``folders`` make folders of their own, so that a filter on them reads those only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH bytes for this session; plans run later, so the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def number_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row in ROW, written to the shared folder so that it stays."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


#: File names that are sent to all tasks, at most.
MOST_FILES = 100_000


def number_files(docs: DataFrame) -> DataFrame:
    """As number_rows, for a plain scan of files, without a copy: from the file's place among the names and the row in it.

    The names go to all tasks; of more than MOST_FILES files a numbered copy is made instead.
    """
    file = F.col("_metadata.file_path")
    names = sorted(r["f"] for r in docs.select(file.alias("f")).distinct().limit(MOST_FILES + 1).collect())
    if len(names) > MOST_FILES:
        return number_rows(docs)
    places = docs.sparkSession.createDataFrame(list(enumerate(names)), "_place long, _file string")
    rows = docs.select(F.struct("*").alias("_own"), file.alias("_file"), F.col("_metadata.row_index").alias("_at")).join(F.broadcast(places), "_file")
    # not null, so that no join filters it and texts shuffled by it are the same everywhere
    return rows.select("_own.*", F.coalesce(F.shiftleft("_place", 40) + F.col("_at"), F.lit(-1)).alias(ROW))


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64 bits, in place."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


class Rolling:
    """Prefix sums over unit values: the fingerprint of any span of units in O(1)."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.prefix = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed fingerprints of [start, end)."""
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        """Mixed fingerprints of all spans of ``size`` units."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.prefix[size:] - self.prefix[:n]) * self.down[:n])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n+1) of a binary or string Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def byte_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit values, unit offsets by text, and each unit's first and last byte (exclusive) in its slice, for bytes."""
    at = np.arange(len(raw), dtype=np.int64)
    return _TABLE[raw], offsets - offsets[0], at, at + 1


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As byte_units, for words: maximal runs of bytes that are not ASCII white space.

    A word's value is the sum of its bytes, each mixed with its place in the word.
    """
    offsets = offsets - offsets[0]
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), starts, ends
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(np.append(0, starts[1:]), np.diff(np.append(np.append(0, starts[1:]), len(raw))))
    place <<= 8
    place += raw
    each = mix(place.view(U64) + U64(1))
    each[~solid] = 0
    return mix(np.add.reduceat(each, starts)), np.searchsorted(starts, offsets), starts, ends


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def exact_names(units: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` consecutive units, equal where the units are: pairs of names are named again."""
    names, reach = np.unique(units, return_inverse=True)[1], 1
    while reach < size:
        step = min(reach, size - reach)
        pairs = names[: len(names) - step] * np.int64(int(names.max(initial=0)) + 1) + names[step:]
        names, reach = np.unique(pairs, return_inverse=True)[1], reach + step
    return names


def gram_names(units: np.ndarray, hashes: np.ndarray, size: int, ok: np.ndarray) -> np.ndarray:
    """1.. for each position where ``size`` units begin (``ok``), equal just where the units are; 0 elsewhere.

    Units are named by their hashes; every one is then held against another one of its name, the same for all,
    unit by unit, and if any differs all are named by their units instead.
    """
    names = np.zeros(len(units), np.int64)
    at = np.flatnonzero(ok)
    if not len(at):
        return names
    found = hashes[at]
    order = np.argsort(found)
    ranked = found[order]
    head = np.append(True, ranked[1:] != ranked[:-1])
    rank = np.cumsum(head)
    own, ordered = np.empty(len(at), np.int64), at[order]
    own[order] = rank
    at, same = ordered[~head], ordered[head][rank[~head] - 1]
    if units.dtype == np.uint8 and size >= 8:  # eight bytes at a time
        units_at = np.ndarray(len(units) - 7, np.dtype("<u8"), np.ascontiguousarray(units), strides=(1,))
        steps = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    else:
        units_at, steps = units, range(size)
    if all(np.array_equal(units_at[at + k], units_at[same + k]) for k in steps):
        names[ok] = own
    else:
        names[ok] = exact_names(units, size)[np.flatnonzero(ok)] + 1
    return names


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
