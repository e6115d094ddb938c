"""Near-deduplication by MinHash-like SetSketch registers: banded, estimated by likelihood, verified.

A text's set is its distinct word shingles.  A register is the least of the set's values under
a hash of its own, read as an exponential variable of rate RATE and kept as
floor(1 - log_BASE value), cut off at 0 and TOP: exponentially spaced truncated minima.
Registers of a union are the greater ones of both sides (``merge``), and two registers are
equal with a probability of about the Jaccard similarity J, so bands of them find candidates.
A candidate's J is estimated jointly from how many registers are greater on the one side, on
the other and equal, given both set sizes; only where the counts are exp(DOUBT) times likelier
at that estimate than at the threshold is the candidate dropped.  The rest are compared on full sets.

Equal sets are one to begin with, so copies cost one row of a sum each.  In a bucket of equal
bands every set is a candidate with the bucket's first one; that is linear in the rows.  What
these links leave in several components goes on exactly: sets of one bucket that are in
different components are held against each other, register by register, in blocks of BLOCK by BLOCK
rows that are tasks' groups of their own.  Those with any candidate meet once more with their
texts, likeliest pairs first; pairs within a component need no look, and no row is made of a pair
but of links that join two components.  A link of J at the threshold is missed with
probability (1 - J**ROWS)**BANDS by the bands (6e-9 at 0.85) and about 3e-7 by the estimate.

Sets are of 64-bit shingle hashes; equal sets are found by two 64-bit sums over them and the size.

Cases: null text or no word: the empty set, linked with nothing.  Fewer words than a shingle:
the whole sequence is the one shingle.  Null doc_ids count as the largest; a component of such
rows only has a null component_id.  Rows with one doc_id and different texts are rows of
their own; ``kept`` says whether the row's id is its component's.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, binary_parts, materialize, mix
from .links import components, find, shingles_of

WORDS, PERCENT = 5, 85
BANDS, ROWS = 40, 6
#: Registers: base of the spacing, rate of the exponential values, largest value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: log of the likelihood ratio at which a candidate is dropped: five standard deviations.
DOUBT = 12.5
#: Sets that are held against as many others in one group, at most.
BLOCK = 1024
#: and of so many shingles in all, about.
BLOCK_SHINGLES = 2_000_000
_U = np.uint64
_CHUNK = 2048  # shingles that meet all hashes at once


def seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and odd factor of each register's hash."""
    rng = np.random.default_rng(12)
    return rng.integers(0, 2**63, registers, dtype=_U) * _U(2), rng.integers(0, 2**63, registers, dtype=_U) * _U(2) + _U(1)


def sketch(shingles: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    if not len(shingles):
        return np.zeros(registers, np.uint16)
    offsets, factors = seeds(registers) if registers != BANDS * ROWS else _SEEDS
    least = np.full(registers, 2**64 - 1, _U)
    for i in range(0, len(shingles), _CHUNK):
        values = shingles[i : i + _CHUNK, None] ^ offsets
        values *= factors
        values ^= values >> _U(32)
        values *= _U(0xD6E8FEB86659FD93)
        np.minimum(least, values.min(axis=0), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


_SEEDS = seeds(BANDS * ROWS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, share: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of Jaccard similarity ``j``: ``share`` is the first set's part of both sizes' sum, the rest counts registers."""
    greater = lambda x: -np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = greater(share - (1 - share) * j), greater(1 - share - share * j)
    return sum(n * np.log(np.maximum(p, 1e-12)) for n, p in ((above, up), (below, down), (equal, 1 - up - down)))


def estimate(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood (it is concave: by thirds), given the set sizes."""
    share = n_a / (n_a + n_b)
    low, high = np.zeros(len(n_a)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(32):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        rising = log_likelihood(one, share, above, below, equal) < log_likelihood(two, share, above, below, equal)
        low, high = np.where(rising, one, low), np.where(rising, high, two)
    return (low + high) / 2


def plausible(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, percent: int) -> np.ndarray:
    """Whether a link at ``percent`` can't be ruled out by sizes and registers; ``above``, ``below`` count of BANDS * ROWS."""
    fit = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    a, b, up, down = (x[fit].astype(np.float64) for x in (n_a, n_b, above, below))
    equal, at = BANDS * ROWS - up - down, percent / 100
    best = estimate(a, b, up, down, equal)
    share = a / (a + b)
    ahead = log_likelihood(best, share, up, down, equal) - log_likelihood(np.full(len(a), at), share, up, down, equal)
    fit[fit] = (best >= at) | (ahead <= DOUBT)
    return fit


def registers_of(column: pa.Array) -> np.ndarray:
    """Matrix of the registers in a binary Arrow column."""
    return binary_parts(column)[0].view(np.uint16).reshape(-1, BANDS * ROWS)


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """ROW, doc_id, n (set size), one, two (digests of the set), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sets = list(shingles_of(*binary_parts(batch.column(2)), words))
                one = np.array([mix(s.copy()).sum(dtype=_U) for s in sets], _U)
                two = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets], _U)
                kept = [sketch(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(kept, pa.binary())],
                    names=[ROW, "doc_id", "n", "one", "two", "registers"],
                )

    return rows.select(ROW, "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{ROW} long, doc_id long, n long, one long, two long, registers binary")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of each row of registers."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(_U)
    total = mix(np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(parts), 1)))
    for k in range(ROWS):
        total = mix(total + parts[:, :, k])
    return total


def buckets(sets: DataFrame) -> DataFrame:
    """bucket, set: a row for each band of each of ``sets`` (set, registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = band_keys(registers_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(total.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "set"])

    return sets.select("set", "registers").mapInArrow(run, "bucket long, set long")


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and registers don't rule out."""
    side = lambda c: sets.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = registers_of(batch.column("r_a")), registers_of(batch.column("r_b"))
            fit = plausible(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), (x > y).sum(axis=1), (x < y).sum(axis=1), percent)
            yield batch.select(["a", "b"]).filter(pa.array(fit))

    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets have a similarity of ``percent`` in a hundred or more."""
    text = lambda c, name: rows.select(F.col(ROW).alias(c), F.col("text").cast("binary").alias(name))
    both = pairs.join(text("a", "x"), "a").join(text("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(*(shingles_of(*binary_parts(batch.column(c)), words) for c in ("x", "y")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def candidates(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (x, y) of a group whose link isn't ruled out, the most equal registers first, and how many are equal.

    Only rows of different roots, the one in the group's first block and the other in its second; a pair that
    several buckets have is looked at in that of its first equal band only.
    """
    own, root, n = (group.column(c).to_numpy() for c in ("own", "root", "n"))
    kept = registers_of(group.column("registers"))
    i, j, bucket = (group.column(c)[0].as_py() for c in ("i", "j", "bucket"))
    band = int(np.flatnonzero(band_keys(kept[:1])[0].view(np.int64) == bucket)[0])
    ones, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
    m, p = BANDS * ROWS, percent / 100
    floor = m * p - 7 * np.sqrt(m * p * (1 - p))  # seven standard deviations below a link's
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, (1 << 22) // max(1, m * len(others)))
    for k in range(0, len(ones), step):
        x = ones[k : k + step]
        fit = (root[x][:, None] != root[others]) & (100 * np.minimum(n[x][:, None], n[others]) >= percent * np.maximum(n[x][:, None], n[others]))
        if i == j:
            fit &= x[:, None] < others
        at, to = np.nonzero(fit)
        for c in range(0, len(at), 1 << 14):
            one, two = x[at[c : c + (1 << 14)]], others[to[c : c + (1 << 14)]]
            same = kept[one] == kept[two]
            equal = same.sum(axis=1)
            near = np.flatnonzero(equal >= floor)
            near = near[same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            one, two, equal = one[near], two[near], equal[near]
            above = (kept[one] > kept[two]).sum(axis=1)
            good = plausible(n[one], n[two], above, m - equal - above, percent)
            found.append((one[good], two[good], equal[good]))
    one, two, equal = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-equal, kind="stable")
    return one[order], two[order], equal[order]


def group_links(group: pa.Table, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between a group's rows, compared on full sets: a spanning forest, as pairs already joined need no look."""
    one, two, _ = candidates(group, percent)
    sets = list(shingles_of(*binary_parts(group.column("text")), words))
    parent = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
    first = np.unique(parent, return_index=True)[1]
    up, a, b = np.arange(len(first)), [], []
    for x, y in zip(one.tolist(), two.tolist(), strict=True):
        p, q = find(up, int(parent[x])), find(up, int(parent[y]))
        if p != q:
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    of = group.column("set").to_numpy()
    return of[a], of[b]


def across(left: DataFrame, sets: DataFrame, rows: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between sets in one bucket of ``left`` (bucket, set, root) but of different roots.

    A bucket of more than ``block`` sets, or of more than BLOCK_SHINGLES shingles, is cut into blocks by the
    sets' hash, and each pair of blocks is a group: a set goes to as many groups as there are blocks.
    Registers say which sets have a candidate at all; only those meet with their texts.
    """
    sized = left.join(sets.select("set", "n"), "set")
    counts = sized.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    dealt = left.join(counts, "bucket").withColumn("own", own).select("bucket", "set", "root", "own", each.alias("e")).select("bucket", "e.i", "e.j", "own", "set", "root")
    keys, columns = ["bucket", "i", "j"], ["bucket", "i", "j", "own", "set", "root", "n", "registers"]
    named = lambda df: df.join(sets.select("set", "n", "registers"), "set")
    together = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "set")

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("bucket", "i", "j")):
            one, two, _ = candidates(group, percent)
            if len(one):
                yield from group.select(columns[:6]).take(pa.array(np.union1d(one, two))).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("bucket", "i", "j")):
            a, b = group_links(group, words, percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    some = materialize(together(named(dealt).select(columns)).mapInArrow(busy, "bucket long, i int, j int, own int, set long, root long"), "candidates")
    texts = rows.select(F.col(ROW).alias("set"), F.col("text").cast("binary").alias("text"))
    return together(named(some).join(texts, "set").select(*columns, "text")).mapInArrow(link, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` (longs or ints, not null), of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for start, end in zip(np.append(0, cuts).tolist(), np.append(cuts, batch.num_rows).tolist(), strict=True):
            key = tuple(values[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def links(sets: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all of ``sets`` (set, n, registers) alike by ``percent``; ``set`` is the ROW of a text in ``rows``."""
    keyed = buckets(sets)
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("set").alias("head")).where("size > 1")
    shared = materialize(keyed.join(shared, "bucket"), "buckets")
    first = shared.where("head != set").select(F.col("head").alias("a"), F.col("set").alias("b")).distinct()
    found = materialize(verified(materialize(screened(first, sets, percent), "pairs"), rows, words, percent), "links")
    # the heads are done with; of the rest, buckets whose sets are in one component are as well
    placed = shared.where("size > 2 AND head != set").join(components(found).withColumnRenamed("node", "set"), "set", "left").select("bucket", "set", F.coalesce("root", "set").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    left = materialize(placed.join(open_, "bucket", "left_semi"), "open-buckets")
    return found.unionByName(across(left, sets, rows, words, percent, block))


def grouped(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """ROW, doc_id, n, root for each of ``rows`` (ROW, doc_id, text): rows with one root are a component; no root: the empty set."""
    made = materialize(sketches(rows, words), "sketches")
    sets = materialize(made.where("n > 0").groupBy("one", "two", "n").agg(F.min(ROW).alias("set")), "sets")
    full = materialize(made.join(sets.select(F.col("set").alias(ROW)), ROW, "left_semi").select(F.col(ROW).alias("set"), "n", "registers"), "distinct-sets")
    joined = components(materialize(links(full, rows, words, percent, block), "links"))
    roots = sets.join(joined.withColumnRenamed("node", "set"), "set", "left").select("one", "two", "n", F.coalesce("root", "set").alias("root"))
    return made.select(ROW, "doc_id", "n", "one", "two").join(materialize(roots, "roots"), ["one", "two", "n"], "left").select(ROW, "doc_id", "n", "root")


def cluster(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """ROW, doc_id, n_shingles, component_id (least doc_id that links reach), kept, for each of ``rows`` (ROW, doc_id, text)."""
    placed = materialize(grouped(rows, words, percent, block), "components")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = placed.join(least, "root", "left").select(ROW, "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
