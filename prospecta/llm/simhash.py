"""SimHash near-deduplication over a vantage-point tree.

Fingerprints are 64-bit SimHashes of word shingles.  Distinct fingerprints are split by a
vantage-point tree: each node holds a fingerprint and a radius, near ones go left, far
ones right.  By the triangle bound, a fingerprint's partners within ``bits`` lie on the
other side only if its own distance is within ``bits`` of the radius; only then it is sent
there as a query.  So every shard can answer all pairs of the fingerprints it owns.
Inside a shard the same tree goes on down to small leaves, which are compared in blocks.

The upper tree is made from a bounded sample of fingerprints (SAMPLE, spread by hash); the
sample only shapes the tree, every fingerprint is indexed and every linked pair is found.
Shards report each fingerprint's link to its group's smallest member (a spanning forest),
never all pairs of a group.  Components of the union of the forests are found by repeated
minimum propagation over stars, written to the shared folder at each step.

Cases: null text counts as empty; no word: fingerprint zero, linked like any other.  Fewer
words than a shingle: the whole sequence is the one shingle.  Repeated rows share
fingerprint and component.  Null doc_ids are ignored in the smallest id unless a component
has no other.  ``deduplicate`` decides by row: exactly one row of each component stays,
whatever ids are null or repeated.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, number_rows
from .links import components, find
from .setsketch import grouped, verified

WORDS, BITS, SEED = 3, 2, 42
#: Fingerprints that shape the upper tree, at most.
SAMPLE = 8192
#: Distinct fingerprints that a shard owns, about.
SHARD = 60_000
#: Levels of the upper tree, at most: its nodes are sent to all tasks.
MOST_LEVELS = 14
#: Of ``deduplicate``: the least Jaccard similarity of a link, in a hundred.
LIKENESS = 80
_LAST = 2**63 - 1


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of a text: bit i is 1 where it is set in over half of the shingles' XXH64."""
    tokens = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), seed)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))  # noqa: B905
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``key`` (a long) and its text's fingerprint as a signed long ``fp``; a key other than doc_id goes before it."""
    keys = list(dict.fromkeys([key, "doc_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py() or b"", words, seed) for t in batch.column(len(keys))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(prints.view(np.int64))], names=[*keys, "fp"])

    return docs.select(*keys, F.col("text").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, levels: int) -> list[tuple[np.uint64, int] | None]:
    """Complete binary tree as a list: node i has children 2i+1 and 2i+2; each is (vantage point, radius)."""
    nodes: list[tuple[np.uint64, int] | None] = [None] * (2**levels - 1)
    members = {0: sample}
    for i in range(len(nodes)):
        own = members.pop(i, sample[:0])
        if len(own) < 2:
            nodes[i] = (np.uint64(0), 64)  # all go left
            members[2 * i + 1], members[2 * i + 2] = own, own[:0]
            continue
        vantage = own[0]
        away = distance(own, vantage)
        radius = int(np.median(away))
        nodes[i] = (vantage, radius)
        members[2 * i + 1], members[2 * i + 2] = own[away <= radius], own[away > radius]
    return nodes


def route(prints: np.ndarray, nodes: list, levels: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index, shard, own): each fingerprint once as its shard's own, and as a query where a partner may lie."""
    index, node, own = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    points = np.array([n[0] for n in nodes], np.uint64)
    radii = np.array([n[1] for n in nodes], np.int64)
    for _ in range(levels):
        away, radius = distance(prints[index], points[node]).astype(np.int64), radii[node]
        left = away <= radius
        other = np.where(left, away + bits > radius, away - bits <= radius)
        index, own = np.concatenate([index, index[other]]), np.concatenate([own, np.zeros(int(other.sum()), bool)])
        node = np.concatenate([2 * node + np.where(left, 1, 2), 2 * node[other] + np.where(left[other], 2, 1)])
    return index, node, own


def shard_forest(prints: np.ndarray, own: np.ndarray, bits: int, leaf: int = 192) -> np.ndarray:
    """For each fingerprint, the index of its group's first member in the links that this shard finds."""
    parent = np.arange(len(prints))
    todo = [(np.flatnonzero(own), np.flatnonzero(~own), 0)]
    while todo:
        mine, asks, depth = todo.pop()
        if len(mine) <= leaf or depth > 40:
            for i in range(0, len(mine), leaf):
                block = mine[i : i + leaf]
                for others in (mine[i:], asks):
                    for j in range(0, len(others), 4096):
                        part = others[j : j + 4096]
                        a, b = np.nonzero(distance(prints[block][:, None], prints[part][None, :]) <= bits)
                        apart = block[a] != part[b]
                        for x, y in zip(block[a[apart]].tolist(), part[b[apart]].tolist(), strict=True):
                            x, y = find(parent, x), find(parent, y)
                            if x != y:
                                parent[max(x, y)] = min(x, y)
            continue
        vantage = prints[mine[len(mine) // 2]]
        away, asked = distance(prints[mine], vantage).astype(np.int64), distance(prints[asks], vantage).astype(np.int64)
        radius = int(np.median(away))
        if away.max() <= radius:
            radius -= 1
        near = away <= radius
        # own pairs across the border are found once: near members ask the far side
        todo.append((mine[near], asks[asked - bits <= radius], depth + 1))
        todo.append((mine[~near], np.concatenate([asks[asked + bits > radius], mine[near & (away + bits > radius)]]), depth + 1))
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def linked(prints: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b), a > b in unsigned order of discovery, that connect fingerprints within ``bits``; ``prints`` has distinct ``fp``."""
    spark = prints.sparkSession
    n = prints.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    if levels:
        sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy().view(np.uint64)
        nodes = spark.sparkContext.broadcast(build_tree(sample, levels))
    else:
        nodes = spark.sparkContext.broadcast([])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            index, node, mine = route(own, nodes.value, levels, bits)
            for i in range(0, len(index), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(node[j].astype(np.int32)), pa.array(own[index[j]].view(np.int64)), pa.array(mine[j])], names=["shard", "fp", "own"])

    def answer(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        all_prints = table.column("fp").to_numpy().view(np.uint64)
        top = shard_forest(all_prints, own, bits)
        inner = np.flatnonzero(top != np.arange(len(top)))
        signed = all_prints.view(np.int64)
        return pa.table({"a": signed[inner], "b": signed[top[inner]]})

    return prints.select("fp").mapInArrow(send, "shard int, fp long, own boolean").groupBy("shard").applyInArrow(answer, "a long, b long")


def first_of_component(prints: DataFrame, order: Column, bits: int, shard: int) -> DataFrame:
    """fp and the least ``order`` of all rows of ``prints`` reachable over links of ``bits`` bits or fewer, as ``least``."""
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    groups = components(linked(materialize(firsts.select("fp"), "distinct"), bits, shard))
    placed = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return materialize(placed.join(least, "root").select("fp", "least"), "components")


def cluster(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of ``bits`` bits or fewer."""
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    named = first_of_component(prints, F.col("doc_id"), bits, shard)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5, bits: int = BITS, likeness: int = LIKENESS, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """Of each group one row of ``docs``, all columns: that of the smallest doc_id, null ids last.

    Rows are linked by a Jaccard similarity of ``likeness`` in a hundred or more of their sets of
    ``words``-word shingles.  Candidates are rows of equal fingerprints and those within ``bits`` bits, by the tree's
    forest, which are compared on full sets: among texts with much in common, two bits also come between unlike
    ones.  At 0.8 fingerprints of 64 bits differ in some ten, where distances no longer prune a tree; those links
    come from ``setsketch.grouped``.
    """
    rows = number_rows(docs.select(F.struct("*").alias("own")))
    texts = rows.select(ROW, "own.doc_id", "own.text")
    prints = materialize(fingerprints(texts, words, seed, ROW), "fingerprints")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col(ROW))
    firsts = materialize(prints.groupBy("fp").agg(F.min(ROW).alias("first")), "distinct")
    place = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"row_{c}"))
    same = prints.join(firsts, "fp").select(F.col("first").alias("a"), F.col(ROW).alias("b")).where("a != b")
    close = linked(firsts.select("fp"), bits, shard).join(place("a"), "a").join(place("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    near = verified(materialize(same.unionByName(close), "near"), texts, words, likeness)
    alike = grouped(texts, words, likeness).select(F.col("root").alias("a"), F.col(ROW).alias("b")).where("a != b")
    groups = components(materialize(near.unionByName(alike), "near"))
    placed = groups.join(prints, groups["node"] == prints[ROW]).select("root", order.alias("order"))
    least = placed.groupBy("root").agg(F.min("order").alias("first"))
    gone = placed.join(least, "root").where(F.col(f"order.{ROW}") != F.col(f"first.{ROW}")).select(F.col(f"order.{ROW}").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select("own.*")
