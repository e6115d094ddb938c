"""What the near-duplicate operators share: shingle sets, and components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, distinct, materialize, slices, word_units


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def shingles_of(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case; a shorter text is one shingle of all its words."""
    for i, j in slices(offsets):
        own = raw[offsets[i] : offsets[j]]
        own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
        values, at, _, _ = word_units(own, offsets[i : j + 1])
        rolling = Rolling(values)
        grams = rolling.grams(words)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield distinct(grams[a : b - words + 1])
            else:
                yield rolling.spans(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges(a, b)``: root is the least node of the component.

    Alternates two steps, each a grouped minimum: every node points its larger neighbours at
    its least one, then every node its smaller neighbours.  Ends when nothing changes.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        sides = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = sides.join(least, sides["a"] == least["n"])
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("n != m").select(F.col("n").alias("a"), F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    current = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        state = current.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state["n"] == 0:
            break
        following = materialize(star(star(current, True), False), "links")
        now = following.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        current = following
        if (now["n"], now["x"]) == (state["n"], state["x"]):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
