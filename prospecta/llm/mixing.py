"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``rate = target / source size`` times.  Within the
source the expected copies are prefix-summed in a fixed order, one random offset is
added, and a document is emitted once for each integer boundary its share crosses, i.e.
floor(rate * rank + offset) - floor(rate * (rank - 1) + offset) times.  The order goes by
size class (eight significant bits of the size), then by a hash of doc_id, so that each
class is sampled in proportion and a source's words come near its target.

Ranks are prefix sums in three levels, none of which gathers a source in one task: size
classes within a source, 4096 hash parts within a class, rows within a part.

Cases: null text has size 0; null sources are one source, ordered last.  An empty source
(size 0) has target 0 and no copies.  Repeated rows are ranked apart.  Rows with equal
doc_id, size and source are interchangeable.  Empty tables give empty results.  All
columns of the input are kept by ``sample``, also those named like results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX

#: A source's words are repeated so many times at most.
MOST = 3
#: Hexadecimal digits of a key's hash that tell a size class's parts apart.
PART_DIGITS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one for each source.

    Sources get shares of the total by weight; a target stops at ``most`` times its source's
    size and the excess is shared anew.  The level L (words per unit of weight) at which
    sum(min(weight * L, most * size)) is the total comes from running sums over the sources
    in the order in which they fill up, one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(fill), F.lit(0))  # words of the sources that fill up before this one
    used = F.coalesce(F.sum("weight").over(fill), F.lit(0))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - full) / (F.sum("weight").over(everything) - used))
    # the first source that doesn't fill up at its level sets the level of all after it
    level = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    return rows.withColumn("final", level).select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))).alias("target"))


def size_class(size: Column) -> Column:
    """The size with all but its eight most significant bits made 0."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - 8).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def with_copies(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Structs ``own``, a row of ``docs`` (doc_id, source, text or size), and ``mix``: size, source_size, target, copies."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
        "doc_id",
        # null sources: a flag and '' stand for them, so that joins and shuffles find them
        F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("source"),
        (words_in(F.col("text")) if "text" in docs.columns else F.col("size")).alias("size"),
        key.alias("key"),
    )
    sized = rows.withColumn("class", size_class(F.col("size"))).withColumn("part", F.substring("key", 1, PART_DIGITS))
    group = ["none", "source"]
    counted = sized.groupBy(*group, "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per_class = counted.groupBy(*group, "class").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    before_class = per_class.withColumn("class_before", F.sum("n").over(Window.partitionBy(*group).orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select(*group, "class", "class_before")
    part_before = F.sum("n").over(Window.partitionBy(*group, "class").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    per_source = per_class.groupBy(*group).agg(F.sum("size").alias("source_size")).select(F.when(~F.col("none"), F.col("source")).alias("source"), "source_size")
    goals = targets(per_source, weights, most).select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    before = counted.withColumn("part_before", part_before).join(before_class, [*group, "class"]).join(goals, group).select(*group, "class", "part", (F.col("class_before") + F.col("part_before")).alias("before"), "source_size", "target")
    row = F.row_number().over(Window.partitionBy(*group, "class", "part").orderBy("key", "doc_id", "size"))
    ranked = sized.withColumn("row", row).join(before, [*group, "class", "part"])
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("none").cast("string"), F.lit("|"), F.col("source"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rank = F.col("before") + F.col("row")
    copies = (F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("long")
    return ranked.select("own", F.struct("size", "source_size", "target", F.least(F.lit(most), copies).alias("copies")).alias("mix"))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each document."""
    light = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    return with_copies(light, seed, weights, most).select("own.doc_id", "mix.*", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def sample(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows of ``docs``: each document as often as it is drawn."""
    mixed = with_copies(docs, seed, weights, most).where("mix.copies > 0")
    return mixed.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select("own.*")
