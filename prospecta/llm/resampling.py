"""Importance resampling towards a target set, by bags of hashed word n-grams.

Texts become position tables: one row for each word with its place, to which a window's
``lead`` over the row's places brings the words that follow, one for each order above 1.
A feature is a run of 1 to ``orders`` words joined by one space; it is counted in the bucket
of its CRC-32.  A bucket's gain is the log ratio of its smoothed shares in the target texts
and in the documents.  A document's weight is the floored mean of its features' gains; the
highest weights with Gumbel noise by the hash of doc_id are a draw without replacement.

Nothing is collected but one count for each partition of the sorted scores.  The table of
gains has ``buckets`` rows at most, which bounds its broadcast.  Words meet others of their
row only where ``orders`` is above 1; sums by row and by bucket are made before each shuffle,
so neither a frequent word nor a long text weighs on one task.  Ranks come from a range sort
by (score, doc_id, row), in which no value can fill a partition of its own.

Cases: null or wordless text has no features and weight 0.  Ties in score go to the smaller
doc_id, null ids last (their noise is that of the empty id), then to the earlier row.  Rows
that repeat an id or a text are scored each for themselves.  Without target texts all
gains come from the documents alone; without documents there are no rows.  Fewer than
``least_words`` words: never drawn, rank null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, materialize

#: What stands between words: all of ASCII but digits and letters, once A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_PARTITION = 33  # bits of monotonically_increasing_id that number the rows of a partition


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), NOT_WORD), "")


def position_table(rows: DataFrame, orders: int = ORDERS) -> DataFrame:
    """ROW, doc_id, at, gram_1 .. gram_n: the runs of words that begin at each place; null where the text ends before."""
    table = rows.select(ROW, "doc_id", F.posexplode_outer(words(F.col("text"))).alias("at", "gram_1"))
    if orders > 1:
        along = Window.partitionBy(ROW).orderBy("at")
        table = table.select("*", *[F.lead("gram_1", k).over(along).alias(f"_next_{k}") for k in range(1, orders)])
        for k in range(2, orders + 1):
            table = table.withColumn(f"gram_{k}", F.concat(f"gram_{k - 1}", F.lit(" "), f"_next_{k - 1}"))
    return table.select(ROW, "doc_id", "at", *[f"gram_{k}" for k in range(1, orders + 1)])


def features(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """ROW, doc_id, size, bucket: a row for each feature, and one with a null bucket for a text without any."""
    table = position_table(rows, orders)
    bucket = lambda c: (F.crc32(c) % buckets).cast("int")
    if orders == 1:
        return table.select(ROW, "doc_id", F.lit(1).alias("size"), bucket("gram_1").alias("bucket"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), bucket(f"gram_{k}").alias("bucket")) for k in range(1, orders + 1)]))
    # of a text without words, the one place has no gram of size 1: it stands for the text
    return table.select(ROW, "doc_id", each.alias("f")).select(ROW, "doc_id", "f.size", "f.bucket").where("bucket IS NOT NULL OR size = 1")


def bucket_gains(rows: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the bucket's share in ``target`` over that in ``rows``, one added to each bucket."""

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return features(texts, orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counted(rows, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0)
    both = materialize(both, "bucket-counts")  # read twice: for the sums and for the gains
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = lambda c, total: (F.col(c) + F.lit(1.0), F.col(total) + F.lit(float(buckets)))
    (t, all_t), (s, all_s) = share("t", "all_t"), share("s", "all_s")
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(t * all_s / (s * all_t))).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel) from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(rows: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """ROW, doc_id, n_features, n_words, weight, score of each row of ``rows`` (ROW, doc_id, text)."""
    gains = bucket_gains(rows, target, orders, buckets)
    joined = features(rows, orders, buckets).join(F.broadcast(gains), "bucket", "left")  # `buckets` rows at most
    sums = joined.groupBy(ROW, "doc_id").agg(
        F.count("bucket").alias("n_features"), F.count(F.when(F.col("size") == 1, F.col("bucket"))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (total - pmod(total, n_features)) DIV n_features END")
    return sums.select(ROW, "doc_id", "n_features", "n_words", mean.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 .. in ``order``, which tells all of them apart: a range sort, numbered within partitions."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", _IN_PARTITION)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a number for each partition of the sort
        starts.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    within = F.col("_at").bitwiseAND(F.lit(2**_IN_PARTITION - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", within + F.col("_before") + 1).drop("_at", "_part", "_before")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 .. of the drawn rows, null elsewhere."""
    scored = materialize(scored, "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(ROW)]
    first = ranked(fit, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(rows: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """ROW, doc_id, n_features, n_words, weight, score, rank for every row of ``rows``.

    ``rows`` and ``target`` have ROW (a number for each row) and text, ``rows`` doc_id also.
    """
    target = target.select(ROW, F.lit(None).cast("long").alias("doc_id"), "text")
    return draw(weigh(rows.select(ROW, "doc_id", "text"), target, orders, buckets, seed), least_words, percent)
