"""Stored tables that are changed in part: keyed upserts, repairs that resume, sums kept by deltas, name postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name

PART = "part"
CELL = ("workspace_id", "postcode", "naf", "size_category")


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create_keyed(df: DataFrame, name: str, key: str, folder: str, parts: int = 64, buckets: int = 8) -> None:
    """A catalog table of ``df`` in ``folder``: folders by a hash of ``key``, in each of them buckets by ``key``."""
    df.withColumn(PART, _part(key, parts)).repartition(PART).write.option("path", folder).partitionBy(PART).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def upsert_plan(spark: SparkSession, name: str, batch: DataFrame, key: str, merge: Callable[[str, Column, Column], Column], parts: int = 64) -> DataFrame:
    """The rows of all folders that ``batch`` touches, after it; the stored side is read by its buckets and isn't shuffled."""
    stored = spark.table(name)
    batch = batch.withColumn("_in", F.lit(True))
    touched = sorted(r[0] for r in batch.select(_part(key, parts)).distinct().collect())  # `parts` numbers at most
    old, new = stored.where(F.col(PART).isin(touched)).withColumn("_kept", F.lit(True)).alias("old"), batch.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    out = [F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key)]
    for c in stored.columns:
        if c not in (key, PART):
            was, comes = F.col(f"old.{c}"), F.col(f"new.{c}")
            out.append(F.when(F.col("_kept").isNull(), comes).when(F.col("_in").isNull(), was).otherwise(merge(c, was, comes)).alias(c))
    rows = both.select(*out)
    return rows.withColumn(PART, _part(key, parts)).select(*stored.columns)


def upsert(spark: SparkSession, name: str, batch: DataFrame, key: str, merge: Callable[[str, Column, Column], Column], parts: int = 64) -> None:
    """Insert new keys of ``batch`` (one row for each key, not null) and merge known ones; only the folders it touches are written anew.

    ``merge(column, stored, incoming)`` gives a known key's new value.
    """
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        upsert_plan(spark, name, batch, key, merge, parts).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)
    spark.catalog.refreshTable(name)


def repair_ranges(rows: DataFrame, key: str, size: int, repair: Callable[[DataFrame], DataFrame], folder: str, most: int | None = None) -> int:
    """Repair ``rows`` range by range of the whole number ``key``; how many ranges are still to do.

    A range's rows are written to ``folder/rows/range=n``, then its line in ``folder/journal``;
    a run that ended anywhere goes on with the first range without a line, whose rows are
    written over.  The cut is that of the first run, kept in the journal.  ``most`` ends a run early.
    """
    spark = rows.sparkSession
    journal = "range long, low long, high long, done boolean"
    spark.createDataFrame([], journal).write.mode("ignore").parquet(f"{folder}/journal")
    known = {r["range"]: r for r in spark.read.schema(journal).parquet(f"{folder}/journal").collect()}  # a line for each range
    if not known:
        ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        if ends["low"] is None:
            return 0
        plan = [(n, low, min(low + size - 1, ends["high"]), False) for n, low in enumerate(range(ends["low"], ends["high"] + 1, size))]
        spark.createDataFrame(plan, journal).write.mode("append").parquet(f"{folder}/journal")
        known = {r[0]: dict(zip(("range", "low", "high", "done"), r, strict=True)) for r in plan}
    done = {r["range"] for r in spark.read.schema(journal).parquet(f"{folder}/journal").where("done").collect()}
    todo = [known[n] for n in sorted(known) if n not in done]
    for r in todo[:most]:
        repair(rows.where(F.col(key).between(r["low"], r["high"]))).write.mode("overwrite").parquet(f"{folder}/rows/range={r['range']}")
        spark.createDataFrame([(r["range"], r["low"], r["high"], True)], journal).write.mode("append").parquet(f"{folder}/journal")
    return len(todo) - len(todo[:most])


def coverage_after(matrix: DataFrame, before: DataFrame, after: DataFrame, companies: DataFrame) -> DataFrame:
    """The coverage matrix after some companies changed, without counting the others again.

    ``before`` and ``after`` are the changed companies as they were and are (new ones are in the
    second only, deleted ones in the first only); ``companies`` are all as they are now.  Counts are
    sums of signed deltas; a cell's last date is looked up again only where the
    cell lost its latest one and got none as late.  Cells without companies go.
    """
    score = F.col("quality_score")

    def signed(df: DataFrame, sign: int) -> DataFrame:
        dates = [F.lit(None).cast("date"), F.col("enriched_on")][:: 1 if sign > 0 else -1]
        return df.select(*CELL, F.lit(sign).alias("total"), F.when(score >= 90, sign).otherwise(0).alias("complete"), F.when(score.between(50, 89), sign).otherwise(0).alias("partial"), F.lit(None).cast("date").alias("held"), dates[0].alias("lost"), dates[1].alias("gained"))

    empty = F.lit(None).cast("date")
    parts = matrix.select(*CELL, "total", "complete", "partial", F.col("last_enriched").alias("held"), empty.alias("lost"), empty.alias("gained"))
    sums = parts.unionByName(signed(before, -1)).unionByName(signed(after, 1)).groupBy(*CELL)
    cells = sums.agg(*[F.sum(c).alias(c) for c in ("total", "complete", "partial")], *[F.max(c).alias(c) for c in ("held", "lost", "gained")]).where("total > 0")
    stale = F.coalesce((F.col("lost") >= F.col("held")) & (F.col("gained").isNull() | (F.col("gained") < F.col("held"))), F.lit(False))
    cells = cells.withColumn("stale", stale)
    open_ = cells.where("stale").select(*[F.col(c).alias(f"_{c}") for c in CELL])
    same = lambda left, right: [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in CELL]
    anew = companies.join(open_, same("", "_"), "left_semi").groupBy(*[F.col(c).alias(f"_{c}") for c in CELL]).agg(F.max("enriched_on").alias("anew"))
    joined = cells.join(anew, same("", "_"), "left")
    last = F.when(F.col("stale"), F.col("anew")).otherwise(F.greatest("held", "gained"))
    return joined.select(*CELL, "total", "complete", "partial", last.alias("last_enriched"), F.substring("postcode", 1, 2).alias("department"))


def _grams(name: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    return F.when(F.length(name) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: name.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def write_postings(rows: DataFrame, key: str, name: str, folder: str, parts: int = 32) -> None:
    """An inverted table of the normalised names' grams in folders by the gram's hash, the names themselves, and each gram's count."""
    names = rows.select(F.col(key).alias("id"), normalize_name(F.col(name)).alias("name"))
    names.write.parquet(f"{folder}/names")
    grams = names.select("id", "name", F.explode(_grams(F.col("name"))).alias("gram"))
    grams.withColumn(PART, _part("gram", parts)).repartition(PART).sortWithinPartitions("gram", "id").write.partitionBy(PART).parquet(f"{folder}/grams")
    grams.groupBy("gram").count().withColumn(PART, _part("gram", parts)).repartition(PART).sortWithinPartitions("gram").write.partitionBy(PART).parquet(f"{folder}/counts")


def search_postings(spark: SparkSession, folder: str, terms: list[str], rarest: int = 3, parts: int = 32) -> DataFrame:
    """Ids of the names that contain one of ``terms``, by the postings of each term's rarest grams, then a look at the name.

    A term of fewer than three characters is looked for in all names.
    """
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select(normalize_name(F.col("term")).alias("term"))
    asked = asked.select("term", F.transform(_grams(F.col("term")), lambda g: F.struct(g.alias("gram"), F.pmod(F.xxhash64(g), F.lit(parts)).cast("int").alias(PART))).alias("grams")).collect()  # the caller's terms
    found = None
    for term, grams in (tuple(r) for r in asked):
        if not term:
            continue
        contains = F.contains("name", F.lit(term))
        if grams:
            pick = lambda df, some: df.where(F.col(PART).isin(sorted({g[PART] for g in some})) & F.col("gram").isin([g["gram"] for g in some]))
            counts = {r["gram"]: r["count"] for r in pick(spark.read.parquet(f"{folder}/counts"), grams).collect()}  # a number for each gram of the term
            few = sorted(grams, key=lambda g: counts.get(g["gram"], 0))[:rarest]
            own = pick(spark.read.parquet(f"{folder}/grams"), few).where(contains).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(few)).select("id")
        else:
            own = spark.read.parquet(f"{folder}/names").where(contains).select("id")
        found = own if found is None else found.unionByName(own)
    return found.distinct() if found is not None else spark.createDataFrame([], "id long")
