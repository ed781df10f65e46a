"""Columns that size and rank files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut


def height(language: Column, loc: Column, rows: Column, is_binary: Column) -> Column:
    root = lambda c: F.sqrt(F.greatest(F.lit(0), c).cast("double"))
    return F.when(is_binary, 0.0).when(rows.isNotNull(), 4.0 + 1.10 * root(rows)).when(language == "markdown", 3.0 + 1.30 * root(loc)).otherwise(6.0 + 3.20 * root(loc))


def weight(loc: Column, rows: Column, size: Column, is_binary: Column) -> Column:
    return F.greatest(F.lit(1.0), F.when(rows.isNotNull(), F.sqrt(rows.cast("double")) * 6.0).when(is_binary, F.log2(F.greatest(F.lit(1), size).cast("double")) * 1.5).otherwise(loc.cast("double")))


def archetype(language: Column, rows: Column, is_binary: Column, is_test: Column, is_doc: Column, is_ruin: Column) -> Column:
    """What a file is, in order of rule; 'pending' code is ranked by height."""
    return F.when(is_ruin, "ruin").when(is_test, "park").when(is_binary, "monument").when(rows.isNotNull(), "silo").when(is_doc & (language == "markdown"), "town_hall").when(language == "markdown", "warehouse").otherwise("pending")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def bitmask(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)])


BINS = 64


def with_upto(counts: DataFrame, value: str) -> DataFrame:
    """value, count (each value once) -> also upto, the sum of the counts of all values up to this one, and total.

    Values are dealt into ``BINS`` ranges of about as many values each; sums run inside a range, and over the ranges,
    so that no task sees all values however many there are. The counts are read three times, so they are cut first.
    """
    counts = cut(counts)
    number = F.col(value).cast("double")
    bounds = counts.agg(F.percentile_approx(number, [i / BINS for i in range(1, BINS)], 1000).alias("_bounds"))
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("_bin", F.size(F.filter("_bounds", lambda b: b < number))).drop("_bounds")
    bins = Window.partitionBy(F.lit(0))
    sums = placed.groupBy("_bin").agg(F.sum("count").alias("_s")).select("_bin", (F.sum("_s").over(bins.orderBy("_bin")) - F.col("_s")).alias("_lower"), F.sum("_s").over(bins).alias("total"))
    inside = F.sum("count").over(Window.partitionBy("_bin").orderBy(value))
    return placed.join(F.broadcast(sums), "_bin").withColumn("upto", F.col("_lower") + inside).drop("_bin", "_lower")


def cume_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile rank 0..1 of positive values, ties sharing the higher one; 0 for the others.

    Values are counted first, so that distinct values are ranked, not rows.
    """
    counts = with_upto(df.where(F.col(value) > 0).groupBy(value).count(), value)
    # What has no rank, often most rows, is spread over all tasks instead of meeting in that of its value.
    away = F.when(F.col(value) > 0, 0).otherwise(F.monotonically_increasing_id() % 1024 + 1)
    ranks = counts.select(value, F.lit(0).cast("long").alias("_away"), (F.col("upto") / F.col("total")).alias(out))
    return df.withColumn("_away", away).join(ranks, [value, "_away"], "left").withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_away")


def numbered(df: DataFrame, order: list[Column], out: str, counted: Column | None = None) -> DataFrame:
    """df with the number of each row in that order, from 1, and _total; counted: which rows are numbered, the others get the number of the last one before them.

    Rows are dealt into ranges of the whole order, ties and all, so that a value that most rows have is
    many ranges; numbers run inside a range, and are shifted by the rows of the ranges before, of which there are as many as tasks.
    """
    one = F.lit(1) if counted is None else F.coalesce(counted, F.lit(False)).cast("int")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(df.withColumn("_one", one).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    parts = Window.partitionBy(F.lit(0))
    before = ranges.groupBy("_range").agg(F.sum("_one").cast("long").alias("_n")).select("_range", (F.sum("_n").over(parts.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(parts).alias("_total"))
    nth = F.sum("_one").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_nth")).drop("_one", "_range", "_before", "_nth")


def row_rank(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Percentile rank 0..1 of positive values, ties in the order of tie; 0 for the others."""
    done = numbered(df, [F.col(value), F.col(tie)], "_place", F.col(value) > 0)
    return done.withColumn(out, F.when(F.col(value) > 0, F.col("_place") / F.col("_total")).otherwise(0.0)).drop("_place", "_total")


def placed_from_top(df: DataFrame, value: str, ties: list[Column], out: str) -> DataFrame:
    """df (without null values) with the place of each row from the largest value down, ties in their order."""
    return numbered(df.where(F.col(value).isNotNull()), [F.desc(value), *ties], out).drop("_total")


def doc_ratio(doc_lines: Column, loc: Column) -> Column:
    return F.least(F.lit(1.0), doc_lines / F.greatest(F.lit(1), loc))


def baseline_height(language: Column, loc: Column, loc_delta: Column, rows: Column, is_binary: Column, delta: Column, kind: Column) -> Column:
    """How high a file stood before it grew or shrank, from its lines then; null for others, binaries and monuments. Parks are a quarter as high."""
    then = F.greatest(F.lit(0), loc - loc_delta)
    tall = height(language, then, F.when(rows.isNotNull(), then), F.lit(False))
    return F.when(delta.isin("grown", "shrunk") & ~is_binary & (kind != "monument"), F.round(F.when(kind == "park", F.greatest(F.lit(2.0), tall * 0.25)).otherwise(tall), 2))


def main_sequence_band(zone: Column, distance: Column) -> Column:
    """What a folder's distance from the main sequence says."""
    return F.when(zone == "pain", "pain").when(zone == "uselessness", "uselessness").when(distance > 0.5, "far").when(distance >= 0, "near").otherwise("too few types")


def top_ranked(df: DataFrame, order: list[Column], limit: int, out: str = "rank") -> DataFrame:
    """The first limit rows in order, numbered from 1: a distributed top-k, then a small window."""
    return df.orderBy(*order).limit(limit).withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
