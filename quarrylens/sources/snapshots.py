"""Builds of a repository as two tables: what each build was, and the size and signal bits of its files.

A build has a number. Its files are written first and its own row last, so that a build without a row
is one that did not get that far, and the next one takes its number and its place. Which build another one is
compared with, and the census of all builds, are queries over the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds

BUILDS = "build long, root string, keying string, head string, head_t double, generated string, totals map<string,long>"
FILES = "build long, key string, loc long, bits long"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no build has been written yet
        return spark.createDataFrame([], schema)


def builds(spark: SparkSession, out: str) -> DataFrame:
    return _rows(spark, f"{out}/builds", BUILDS)


def files_of(spark: SparkSession, out: str, build: int) -> DataFrame:
    """key, loc, bits of the files of a build."""
    return _rows(spark, f"{out}/files", FILES).where(F.col("build") == build).select("key", "loc", "bits")


def comparable(rows: DataFrame, root: str, keying: str) -> DataFrame:
    """The builds of this root whose files have keys of the same kind."""
    return rows.where(F.col("root").eqNullSafe(F.lit(root)) & F.col("keying").eqNullSafe(F.lit(keying)))


def append(spark: SparkSession, out: str, row: dict, files: DataFrame) -> int:
    """Adds a build: row has root, keying, head, head_t, generated and totals, files has key, loc and bits. Returns its number."""
    number = (builds(spark, out).agg(F.max("build")).first()[0] or 0) + 1
    files.select("key", "loc", "bits").write.mode("overwrite").parquet(f"{out}/files/build={number}")
    one = spark.createDataFrame([row], BUILDS.split(", ", 1)[1])
    one.coalesce(1).write.mode("overwrite").parquet(f"{out}/builds/build={number}")
    return number


def baseline(rows: DataFrame, root: str, keying: str, head: str | None) -> DataFrame:
    """The build that one at head is compared with: the latest of another commit, or else the latest; no row if there is none."""
    again = F.lit(bool(head)) & F.col("head").eqNullSafe(F.lit(head))
    return comparable(rows, root, keying).orderBy(again, F.desc("build")).limit(1)


def census(rows: DataFrame, root: str, keying: str, th: Thresholds = DEFAULT) -> DataFrame:
    """head, head_t, generated, totals of the last commits that were built, each as its latest build saw it; builds of no known commit stand for themselves."""
    of = comparable(rows, root, keying).withColumn("head", F.substring(F.coalesce("head", F.lit("")), 1, 12))
    one = F.when(F.col("head") == "", F.col("build").cast("string")).otherwise(F.concat(F.lit("commit "), "head"))
    latest = of.groupBy(one.alias("_of")).agg(*[F.max_by(c, "build").alias(c) for c in ("head", "head_t", "generated", "totals")]).drop("_of")
    return latest.orderBy(F.desc("head_t"), F.desc("generated")).limit(th.census)
