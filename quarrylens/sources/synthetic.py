"""A synthetic repository of any size: files, commits and changes from arithmetic on their numbers, generated by the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages in turn, top folders, authors.
KINDS = ((".py", "python"), (".js", "javascript"), (".ts", "typescript"), (".go", "go"), (".md", "markdown"))
TOPS = ("core", "api", "web", "jobs", "lib", "tools", "docs", "tests")
AUTHORS = ("ada", "grace", "linus")


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def files(spark: SparkSession, count: int, folders: int, seed: int = 1234) -> DataFrame:
    i = F.col("id")
    folder = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(max(1, folders)))
    rel = F.concat(_pick(TOPS, folder), F.lit("/pkg"), folder.cast("string"), F.lit("/mod"), i.cast("string"), _pick([k for k, _ in KINDS], i))
    return spark.range(count).select(i.alias("fid"), rel.alias("rel"), _pick([v for _, v in KINDS], i).alias("language"), (F.pmod(F.xxhash64(F.lit(seed + 1), i), F.lit(400)) + 5).alias("loc"))


def commits(spark: SparkSession, count: int, seed: int = 1234) -> DataFrame:
    i = F.col("id")
    return spark.range(count).select(i.alias("commit_id"), _pick(AUTHORS, i).alias("author"), F.timestamp_seconds(F.lit(1_700_000_000) - i * 86_400).alias("ts"), F.when(i % 5 == 0, "fix: edge case").otherwise("update").alias("subject"))


def changes(spark: SparkSession, n_files: int, n_commits: int, width: int = 6, seed: int = 1234) -> DataFrame:
    """The oldest commit adds everything; each other one touches a few files."""
    bulk = spark.range(n_files).select(F.lit(n_commits - 1).cast("long").alias("commit_id"), F.col("id").alias("fid"), F.lit(20).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    few = spark.range((n_commits - 1) * width).select(F.floor(F.col("id") / width).alias("commit_id"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_files)).alias("fid"), F.lit(3).cast("long").alias("added"), F.lit(1).cast("long").alias("deleted"))
    return bulk.unionByName(few.groupBy("commit_id", "fid").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")))
