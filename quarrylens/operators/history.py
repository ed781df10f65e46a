"""What the commit log says about files, authors and the repository.

changes: commit_id, fid, added, deleted, one row per commit and file.
commits: commit_id, author, ts, subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import paths
from ..functions.measures import numbered
from ..sources.storage import dealt

DAY = 86400.0


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def log(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """changes with author, t (epoch seconds), subject, is_fix (never a revert), is_revert. Commits without changes are not in it."""
    told = commits.select("commit_id", "author", seconds(F.col("ts")).alias("t"), "subject", paths.is_revert(F.col("subject")).alias("is_revert"))
    told = told.withColumn("is_fix", paths.is_fix(F.col("subject")) & ~F.col("is_revert"))
    return changes.join(told, "commit_id")


def head(rows: DataFrame) -> DataFrame:
    """One row: head and tail, the newest and the oldest commit's time."""
    return rows.agg(F.max("t").alias("head"), F.min("t").alias("tail"))


def with_head(rows: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(head(rows)))


def file_history(rows: DataFrame) -> DataFrame:
    """Per file: counts, sums, first and last commit and who made them; ties go to the larger commit id."""
    newest, oldest = F.struct("t", "commit_id"), F.struct(-F.col("t"), F.col("commit_id"))
    return rows.groupBy("fid").agg(
        F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(F.col("added") + F.col("deleted")).alias("churn"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum(F.col("is_fix").cast("long")).alias("fixes"), F.sum(F.col("is_revert").cast("long")).alias("reverts"),
        F.max_by("author", oldest).alias("first_author"), F.max_by("author", newest).alias("last_author"), F.max_by("subject", newest).alias("last_subject"),
    )


def file_authors(rows: DataFrame) -> DataFrame:
    """fid, author, lines, last_t."""
    return rows.groupBy("fid", "author").agg(F.sum("added").alias("lines"), F.max("t").alias("last_t"))


def ownership(authors: DataFrame) -> DataFrame:
    """Per file: the author of most lines (ties: the later name), the share, how many authors, and the bus factor.

    The bus factor is the fewest authors who wrote half the lines.
    """
    w = Window.partitionBy("fid").orderBy(F.desc("lines"), F.desc("author"))
    ranked = authors.select("fid", "author", "lines", F.row_number().over(w).alias("n"), F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("lines").over(Window.partitionBy("fid")).alias("total"))
    return ranked.groupBy("fid").agg(
        F.max(F.when(F.col("n") == 1, F.col("author"))).alias("primary_author"), F.try_divide(F.max("lines"), F.max("total")).alias("share"), F.count("*").alias("authors"),
        F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("n"))).alias("bus_factor"),
    )


def author_totals(authors: DataFrame) -> DataFrame:
    return authors.groupBy("author").agg(F.sum("lines").alias("lines"), F.countDistinct("fid").alias("files"), F.max("last_t").alias("last_t"))


def activity(rows: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, bucket, commits: 30-day buckets back from the head; the last holds all that is older."""
    bucket = F.least(F.lit(th.buckets - 1), F.floor((F.col("head") - F.col("t")) / (th.bucket_days * DAY))).cast("int")
    return with_head(rows).groupBy("fid", bucket.alias("bucket")).agg(F.count("*").alias("commits"))


def author_buckets(rows: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, author, bucket, distinct; older commits are left out."""
    bucket = F.floor((F.col("head") - F.col("t")) / (th.bucket_days * DAY)).cast("int")
    return with_head(rows).select("fid", "author", bucket.alias("bucket")).where(F.col("bucket") < th.buckets).distinct()


def recent_churn(rows: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, heat: churn that halves every 30 days."""
    decayed = (F.col("added") + F.col("deleted")) * F.pow(F.lit(0.5), (F.col("head") - F.col("t")) / DAY / th.heat_half_life)
    return with_head(rows).groupBy("fid").agg(F.sum(decayed).alias("recent_churn"))


def trend(buckets: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, recent, before, trend: the last quarter against the one before it."""
    n = th.trend_buckets
    both = buckets.groupBy("fid").agg(F.sum(F.when(F.col("bucket") < n, F.col("commits")).otherwise(0)).alias("recent"), F.sum(F.when((F.col("bucket") >= n) & (F.col("bucket") < 2 * n), F.col("commits")).otherwise(0)).alias("before"))
    up = (F.col("recent") >= 2) & (F.col("recent") >= F.col("before") * 1.5 + 1)
    down = (F.col("before") >= 2) & (F.col("recent") * 2 <= F.col("before"))
    return both.withColumn("trend", F.when(up, 1).when(down, -1).otherwise(0))


def bulk_limit(files: int, th: Thresholds = DEFAULT) -> int:
    return max(th.bulk_min, min(int(files * th.bulk_fraction), th.bulk_cap))


def small_commits(changes: DataFrame, limit: int) -> DataFrame:
    """The changes of commits of two to limit files. Counted in a window, so that the changes are read and sorted once."""
    return changes.where(F.col("commit_id").isNotNull()).withColumn("_entries", F.count("*").over(Window.partitionBy("commit_id"))).where(F.col("_entries").between(2, limit)).drop("_entries")


def coupling(changes: DataFrame, limit: int, tasks: int | None = None) -> DataFrame:
    """a, b, n: how many commits of at most limit files changed both. tasks: how many the pairs are dealt to before they are counted.

    Large commits go by their counts before any files are gathered, so a commit is one array of limit files at most and gives
    limit * (limit - 1) / 2 pairs, without joining the table with itself.
    """
    lists = small_commits(changes, limit).groupBy("commit_id").agg(F.array_sort(F.collect_set("fid")).alias("fids")).select("fids")
    pairs = F.flatten(F.transform("fids", lambda x, i: F.transform(F.slice("fids", i + 2, F.size("fids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return dealt(lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b"), tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def repo_stats(rows: DataFrame, limit: int) -> DataFrame:
    """One row on the whole history; active dates are calendar dates."""
    each = rows.groupBy("commit_id").agg(F.count("*").alias("entries"), F.first("t").alias("t"), F.first("author").alias("author"), F.first("is_fix").alias("is_fix"), F.first("is_revert").alias("is_revert"))
    fits = F.col("entries") <= limit
    return each.agg(
        F.count("*").alias("commits"), F.sum((~fits).cast("long")).alias("bulk"), F.sum(fits.cast("long")).alias("eligible"), F.max(F.when(fits, F.col("entries"))).alias("max_eligible"),
        F.countDistinct(F.floor(F.col("t") / DAY)).alias("active_dates"), F.sum(F.col("is_fix").cast("long")).alias("fixes"), F.sum(F.col("is_revert").cast("long")).alias("reverts"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct("author").alias("authors"),
    )


def flags(stats: DataFrame, history: DataFrame, couplings: DataFrame) -> DataFrame:
    """One row: which signals mean something in this history."""
    born = history.agg(F.countDistinct(F.floor(F.col("first_t") / DAY)).alias("births"))
    pairs = couplings.agg(F.count("*").alias("pairs"))
    return stats.crossJoin(born).crossJoin(pairs).select(
        (F.col("authors") >= 2).alias("authorship"), (F.col("active_dates") >= 3).alias("recency"), ((F.col("commits") >= 5) & (F.col("max_eligible") >= 2)).alias("churn"),
        (F.col("pairs") > 0).alias("coupling"), (F.col("births") >= 2).alias("age"), (F.col("fixes") >= 1).alias("defects"),
    )


def eras(history: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, age_days, is_new, era: thirds of the files by age, ties by fid."""
    ends = history.agg(F.max("last_t").alias("head"), F.min("first_t").alias("tail"), F.count("*").alias("n"))
    aged = history.crossJoin(F.broadcast(ends)).withColumn("age_days", F.greatest(F.lit(0.0), (F.col("head") - F.col("first_t")) / DAY))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    placed = numbered(aged, [F.col("age_days"), F.col("fid")], "nth").withColumn("place", F.col("nth") - 1)
    window = F.greatest(F.lit(th.new_days), (F.col("head") - F.col("tail")) / DAY * th.new_fraction)
    return placed.select("fid", "age_days", (F.col("age_days") <= window).alias("is_new"), F.when(F.col("place") < third, "new").when(F.col("place") < 2 * third, "mid").otherwise("old").alias("era"))
