"""The activity histogram and running totals over a stream of events (an extension: the batch operators are the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "1 day", width: str = "30 days") -> DataFrame:
    """ts, path, author -> path, start, commits, authors per tumbling window; late rows count until the watermark passes."""
    marked = events.withWatermark("ts", late)
    sums = marked.groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("commits"), F.approx_count_distinct("author").alias("authors"))
    return sums.select("path", F.col("w.start").alias("start"), "commits", "authors")


def totals(events: DataFrame) -> DataFrame:
    """path, author -> commits, lines and last time so far."""
    return events.groupBy("path", "author").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"), F.max("ts").alias("last_ts"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete"):
    """Takes all that is there, leaves the result so far as Parquet at out, then stops; progress is kept in checkpoint. Both lie in a shared folder."""
    return stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
