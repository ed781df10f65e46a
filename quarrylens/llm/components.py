"""Connected components of an undirected edge table, without collecting it.

All nodes of one label take the least label around any of them (hooking), then the label of that label (pointer
jumping), until nothing changes; the rounds grow with the logarithm of the longest
chain. Each round is written out, so a lost executor costs one round.

Hubs, nodes with very many edges and labels of very many nodes, do not meet their rows in one
task. A key that has more than one task's even share of the rows is looked up in a broadcast table
and its rows are dealt out at random. There are fewer such keys than tasks, whatever the size of the graph, so
the driver may hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stored, stored_at


def valued(rows: DataFrame, key: str, spread: str, table: DataFrame, value: str, hubs: list[int]) -> DataFrame:
    """rows with the value that table (key, value) has for each key, null if none; rows of hubs are dealt out by spread."""
    if not hubs:
        return rows.join(table, key, "left")
    spark = rows.sparkSession
    few = table.where(F.col(key).isin(hubs)).select(key, value).collect()
    known = spark.createDataFrame([tuple(r) for r in few], f"{key} long, _known long").coalesce(1)
    salted = rows.join(F.broadcast(known), key, "left").withColumn("_salt", F.when(F.col("_known").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(partitions(spark))) + 1).otherwise(0))
    met = salted.join(table.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    return met.withColumn(value, F.coalesce("_known", value)).drop("_known", "_salt")


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """node, label, with each label that is a node of further (node, label) replaced by the one it has there."""
    n, share = labels.count(), partitions(labels.sparkSession)
    hubs = [r["label"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > max(1, n // share)).select("label").collect()]
    table = further.select(F.col("node").alias("label"), F.col("label").alias("_further"))
    return valued(labels, "label", "node", table, "_further", hubs).select("node", F.coalesce("_further", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """a, b (long) -> node, label: the least node that node reaches. Nodes without edges are absent."""
    spark = edges.sparkSession
    tasks = partitions(spark)
    pairs = edges.where("a <> b").select("a", "b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct())
    labels, at = stored_at(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("degree")).withColumnRenamed("a", "node"))
    nodes, ends = labels.agg(F.count("*"), F.sum("degree")).first()
    centres = [r["node"] for r in labels.where(F.col("degree") > max(1, (ends or 0) // tasks)).select("node").collect()]
    while True:
        around = valued(both, "b", "a", labels.select(F.col("node").alias("b"), "label"), "label", centres)
        around = around.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer, nearer_at = stored_at(labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near")))
        each, each_at = stored_at(nearer.groupBy("old").agg(F.min("near").alias("best"), F.count("*").alias("n")))
        discard(spark, at)
        if each.where("best <> old").isEmpty():
            return nearer.select("node", F.col("old").alias("label"))
        many = F.col("n") > max(1, nodes // tasks)
        old_hubs = [r["old"] for r in each.where(many).select("old").collect()]
        best_hubs = [r["best"] for r in each.groupBy("best").agg(F.sum("n").alias("n")).where(many).select("best").collect()]
        moved, moved_at = stored_at(valued(nearer.select("node", "old"), "old", "node", each.select("old", "best"), "best", old_hubs).select("node", "best"))
        further = moved.select(F.col("node").alias("best"), F.col("best").alias("label"))
        labels, at = stored_at(valued(moved, "best", "node", further, "label", best_hubs).select("node", "label"))
        for path in (nearer_at, each_at, moved_at):
            discard(spark, path)
