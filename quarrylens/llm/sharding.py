"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0..N-1 without a global sort: rows alike in doc_id, size and checksum are
counted first, inside each partition and then over all; such groups fall into hash buckets, whose
sums are added up over the buckets; a group's rows follow those of the groups before
it in its bucket. A keyed permutation of 0..N-1 turns the number into a place
in a reproducible shuffle; shard and slot follow from the place by arithmetic
alone, so shard sizes differ by one row at most and slots have no gaps.

The numbering depends on the rows only, not on files or partitions. Buckets are
made of ``bucket_rows`` rows on average, and their table is broadcast: it has
N / bucket_rows rows, one for every ten thousand or so. Beyond ``BROADCAST_BUCKETS``
of them (1.6 MB) it is joined by a shuffle. Should a group have more rows than ``SPREAD``, groups
are dealt out in stretches of that many before they become rows again.

Defined results: a null text has size 1 (no bytes plus one) and the checksum of
the empty text; rows alike in everything get different slots; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .feistel import fast_round, permute_below

BROADCAST_BUCKETS = 100_000
SPREAD = 100_000


def sums_before(counts: DataFrame, n: int) -> DataFrame:
    """_bucket, _n -> _bucket, _start: the sum of _n over all smaller buckets, of n.

    In two levels, so that no task sees more than the square root of n rows at a time.
    """
    before = lambda by: F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunked = counts.withColumn("_chunk", F.floor(F.col("_bucket") / max(1, int(n**0.5))))
    chunks = chunked.groupBy("_chunk").agg(F.sum("_n").alias("_n"))
    chunks = chunks.select("_chunk", before(Window.partitionBy(F.lit(0)).orderBy("_chunk")).alias("_above"))
    inside = chunked.withColumn("_in", before(Window.partitionBy("_chunk").orderBy("_bucket")))
    return inside.join(chunks, "_chunk").select("_bucket", (F.col("_above") + F.col("_in")).alias("_start"))


def sharded(docs: DataFrame, shards: int = 8, key: int = 20240229, bucket_rows: int = 10_000) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    groups = checkpoint(rows.groupBy(*same).agg(F.count("*").alias("_n")))
    total, most = groups.agg(F.sum("_n"), F.max("_n")).first()
    total = total or 0
    buckets = max(1, -(-total // bucket_rows))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*same), F.lit(buckets)))
    starts = sums_before(groups.groupBy("_bucket").agg(F.sum("_n").alias("_n")), buckets)
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    earlier = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*same).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    numbered = groups.withColumn("_earlier", earlier).join(starts, "_bucket").select(*same, (F.col("_start") + F.col("_earlier")).alias("_first"), "_n")
    if (most or 0) > SPREAD:
        numbered = numbered.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(SPREAD).cast("long"))))
        numbered = numbered.select(*same, (F.col("_first") + F.col("_at")).alias("_first"), F.least(F.col("_n") - F.col("_at"), F.lit(SPREAD)).alias("_n")).repartition("_first")
    each = numbered.select(*same, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("_number"))
    each = each.withColumn("_place", permute_below(F.col("_number"), max(1, total), fast_round(key)))
    return each.select(
        *same, F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
