"""Exact dedup: skew-safe combining of equal texts.

Texts are equal when identical after lower-casing A-Z. Three merges, each of
which groups by the digest *and* the whole normalised text, so that two texts
are never merged on the strength of a digest:

1. each input partition combines its own copies (the partial aggregate);
2. what is left meets by digest, text and a salt taken from the partition, so a
   text that fills a third of the table is spread over ``salts`` tasks;
3. the salt winners, at most ``salts`` rows a text, are combined.

Documents then learn their group's verdict by a join of thin rows on the digest.
Should two texts share a digest, which is checked on the groups, their documents
are joined by digest and text instead.

Defined results: a null text counts as empty; all empty texts are one group; a
null doc_id ranks below any other; of rows equal in text and doc_id one is kept;
an empty table gives an empty result; columns other than doc_id and text are
ignored by ``groups`` and carried unchanged by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint

SALTS = 32


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = docs.select(F.col("doc_id").alias("_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("_norm"))
    return norm.withColumn("_digest", digest(F.col("_norm")))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: _digest, _norm, _keep, _size."""
    local = _keyed(docs, digest).withColumn("_salt", F.spark_partition_id() % salts)
    salted = local.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    return salted.groupBy("_digest", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def verdicts(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups_ = groups(docs, digest, salts)
    by_digest = checkpoint(groups_.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.max("_size").alias("_size")))
    if by_digest.where("_texts > 1").isEmpty():
        keys, found = ["_digest"], by_digest
    else:
        keys, found = ["_digest", "_norm"], groups_
    rows = _keyed(docs, digest).groupBy(*keys, "_id").agg(F.count("*").alias("_times"))
    joined = rows.join(found.select(*keys, "_keep", "_size"), keys)
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_nth"))
    return each.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        (F.col("_digest") if digest is sha256 else F.sha2("_norm", 256) if "_norm" in keys else F.col("_digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    winners = groups(docs, sha256, salts).select(F.col("_keep").alias("_w_id"), F.col("_digest").alias("_w_digest"))
    # The whole row is one column, out of the way of other names.
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256).alias("_digest"))
    kept = own.join(winners, own["_id"].eqNullSafe(winners["_w_id"]) & (own["_digest"] == winners["_w_digest"]), "left_semi")
    repeated = checkpoint(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_times")).where("_times > 1").select("_id"))
    if not repeated.isEmpty():  # of rows that share text and doc_id any one
        kept = kept.dropDuplicates(["_id", "_digest"])
    return kept.select("_row.*")
