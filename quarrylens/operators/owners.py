"""Who knows a file, and who is said to own it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import paths


def expert_scores(authors: DataFrame, head: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, author, score: lines that halve for every half-year since the author last touched the file."""
    away = F.greatest(F.lit(0.0), (F.col("head") - F.col("last_t")) / 86400.0)
    return authors.crossJoin(F.broadcast(head)).select("fid", "author", (F.col("lines") * F.pow(F.lit(0.5), away / th.expert_half_life)).alias("score"))


def experts(scores: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    whole = Window.partitionBy("fid")
    rank = F.row_number().over(whole.orderBy(F.desc(F.round("score", 6)), "author"))
    return scores.where("score > 0").select("fid", "author", F.round(F.col("score") / F.sum("score").over(whole), 4).alias("share"), rank.alias("rank")).where(F.col("rank") <= th.experts)


def author_shares(authors: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    whole = Window.partitionBy("fid")
    return authors.where("lines > 0").select("fid", "author", (F.col("lines") / F.sum("lines").over(whole)).alias("share"), F.row_number().over(whole.orderBy(F.desc("lines"), "author")).alias("rank")).where(F.col("rank") <= th.shares)


def parse_codeowners(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of each rule, in order."""
    # A # begins a comment at the start of a line and behind white space only: patterns may hold one. [Section] lines are no rules.
    lines = (re.sub(r"(^|\s)#.*", "", line).split() for line in text.splitlines() if not line.lstrip().startswith("["))
    return [(words[0], words[1:]) for words in lines if words]


def declared(files: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """files with owners: those of the last rule that matches, null if none does. Rules are few, so they are tested in one projection."""
    hits = [F.when(F.col("rel").rlike(paths.owners_regex(p)), F.array(*[F.lit(o) for o in owners]).cast("array<string>")) for p, owners in reversed(rules)]
    return files.withColumn("owners", F.coalesce(*hits, F.lit(None).cast("array<string>")))


def identities(authors: DataFrame, emails: DataFrame) -> DataFrame:
    """key, author: normalised names, then addresses, logins and local parts; the first to claim a key has it."""
    local = F.element_at(F.split("email", "@"), 1)
    login = F.when(F.contains(local, F.lit("+")) & F.col("email").endswith("users.noreply.github.com"), F.regexp_replace(local, r"^[^+]*\+", "")).otherwise(local)
    named = authors.select(paths.handle(F.col("author")).alias("key"), "author", F.lit(0).alias("kind"))
    more = emails.select(F.explode(F.array(F.struct(paths.handle(F.col("email")).alias("key"), F.lit(1).alias("kind")), F.struct(paths.handle(login).alias("key"), F.lit(2).alias("kind")))).alias("k"), "author")
    every = named.unionByName(more.select("k.key", "author", "k.kind"))
    return every.groupBy("key").agg(F.min_by("author", F.struct("kind", "author")).alias("author"))


def drift(said: DataFrame, identity: DataFrame, authors: DataFrame, owners: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, unowned, drift: no declared owner; or none of the known ones is the main author or wrote a tenth. Teams are not known."""
    handles = said.where("owners is not null").select("fid", F.explode("owners").alias("o")).where(~(F.col("o").startswith("@") & F.contains(F.col("o"), F.lit("/"))))
    known = handles.select("fid", paths.handle(F.regexp_replace("o", "^@", "")).alias("key")).join(identity, "key").select("fid", "author").distinct()
    total = authors.groupBy("fid").agg(F.sum("lines").alias("total"))
    judged = known.join(authors.select("fid", "author", "lines"), ["fid", "author"], "left").join(total, "fid").join(owners.select("fid", "primary_author"), "fid", "left")
    ok = F.max((F.col("author").eqNullSafe(F.col("primary_author")) | (F.try_divide(F.coalesce("lines", F.lit(0)), F.col("total")) >= th.aligned_share)).cast("int"))
    aligned = judged.groupBy("fid").agg(ok.alias("aligned"))
    return said.join(aligned, "fid", "left").select("fid", F.col("owners").isNull().alias("unowned"), F.coalesce(F.col("aligned") == 0, F.lit(False)).alias("drift"))
