"""Copied code: winnowed fingerprints of normalised lines. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.storage import cut

#: Words of many languages that are no identifiers.
KEYWORDS = """
and as assert async await break case catch class const continue def default del do elif else
enum except export extends final finally fn for from func function go if impl import in
interface is lambda let loop match mod new nil none not null or package pass private protected
pub public raise return self static struct super switch this throw throws trait try type
typeof use var void while with yield true false True False None
""".split()
COMMENT_STARTS = ("#", "//", "/*", "*", "--", "<!--")
#: Possessive, as Java takes one frame of the stack for each repeat of a group that is not.
STRINGS = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`]*+`)"""
NUMBERS = r"\b\d[\d_.xXa-fA-F]*\b"
TOKENS = r"([\p{L}_$][\p{L}\p{N}_$]*|[^\p{L}_$])"


def normalised(line: Column) -> Column:
    """Strings, numbers and names become S, N and I; blanks go; comments become empty."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    comment = F.lit(False)
    for start in COMMENT_STARTS:
        comment = comment | text.startswith(start)
    plain = F.regexp_replace(F.regexp_replace(text, STRINGS, "S"), NUMBERS, "N")
    words = F.transform(F.regexp_extract_all(plain, F.lit(TOKENS), F.lit(1)), lambda w: F.when(w.rlike(r"^[\p{L}_$]") & ~w.isin(*KEYWORDS), F.lit("I")).otherwise(w))
    return F.when(comment, "").otherwise(F.regexp_replace(F.array_join(words, ""), r"\s+", ""))


def fingerprints(texts: DataFrame, hashed: Callable[[Column], Column] = F.crc32, th: Thresholds = DEFAULT, longest: int | None = None) -> DataFrame:
    """fid, text -> fid, fp: the least hash of every window of line groups, distinct. longest: texts of more characters give none, as in the model."""
    k, w = th.clone_lines, th.clone_window
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r]"), normalised), lambda x: F.length(x) >= th.clone_line_chars)
    kept = (texts if longest is None else texts.where(F.length("text") <= longest)).select("fid", lines.alias("lines"))
    # No filter on lines: it would be pushed into their making, and they be made twice.
    grams = kept.select("fid", F.when(F.size("lines") >= k, F.transform(F.sequence(F.lit(1), F.size("lines") - k + 1), lambda i: hashed(F.array_join(F.slice("lines", i, F.lit(k)), "\n")))).alias("grams"))
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("grams") - w + 1)), lambda i: F.array_min(F.slice("grams", i, F.lit(w))))
    return grams.select("fid", F.explode(F.when(F.col("grams").isNotNull(), F.array_distinct(least))).alias("fp"))


def clone_pairs(prints: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """a, b, shared, ratio. Fingerprints of many files are idioms and give no pairs, so a list is short before pairs are made."""
    prints = cut(prints)  # thin rows, read four times
    sizes = prints.groupBy("fid").agg(F.count("*").alias("n"))
    few = prints.groupBy("fp").agg(F.count("*").alias("c")).where(F.col("c").between(2, th.clone_idiom_files)).select("fp")
    lists = prints.join(few, "fp").groupBy("fp").agg(F.array_sort(F.collect_set("fid")).alias("fids"))
    pairs = F.flatten(F.transform("fids", lambda x, i: F.transform(F.slice("fids", i + 2, F.size("fids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = lists.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("fid").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("fid").alias("b"), F.col("n").alias("nb")), "b")
    ratio = F.col("shared") / F.least("na", "nb")
    return both.where(((ratio >= th.clone_ratio) & (F.col("shared") >= 2)) | (F.col("shared") >= th.clone_shared)).select("a", "b", "shared", F.round(F.least(F.lit(1.0), ratio), 3).alias("ratio"))


def partners(pairs: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Each file's first partners, numbered."""
    swapped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])
    both = pairs.unionByName(swapped)
    return both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(*[F.desc(c) for c in order], "b"))).where(F.col("n") <= limit)
