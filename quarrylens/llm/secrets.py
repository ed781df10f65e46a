"""Secret scans: an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A
ledger holds, for each pair of blob and rule version, the spans that were found
(none included). A scan takes the distinct blobs that the ledger lacks for the
current rule version, scans each once, adds the outcome to the ledger and joins
findings back to all paths. Texts travel once, after copies are folded inside each partition.

Rules are matched natively: a match is marked in the text by one regular
expression pass, and positions follow from the lengths of the pieces between marks, summed up
in runs, so that a text with very many matches takes no longer a match than one with few.

Defined results: null text is the empty blob; a path that appears twice gets the
findings twice; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, has_marks, marked, pieces, plain, with_sums_before

#: Kind, pattern, and which group of a match must have how many characters. The first three are the base kinds, in this order.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("vcs", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 0),
)
#: Follows from the rules, so that edited rules find every blob unseen.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]
BASE = 3
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(parts: str, starts: str, rank: int) -> Column:
    """The spans of one rule in its marked text, in order: entries at odd places are matches."""
    _, pattern, group, least = RULES[rank]

    def span(x: Column, i: Column) -> Column:
        said = plain(x) if group == 0 else F.regexp_extract(plain(x), pattern, group)
        here = F.struct(F.get(starts, i).alias("start"), F.lit(rank).alias("rank"), (F.get(starts, i) + F.length(plain(x))).alias("end"))
        return F.when((i % 2 == 1) & (F.length(said) >= least), here)

    return F.coalesce(F.filter(F.transform(parts, span), lambda s: s.isNotNull()), F.array()).cast(SPAN)


def scan(blobs: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """blob, _text -> blob, rule_version, spans (by start, then rule)."""
    every = range(len(RULES))
    parts, starts = [f"_p{i}" for i in every], [f"_s{i}" for i in every]
    found = blobs.select("blob", *[marked(F.col("_text"), rule[1]).alias(p) for rule, p in zip(RULES, parts, strict=True)])
    found = found.withColumns({p: F.when(has_marks(F.col(p)), pieces(F.col(p))) for p in parts})
    found = found.withColumns({s: F.transform(p, lambda x: F.length(plain(x)).cast("long")) for p, s in zip(parts, starts, strict=True)})
    found = with_sums_before(found, starts, starts)
    spans = F.concat(*[_spans(parts[i], starts[i], i) for i in every])
    return found.select("blob", F.lit(version).alias("rule_version"), F.array_sort(spans).alias("spans"))


def addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("_text"))


def update(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Rows to append to the ledger, written out: the outcome for each blob it lacks under this rule version."""
    # Copies are folded inside each partition first. What is left lies by blob, as the ledger has to for their join.
    unseen = addressed(docs).groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    # Written before findings are joined: a filter on spans would else be pushed into their making.
    return checkpoint(scan(unseen, version))


def findings(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob, spans for every path, from a ledger that has all its blobs."""
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return addressed(docs).select("doc_id", "blob").join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def digest_columns(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(rule[0]) for rule in RULES])

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[of(i).alias(f"n_{rule[0]}") for i, rule in enumerate(RULES[:BASE])],
        F.sha2(said(F.filter("spans", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
