"""Banded readings of a file index: lenses, the most pressing signal, folder bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of each lens, in order; the first whose condition holds counts.
LENSES = {
    "instability": (("stable", "instability >= 0 and instability < 0.25"), ("balanced", "instability >= 0.25 and instability <= 0.75"), ("unstable", "instability > 0.75"), ("unresolved", "true")),
    "tests": (("tested", "tested"), ("risky", "untested_risk"), ("untested", "untested"), ("other", "true")),
    "delta": (("added", "delta = 'added'"), ("grown", "delta = 'grown'"), ("shrunk", "delta = 'shrunk'"), ("unchanged", "true")),
    "impact": (("50+", "impact >= 50"), ("10-49", "impact >= 10"), ("1-9", "impact >= 1"), ("none", "true")),
    "trend": (("rising hotspot", "rising"), ("rising", "trend > 0"), ("cooling", "trend < 0"), ("steady", "true")),
    "defects": (("defect-prone", "defect"), ("bug-prone", "bugprone"), ("half fixes", "fixes >= 2 and fix_ratio >= 0.5"), ("some fixes", "fixes > 0"), ("none", "true")),
    "debt": (("5+", "debt >= 5"), ("2-4", "debt >= 2"), ("1", "debt = 1"), ("none", "true")),
    "depth": (("hub", "hub"), ("6+", "depth >= 6"), ("3-5", "depth >= 3"), ("0-2", "true")),
    "coupling": (("clone", "clone"), ("hidden", "hidden"), ("neither", "true")),
    "complexity": (("30+", "cx >= 30"), ("15-29", "cx >= 15"), ("8-14", "cx >= 8"), ("under 8", "true")),
    "main sequence": (("pain", "zone = 'pain'"), ("uselessness", "zone = 'uselessness'"), ("far", "distance > 0.5"), ("near", "distance >= 0"), ("too few types", "true")),
}
#: Signals from the most pressing on, each with the flag that it needs ('' for none).
PRESSING = (("hotspot", "hotspots"), ("defect", "defects"), ("cycle", "imports"), ("violation", "layering"), ("bugprone", "defects"), ("hub", "hubs"), ("oversized", ""), ("codes", "codes"), ("knowledge", "knowledge"), ("orphan", "imports"))


def band(lens: str) -> Column:
    out = F.lit(None).cast("string")
    for label, condition in reversed(LENSES[lens]):
        out = F.when(F.expr(condition), label).otherwise(out)
    return out


def lens_counts(index: DataFrame, lens: str) -> DataFrame:
    return index.groupBy(band(lens).alias("band")).agg(F.count("*").alias("n"))


def pressing(flags: set[str], columns: list[str]) -> Column:
    """The first signal that a file carries among those its repository can tell."""
    out = F.lit("healthy")
    for name, flag in reversed(PRESSING):
        if name in columns and (not flag or flag in flags):
            out = F.when(F.col(name), name).otherwise(out)
    return out


def timeline(files: DataFrame, activity: DataFrame, days_before: float, bucket_days: int = 30) -> DataFrame:
    """Files that existed so many days before the head, and how busy each was then against the busiest."""
    now = activity.where(F.col("bucket") == int(days_before // bucket_days)).select("fid", "commits")
    most = activity.agg(F.max("commits").alias("most"))
    return files.where(F.col("age_days") >= days_before).join(now, "fid", "left").crossJoin(F.broadcast(most)).select("fid", F.try_divide(F.coalesce("commits", F.lit(0)), F.col("most")).alias("burn"))
