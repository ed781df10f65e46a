"""Signals of single files: hotspots, size, defects, hubs, centrality, archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.storage import cut, dealt
from ..functions.measures import cume_rank, placed_from_top, row_rank, with_upto


def share_of(df: DataFrame, fraction: float, least: int = 1) -> DataFrame:
    """df with cut: its row count times fraction, rounded half to even, at least least."""
    n = df.agg(F.greatest(F.lit(least).cast("double"), F.bround(F.count("*") * F.lit(fraction), 0)).cast("long").alias("cut"))
    return df.crossJoin(F.broadcast(n))


def hotspots(files: DataFrame, history: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, commits, loc, hotspot, hotspot_rank, is_hotspot: the product of both percentile ranks, and its top slice."""
    code = files.join(history.select("fid", "commits"), "fid", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    code = cut(code.select("fid", "rel", "loc", "commits"))
    ranked = cume_rank(cume_rank(code, "commits", "commit_pct"), "loc", "size_pct")
    scored = cut(share_of(ranked.withColumn("hotspot", F.col("commit_pct") * F.col("size_pct")), th.hotspot_fraction).where("hotspot > 0"))
    placed = placed_from_top(scored, "hotspot", [F.desc("commits"), F.col("rel")], "hotspot_rank")
    return placed.select("fid", "commits", "loc", "size_pct", "hotspot", "hotspot_rank", (F.col("hotspot_rank") <= F.col("cut")).alias("is_hotspot"))


def oversized(files: DataFrame, th: Thresholds = DEFAULT, least_loc: int | None = None) -> DataFrame:
    least = th.oversized_loc if least_loc is None else least_loc
    return cume_rank(files, "loc", "size_pct").select("fid", "loc", "size_pct", ((F.col("size_pct") >= th.oversized_percentile) & (F.col("loc") >= least)).alias("is_oversized"))


def fix_ratios(history: DataFrame) -> DataFrame:
    return history.select("fid", "commits", "fixes", F.when(F.col("commits") > 0, F.col("fixes") / F.col("commits")).otherwise(0.0).alias("fix_ratio"))


def defects(history: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Files whose share of fixes is high among the busy ones."""
    busy = cume_rank(fix_ratios(history).where(F.col("commits") >= th.defect_commits), "fix_ratio", "pct")
    flag = (F.col("pct") >= th.defect_percentile) & (F.col("fixes") >= th.defect_fixes) & (F.col("fix_ratio") >= th.defect_ratio)
    return busy.where(flag).select("fid", "commits", "fixes", "fix_ratio")


def bugprone(files: DataFrame, history: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """The top slice by fixes of the files with a real share of them."""
    code = share_of(files.join(fix_ratios(history), "fid", "left"), th.bugprone_fraction)
    some = code.where((F.col("fixes") >= th.bugprone_fixes) & (F.col("fix_ratio") >= th.bugprone_ratio))
    placed = placed_from_top(cut(some.select("fid", "rel", "fixes", "fix_ratio", "cut")), "fixes", [F.desc("fix_ratio"), F.col("rel")], "rank")
    return placed.where("rank <= cut").select("fid", "fixes", "fix_ratio", "rank")


def degrees(imports: DataFrame) -> DataFrame:
    """fid, in_degree (import statements), fan_in (files), fan_out."""
    into = imports.groupBy(F.col("dst").alias("fid")).agg(F.sum("mult").alias("in_degree"), F.count("*").alias("fan_in"))
    out = imports.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("fan_out"))
    both = into.join(out, "fid", "full")
    return both.select("fid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "fan_in", "fan_out")])


def hubs(imports: DataFrame, th: Thresholds = DEFAULT, degree: int | None = None) -> DataFrame:
    """Files in the top decile of both ways, past a floor."""
    least = th.hub_degree if degree is None else degree
    d = cume_rank(cume_rank(degrees(imports), "in_degree", "in_pct"), "fan_out", "out_pct")
    return d.select("fid", "in_degree", "fan_out", "in_pct", "out_pct", ((F.col("in_degree") >= least) & (F.col("fan_out") >= least) & (F.col("in_pct") >= th.hub_percentile) & (F.col("out_pct") >= th.hub_percentile)).alias("is_hub"))


def instability(files: DataFrame, imports: DataFrame) -> DataFrame:
    d = files.select("fid").join(degrees(imports), "fid", "left").na.fill(0)
    total = F.col("fan_out") + F.col("in_degree")
    return d.select("fid", F.when(total > 0, F.round(F.col("fan_out") / total, 4)).otherwise(-1.0).alias("instability"))


def centrality(files: DataFrame, couplings: DataFrame, imports: DataFrame, heat: DataFrame, authors: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Weighted mean of four percentile ranks; a part without any positive value is left out and the rest take its weight."""
    ends = couplings.select(F.explode(F.array("a", "b")).alias("fid")).groupBy("fid").agg(F.count("*").alias("coupled"))
    base = files.select("fid", "rel").join(ends, "fid", "left").join(degrees(imports).select("fid", "in_degree"), "fid", "left").join(heat, "fid", "left").join(authors.select("fid", "authors"), "fid", "left")
    base = ranked = cut(base.na.fill(0))
    weights = {"coupled": th.weight_coupling, "in_degree": th.weight_imports, "recent_churn": th.weight_heat, "authors": th.weight_authors}
    for c in weights:
        ranked = row_rank(ranked, c, "rel", f"{c}_pct")
    said = base.agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"{c}_on") for c in weights])
    base = ranked.crossJoin(F.broadcast(said))
    total = sum((F.col(f"{c}_on") * w for c, w in weights.items()), F.lit(0.0))
    score = sum((F.col(f"{c}_on") * F.col(f"{c}_pct") * w for c, w in weights.items()), F.lit(0.0))
    return base.select("fid", "rel", F.round(score / total, 6).alias("centrality"))


def downtown(scores: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """The most central slice, at least three files."""
    shares = cut(share_of(scores, th.downtown_fraction, th.downtown_files))
    return placed_from_top(shares.where("centrality > 0"), "centrality", [F.col("rel")], "rank").where("rank <= cut").select("fid", "rel", "centrality", "rank")


def code_archetypes(heights: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """fid, height, loc, floors -> archetype of ordinary code by rank of height; below eight files by metres and floors."""
    cum = with_upto(heights.groupBy("height").count(), "height").withColumnRenamed("total", "n")
    at = lambda share: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("height")))
    cuts = cum.agg(at(th.tower_cut).alias("tower"), at(th.slab_cut).alias("slab"), F.max("n").alias("n"))
    ranked = F.when(F.col("height") >= F.col("tower"), "tower").when(F.col("height") >= F.col("slab"), "slab").otherwise("warehouse")
    few = F.when((F.col("height") >= 70) | (F.col("floors") >= 25), "tower").when((F.col("height") >= 34) | (F.col("floors") >= 6), "slab").otherwise("warehouse")
    return heights.crossJoin(F.broadcast(cuts)).select("fid", "height", F.when(F.col("n") < 8, few).otherwise(ranked).alias("archetype"))


def knowledge_risk(owners: DataFrame, authors: DataFrame, head: DataFrame, away_days: float, share: float) -> DataFrame:
    """Files whose main author owns at least share and was last seen away_days before the head."""
    last = authors.groupBy("author").agg(F.max("last_t").alias("seen"))
    away = owners.join(last, F.col("primary_author") == F.col("author")).crossJoin(F.broadcast(head)).withColumn("away_days", (F.col("head") - F.col("seen")) / 86400.0)
    return away.where((F.col("away_days") >= away_days) & (F.col("share") >= share)).select("fid", "primary_author", "share", "away_days")


def sole_tenants(owners: DataFrame, history: DataFrame, th: Thresholds = DEFAULT, share: float | None = None) -> DataFrame:
    least = th.sole_share if share is None else share
    return owners.join(history.select("fid", "commits"), "fid").where((F.col("share") >= least) & (F.col("commits") >= th.sole_commits)).select("fid", "primary_author", "share", "commits")


def hidden_coupling(couplings: DataFrame, files: DataFrame, history: DataFrame, imports: DataFrame, th: Thresholds = DEFAULT, share: float | None = None, commits: int | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of two folders that change together, without an import either way: the strongest ones. tasks: how many pairs and imports are dealt to for each join."""
    least, n = (th.hidden_share if share is None else share), (th.hidden_commits if commits is None else commits)
    # Both sides are dealt: Spark would take the number of the side that has a join behind it.
    known = dealt(files.join(history.select("fid", "commits"), "fid").select("fid", "rel", "district", "commits"), tasks, "fid")
    side = lambda c: known.select(F.col("fid").alias(c), F.col("rel").alias(f"rel_{c}"), F.col("district").alias(f"d_{c}"), F.col("commits").alias(f"c_{c}"))
    pairs = dealt(dealt(couplings.where(F.col("n") >= n), tasks, "a").join(side("a"), "a"), tasks, "b").join(side("b"), "b").where("d_a <> d_b")
    linked = dealt(imports.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), tasks, "a", "b")
    pairs = pairs.join(linked, ["a", "b"], "left_anti").where(F.col("n") / F.greatest(F.lit(1), F.least("c_a", "c_b")) >= least)
    return pairs.select("a", "b", "rel_a", "rel_b", "n").orderBy(F.desc("n"), "rel_a", "rel_b").limit(th.hidden_pairs)
