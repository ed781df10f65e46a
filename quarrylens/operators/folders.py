"""Folders: rollups, dependencies, layering, teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import paths
from ..functions.measures import weight
from ..sources.storage import dealt


def depth_counts(files: DataFrame, deepest: int = 8) -> DataFrame:
    """depth, folders, singletons: what each folder depth would give."""
    keys = F.explode(F.transform(F.sequence(F.lit(1), F.lit(deepest)), lambda d: F.struct(d.alias("depth"), F.when(F.size(paths.dirs_of(F.col("rel"))) == 0, "(root)").otherwise(F.array_join(F.slice(paths.dirs_of(F.col("rel")), F.lit(1), d), "/")).alias("key"))))
    counts = files.select(keys.alias("k")).groupBy("k.depth", "k.key").count()
    return counts.groupBy("depth").agg(F.count("*").alias("folders"), F.sum((F.col("count") == 1).cast("long")).alias("singletons"))


def choose_depth(counts: list[tuple[int, int, int]], n_files: int) -> int:
    """The depth with most folders within 4 to 64 (400 above 5,000 files), without singletons if possible, the shallowest of equals; where none is within, the depth nearest to that."""
    most = 400 if n_files > 5000 else 64
    fits = [c for c in counts if 4 <= c[1] <= most]
    clean = [c for c in fits if c[2] == 0]
    if options := clean or fits:
        return min(options, key=lambda c: (-c[1], c[0]))[0]
    return min(counts, key=lambda c: (max(4 - c[1], c[1] - most), c[0]))[0]


def rollup(files: DataFrame, by: str = "district") -> DataFrame:
    w = weight(F.col("loc"), F.lit(None).cast("long"), F.lit(0), F.lit(False))
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum(w).alias("weight"), F.max("loc").alias("largest"), F.sum(paths.is_test(F.col("rel")).cast("long")).alias("tests"), F.sum(paths.is_doc(F.col("rel")).cast("long")).alias("docs"))


def region_totals(files: DataFrame) -> DataFrame:
    """Totals of every folder with all below it."""
    return files.select(F.explode(paths.ancestors(F.col("rel"))).alias("region"), "loc").groupBy("region").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def primary_language(files: DataFrame, by: str = "district") -> DataFrame:
    """The language with most lines, an empty file counting one; ties: the earlier name."""
    sums = files.groupBy(by, "language").agg(F.sum(F.greatest(F.lit(1), F.col("loc"))).alias("loc"))
    w = Window.partitionBy(by).orderBy(F.desc("loc"), "language")
    return sums.withColumn("n", F.row_number().over(w)).where("n = 1").select(by, "language", "loc")


def leading_author(files: DataFrame, authors: DataFrame, by: str = "district", top: int = 1) -> DataFrame:
    sums = files.select("fid", by).join(authors, "fid").groupBy(by, "author").agg(F.sum("lines").alias("lines"))
    w = Window.partitionBy(by).orderBy(F.desc("lines"), "author")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def folder_trend(files: DataFrame, rows_with_bucket: DataFrame, by: str = "district") -> DataFrame:
    """fid, author, bucket, commit_id -> folder, bucket, changes, authors."""
    return files.select("fid", by).join(rows_with_bucket, "fid").groupBy(by, "bucket").agg(F.count("*").alias("changes"), F.countDistinct("author").alias("authors"))


def edges(files: DataFrame, imports: DataFrame, by: str = "district") -> DataFrame:
    """Imports between eligible files with both folders; packages' own __init__ is no target."""
    ok = files.where(~paths.is_test(F.col("rel")) & ~paths.is_vendored(F.col("rel")))
    src = ok.select(F.col("fid").alias("src"), F.col("rel").alias("src_rel"), F.col(by).alias("src_folder"))
    dst = ok.where(~F.col("rel").endswith("/__init__.py")).select(F.col("fid").alias("dst"), F.col("rel").alias("dst_rel"), F.col(by).alias("dst_folder"))
    return imports.join(src, "src").join(dst, "dst")


def matrix(found: DataFrame) -> DataFrame:
    """src_folder, dst_folder, n: imports between folders."""
    return found.where("src_folder <> dst_folder").groupBy("src_folder", "dst_folder").agg(F.count("*").alias("n"))


def folder_coupling_measures(files: DataFrame, found: DataFrame, by: str = "district") -> DataFrame:
    """folder, ca, ce, instability, edges_in, edges_out: distinct importing files, both ways."""
    cross = found.where("src_folder <> dst_folder")
    into = cross.groupBy(F.col("dst_folder").alias("folder")).agg(F.countDistinct("src").alias("ca"), F.count("*").alias("edges_in"))
    out = cross.groupBy(F.col("src_folder").alias("folder")).agg(F.countDistinct("src").alias("ce"), F.count("*").alias("edges_out"))
    every = files.select(F.col(by).alias("folder")).distinct().join(into, "folder", "left").join(out, "folder", "left").na.fill(0)
    total = F.col("ca") + F.col("ce")
    return every.select("folder", "ca", "ce", F.when(total > 0, F.round(F.col("ce") / total, 4)).alias("instability"), "edges_in", "edges_out")


def main_sequence(measures: DataFrame, classes: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """folder, classes, abstract -> distance from abstractness + instability = 1, and the zone."""
    j = measures.join(classes, "folder").where("classes > 0").withColumn("abstractness", F.round(F.col("abstract") / F.col("classes"), 4))
    j = j.withColumn("distance", F.round(F.abs(F.col("abstractness") + F.col("instability") - 1.0), 4))
    judged = (F.col("distance") >= th.zone_distance) & (F.col("classes") >= th.zone_classes) & (F.col("ca") + F.col("ce") >= th.zone_coupling)
    return j.select("folder", "classes", "abstract", "abstractness", "instability", "distance", F.when(judged, F.when(F.col("abstractness") + F.col("instability") < 1.0, "pain").otherwise("uselessness")).otherwise("").alias("zone"))


def majority_violations(found: DataFrame) -> DataFrame:
    """Imports that go against the thicker direction of two folders that import each other."""
    m = matrix(found)
    back = m.select(F.col("dst_folder").alias("src_folder"), F.col("src_folder").alias("dst_folder"), F.col("n").alias("back"))
    wrong = m.join(back, ["src_folder", "dst_folder"]).where("n <= back")
    return found.join(wrong, ["src_folder", "dst_folder"]).select("src", "dst", "src_folder", "dst_folder", F.col("n").alias("forward"), F.col("back").alias("backward"))


def rule_violations(found: DataFrame, layers: list[list[str]], forbid: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Imports that a rule forbids (the first that does), or that go up the layers.

    Patterns become regular expressions on the driver, so each side of an import is tested in one projection.
    """
    def hits(c: str, patterns: list[str]):
        out = F.lit(False)
        for p in patterns:
            out = out | F.col(c).rlike(paths.glob_regex(p))
        return out

    def layer(c: str):
        return F.coalesce(*[F.when(hits(c, ps), F.lit(i)) for i, ps in enumerate(layers)], F.lit(None).cast("int")) if layers else F.lit(None).cast("int")

    told = F.coalesce(*[F.when(hits("src_rel", a) & hits("dst_rel", b), F.lit(f"forbidden: {'/'.join(a)} must not import {'/'.join(b)}")) for a, b in forbid], F.lit(None).cast("string"))
    up = found.withColumn("a", layer("src_rel")).withColumn("b", layer("dst_rel"))
    climbs = F.when(F.col("b") < F.col("a"), F.concat(F.lit("layer "), (F.col("a") + 1).cast("string"), F.lit(" imports layer "), (F.col("b") + 1).cast("string"), F.lit(", which sits above it")))
    return up.withColumn("reason", F.coalesce(told, climbs)).where("reason is not null").select("src", "dst", "src_rel", "dst_rel", "reason")


def code_limits(measured: DataFrame, codes: list[tuple[list[str], dict[str, float]]]) -> DataFrame:
    """rel and measure columns -> rel, key, value, limit where a declared limit is passed; later entries win key by key."""
    keys = sorted({k for _, limits in codes for k in limits})
    limits = []
    for key in keys:
        chosen = F.lit(None).cast("double")
        for patterns, values in codes:
            if key in values:
                hit = F.lit(True)
                if patterns:
                    hit = F.lit(False)
                    for p in patterns:
                        hit = hit | F.col("rel").rlike(paths.glob_regex(p))
                chosen = F.when(hit, F.lit(float(values[key]))).otherwise(chosen)
        limits.append(F.struct(F.lit(key).alias("key"), F.col(key).cast("double").alias("value"), chosen.alias("limit")))
    return measured.select("rel", F.explode(F.array(*limits)).alias("c")).select("rel", "c.key", "c.value", "c.limit").where("value > limit")


def budgets(measured: DataFrame, limits: dict[str, float]) -> DataFrame:
    over = measured.select("rel", F.explode(F.array(*[F.struct(F.lit(k).alias("budget"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit")) for k, v in sorted(limits.items())])).alias("c"))
    return over.select("rel", "c.budget", "c.value", "c.limit").where("value > limit")


def cochange(files: DataFrame, couplings: DataFrame, th: Thresholds = DEFAULT, by: str = "district", tasks: int | None = None) -> DataFrame:
    """Folder pairs by shared commits: the strongest. tasks: how many the pairs of files are dealt to for each join."""
    side = lambda c: files.select(F.col("fid").alias(c), F.col(by).alias(f"f{c}"))
    pairs = dealt(dealt(couplings, tasks, "a").join(side("a"), "a"), tasks, "b").join(side("b"), "b").where("fa <> fb")
    sums = pairs.groupBy(F.least("fa", "fb").alias("folder_a"), F.greatest("fa", "fb").alias("folder_b")).agg(F.count("*").alias("pairs"), F.sum("n").alias("commits"))
    return sums.orderBy(F.desc("commits"), F.desc("pairs"), "folder_a", "folder_b").limit(th.folder_pairs)


def teams(files: DataFrame, rows: DataFrame, buckets: DataFrame, scores: DataFrame, th: Thresholds = DEFAULT, by: str = "district", tasks: int | None = None) -> DataFrame:
    """Coordination cost of each folder: recent authors, commits, the share that also touch other folders, the top expert's share."""
    of = files.select("fid", F.col(by).alias("folder"))
    touched = dealt(rows.select("fid", "commit_id").join(of, "fid").select("commit_id", "folder"), tasks, "commit_id").distinct()
    commits = touched.withColumn("width", F.count("*").over(Window.partitionBy("commit_id"))).groupBy("folder").agg(F.count("*").alias("commits"), F.round(F.avg((F.col("width") > 1).cast("double")), 4).alias("cross_share"))
    recent = buckets.where(F.col("bucket") < th.cooks_months).join(of, "fid").groupBy("folder").agg(F.countDistinct("author").alias("recent_authors"))
    each = scores.join(of, "fid").groupBy("folder", "author").agg(F.sum("score").alias("score"))
    top = each.groupBy("folder").agg(F.round(F.try_divide(F.max("score"), F.sum("score")), 4).alias("top_share"))
    out = commits.join(recent, "folder", "left").join(top, "folder", "left").na.fill(0)
    return out.select("folder", "commits", "cross_share", "recent_authors", "top_share", ((F.col("recent_authors") > th.cooks_authors) & (F.col("top_share") < th.cooks_share)).alias("many_cooks"))


def folder_tree(leaves: DataFrame) -> DataFrame:
    """key, weight of folders with files -> id, leaf, weight, parent: the tree of folders, those with a single child left out.

    A folder's own files are a leaf inside it, whose id is the path; the folder's has a slash in front. The parent is the nearest
    folder above that has several children; the top has none.
    """
    own = leaves.select(F.col("key").alias("path"), F.concat(F.array(F.lit("")), paths.ancestors(F.concat("key", F.lit("/x")))).alias("above"), "weight")
    folders = own.select(F.explode("above").alias("path"), "weight").groupBy("path").agg(F.sum("weight").alias("weight"))
    up = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    children = folders.where("path <> ''").select(up.alias("path")).unionByName(own.select("path")).groupBy("path").agg(F.count("*").alias("children"))
    kept = folders.join(children.where("children > 1"), "path").select("path", "weight")
    nodes = kept.select(F.concat(F.lit("/"), "path").alias("id"), F.lit(False).alias("leaf"), "weight", "path").unionByName(own.select(F.col("path").alias("id"), F.lit(True).alias("leaf"), "weight", "path"))
    above = nodes.select("id", "leaf", F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.concat("path", F.lit("/x"))))).alias("up"), "path").where("leaf or up <> path")
    parent = above.join(kept.select(F.col("path").alias("up")), "up").groupBy("id").agg(F.max_by(F.concat(F.lit("/"), "up"), F.length("up")).alias("parent"))
    return nodes.join(parent, "id", "left").select("id", "leaf", "weight", F.coalesce("parent", F.lit("")).alias("parent"))
