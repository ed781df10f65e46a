"""Totals and short lists over an index of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .history import small_commits


#: Sides of a plan in metres, and bounds of its aspect.
SIDE, PLAN, ASPECT = (3.5, 40.0), (2.5, 46.0), (0.5, 2.6)


def footprint(size: Column, loc: Column, starts: Column, physical: Column) -> Column:
    """struct<w,d>: the area from the lines on a floor, the aspect from the longest section against the mean one.

    starts: the sorted lines at which floors begin. Without floors the bytes give the area, and the mean
    line against one of 45 characters the aspect.
    """
    n = F.size(starts)
    bounds = F.concat(starts, F.array(F.greatest(physical.cast("long"), F.array_max(starts)) + 1))
    spans = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(bounds, i) - F.get(bounds, i - 1)), lambda x: x > 0)
    spread = F.coalesce(F.try_divide(F.array_max(spans) * F.size(spans), F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x)), F.lit(1.0))
    lines = F.coalesce(F.try_divide(size, physical), F.lit(45.0))
    planned = (n > 0) & (loc > 0)
    within = lambda c, b: F.least(F.lit(b[1]), F.greatest(F.lit(b[0]), c))
    side = within(F.when(planned, 3.5 + 1.45 * F.sqrt(loc / F.greatest(F.lit(1), n))).otherwise(4.0 + 0.055 * F.sqrt(F.greatest(F.lit(0), size).cast("double"))), SIDE)
    ratio = F.sqrt(within(F.pow(F.greatest(F.lit(1e-6), F.when(planned, spread).otherwise(F.pow(lines / 45.0, F.lit(2.0)))), F.lit(0.25)), ASPECT))
    return F.struct(within(side * ratio, PLAN).alias("w"), within(side / ratio, PLAN).alias("d"))


def longest_definition(symbols: DataFrame) -> DataFrame:
    """key, kind, loc, line, name -> key, name, loc of the longest function or method, or of anything but headings where there is none; the first of equals."""
    rank = F.when(F.col("kind").isin("function", "method"), 2).when(~F.col("kind").isin("heading", "cell", "section"), 1)
    return symbols.withColumn("_r", rank).where("_r is not null").groupBy("key").agg(F.max_by(F.struct("name", "loc"), F.struct("_r", "loc", -F.col("line"))).alias("b")).select("key", "b.name", "b.loc")


def subfolders(files: DataFrame, depth: int) -> DataFrame:
    """district, subfolder, files, loc one level below the districts; files that lie in the district itself are under '.'."""
    return files.withColumns({"d": paths.district(F.col("rel"), depth), "s": F.coalesce(F.try_element_at(paths.dirs_of(F.col("rel")), F.lit(depth + 1)), F.lit("."))}).groupBy(F.col("d").alias("district"), F.col("s").alias("subfolder")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def totals(index: DataFrame, counters: dict[str, str]) -> DataFrame:
    """One row of counters, each a condition or a sum, in one pass."""
    return index.agg(*[F.sum(F.expr(f"cast({e} as bigint)")).alias(n) for n, e in counters.items()])


def central_districts(index: DataFrame, multiple: float = 2.0) -> DataFrame:
    """district, share, is_cbd: districts whose share of downtown files is at least twice that of all."""
    each = index.groupBy("district").agg(F.avg(F.col("downtown").cast("double")).alias("share"))
    whole = index.agg(F.avg(F.col("downtown").cast("double")).alias("whole"))
    return each.crossJoin(F.broadcast(whole)).select("district", "share", ((F.col("share") > 0) & (F.col("share") >= multiple * F.col("whole"))).alias("is_cbd"))


def dependency_matrix(matrix: DataFrame, measures: DataFrame, top: int = 12) -> DataFrame:
    """The busiest folders among themselves, the unstable ones first: src, dst, n, place of src."""
    busy = measures.select("folder", (F.col("edges_in") + F.col("edges_out")).alias("busy"), F.coalesce("instability", F.lit(0.5)).alias("i")).orderBy(F.desc("busy"), "folder").limit(top)
    placed = busy.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("i"), "folder")))
    side = lambda c: placed.select(F.col("folder").alias(c), F.col("place").alias(f"p_{c}"))
    return matrix.join(F.broadcast(side("src_folder")), "src_folder").join(F.broadcast(side("dst_folder")), "dst_folder").select("src_folder", "dst_folder", "n", F.col("p_src_folder").alias("place"))


def flows(matrix: DataFrame, violating: DataFrame, top: int = 15) -> DataFrame:
    """The heaviest folder imports, and all that violate."""
    heavy = matrix.orderBy(F.desc("n"), "src_folder", "dst_folder").limit(top)
    wrong = matrix.join(violating.select("src_folder", "dst_folder").distinct(), ["src_folder", "dst_folder"], "left_semi")
    return heavy.union(wrong.select(*heavy.columns)).distinct()


def co_change_partners(changes: DataFrame, fid: int, bulk: int, limit: int = 30) -> DataFrame:
    """One file's partners in commits of at most bulk files, the strongest first. Only its own commits are looked at."""
    mine = changes.where(F.col("fid") == fid).select("commit_id").distinct()
    near = small_commits(changes.join(mine, "commit_id", "left_semi"), bulk).where(F.col("fid") != fid)
    return near.groupBy(F.col("fid").alias("partner")).agg(F.countDistinct("commit_id").alias("n")).orderBy(F.desc("n"), "partner").limit(limit)


def folder_links(matrix: DataFrame, limit: int = 8) -> DataFrame:
    """folder, way (depends on, depended on by), other, n, rank: the strongest of each folder's links."""
    out = matrix.select(F.col("src_folder").alias("folder"), F.lit("depends on").alias("way"), F.col("dst_folder").alias("other"), "n")
    back = matrix.select(F.col("dst_folder").alias("folder"), F.lit("depended on by").alias("way"), F.col("src_folder").alias("other"), "n")
    rank = F.row_number().over(Window.partitionBy("folder", "way").orderBy(F.desc("n"), "other"))
    return out.unionByName(back).withColumn("rank", rank).where(F.col("rank") <= limit)


#: Points of a found letter: any, one right behind the last (and one more for each of its run), at the start of
#: a segment, in the file's name; and what each character of the path takes away.
LETTER, IN_RUN, SEGMENT_START, IN_NAME, PER_CHARACTER = 1, 4, 3, 2, 0.02
SEPARATORS = ("/", "_", "-", ".")


def fuzzy_score(needle: str, path: Column) -> Column:
    """How well the letters of needle occur in path in order, by the points above; null if they do not."""
    hay = F.lower(path)
    name_at = F.length(hay) - F.length(F.substring_index(hay, "/", -1))
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("run"), F.lit(0).alias("points"), F.lit(True).alias("first"))

    def found(acc: Column, letter: Column) -> Column:
        at = F.position(letter, hay, acc["next"] + 1) - 1
        run = F.when((at == acc["next"]) & ~acc["first"], acc["run"] + 1).otherwise(0)
        begins = (at == 0) | F.substring(hay, at, F.lit(1)).isin(*SEPARATORS)
        points = F.when(run > 0, IN_RUN + run).otherwise(LETTER) + F.when(begins, SEGMENT_START).otherwise(0) + F.when(at >= name_at, IN_NAME).otherwise(0)
        return F.when(at >= 0, F.struct((at + 1).alias("next"), run.alias("run"), (acc["points"] + points).alias("points"), F.lit(False).alias("first")))

    done = F.aggregate(F.array(*[F.lit(c) for c in needle.lower()]), start, found) if needle else start
    return F.round(done["points"] - F.length(hay) * F.lit(PER_CHARACTER), 6)


def find_files(index: DataFrame, needle: str, limit: int = 12) -> DataFrame:
    """The files whose path has the letters of needle, the best first, then the shorter."""
    return index.select("rel", fuzzy_score(needle, F.col("rel")).alias("score")).where("score is not null").orderBy(F.desc("score"), F.length("rel"), "rel").limit(limit)


#: Sentences about a file by condition, with their level.
NOTES = (
    ("Changes often and is large: look here first.", "warn", "is_hotspot"), ("A large share of its commits are fixes.", "warn", "is_defect"), ("In an import cycle.", "warn", "in_cycle"),
    ("Imported by many and importing many.", "note", "is_hub"), ("Nothing imports it, and nobody has touched it for long.", "note", "is_orphan"), ("Parts of it are copied elsewhere.", "note", "is_clone"),
    ("Imports against the direction of its folders.", "warn", "violates"), ("Risky, and no test is linked to it.", "warn", "untested"), ("One author wrote half of it.", "note", "bus_factor = 1"),
)


def notes(index: DataFrame) -> DataFrame:
    """rel, level, note: what there is to say about each file."""
    found = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(level).alias("level"), F.lit(text).alias("note"))) for text, level, c in NOTES]), lambda x: x.isNotNull())
    return index.select("rel", F.explode(found).alias("n")).select("rel", "n.level", "n.note")
