"""A treemap of folders and a grid of files in each: geometry as data.

Folders number hundreds, so their rectangles are cut on the driver; files, which may be millions, are placed in
their folder's grid by arithmetic on their rank.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STREET = 6.0
MARGIN = 4.0
#: The larger part of a cut rectangle at most.
MOST = 0.88


def split_weights(items: list[tuple[str, float]]) -> int:
    """How many of the first items reach half of the weight, at least one and not all."""
    upto = list(accumulate(w for _, w in items))
    return min(bisect_left(upto, upto[-1] / 2) + 1, len(items) - 1)


def treemap(items: list[tuple[str, float]], x: float, y: float, w: float, d: float, street: float = STREET) -> tuple[list[tuple], list[tuple]]:
    """(rects, streets): weight-balanced halves, cut across the longer side, a street between them where there is room."""
    if not items:
        return [], []
    if len(items) == 1:
        return [(items[0][0], x, y, w, d)], []
    at = split_weights(items)
    total = sum(v for _, v in items)
    share = min(MOST, max(1 - MOST, sum(v for _, v in items[:at]) / total if total > 0 else at / len(items)))
    gap = street if max(w, d) > 4 * street else 0.0
    if w >= d:
        a = (w - gap) * share
        one, two = (x, y, a, d), (x + a + gap, y, w - a - gap, d)
        cut = ("v", x + a, y, gap, d)
    else:
        a = (d - gap) * share
        one, two = (x, y, w, a), (x, y + a + gap, w, d - a - gap)
        cut = ("h", x, y + a, w, gap)
    r1, s1 = treemap(items[:at], *one, street)
    r2, s2 = treemap(items[at:], *two, street)
    return r1 + r2, s1 + s2 + ([cut] if gap else [])


def districts(rollup: DataFrame, by: str = "district", density: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(districts, streets) of folders with a weight; a square city whose side grows with the root of it."""
    spark = rollup.sparkSession
    items = [(r[by], float(r["weight"])) for r in rollup.select(by, "weight").orderBy(F.desc("weight"), by).collect()]
    side = max(40.0, math.sqrt(sum(w for _, w in items) * density))
    rects, streets = treemap(items, -side / 2, -side / 2, side, side)
    return spark.createDataFrame(rects, f"{by} string, x double, y double, w double, d double"), spark.createDataFrame(streets, "axis string, x double, y double, w double, d double")


def placements(files: DataFrame, rects: DataFrame, by: str = "district", margin: float = MARGIN) -> DataFrame:
    """fid, x, y, cell_w, cell_d: cells in rows as square as the folder allows; files in order of height, then path."""
    n = files.groupBy(by).agg(F.count("*").alias("n"))
    inside_w, inside_d = F.greatest(F.lit(1.0), F.col("w") - 2 * margin), F.greatest(F.lit(1.0), F.col("d") - 2 * margin)
    grid = rects.join(n, by).withColumn("cols", F.greatest(F.lit(1), F.least(F.col("n"), F.round(F.sqrt(F.col("n") * inside_w / inside_d)).cast("long"))))
    grid = grid.withColumn("lines", F.ceil(F.col("n") / F.col("cols"))).withColumns({"cell_w": inside_w / F.col("cols"), "cell_d": inside_d / F.col("lines")})
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("height"), "rel")) - 1
    ranked = files.withColumn("at", at).join(F.broadcast(grid), by)
    col, line = F.col("at") % F.col("cols"), F.floor(F.col("at") / F.col("cols"))
    margin_of = lambda side: F.least(F.lit(margin), F.col(side) / 4)
    return ranked.select("fid", by, (F.col("x") + margin_of("w") + (col + 0.5) * F.least(F.col("cell_w"), (F.col("w") - 2 * margin_of("w")) / F.col("cols"))).alias("x"), (F.col("y") + margin_of("d") + (line + 0.5) * F.least(F.col("cell_d"), (F.col("d") - 2 * margin_of("d")) / F.col("lines"))).alias("y"), "cell_w", "cell_d")


def resident(districts: DataFrame, x: float, z: float, near: float, budget: int) -> DataFrame:
    """key, x, z, files of districts -> key, distance of those to show: the nearest first, as far as the budget of files goes.

    One that no longer fits is passed over, but the first is always taken. Districts are a bounded list, so the driver chooses.
    """
    distance = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("z") - z, 2))
    chosen, total = [], 0
    for r in districts.select("key", distance.alias("distance"), "files").where(F.col("distance") <= near).orderBy("distance", "key").toLocalIterator():
        if not chosen or total + r["files"] <= budget:
            total += r["files"]
            chosen.append((r["key"], r["distance"]))
    return districts.sparkSession.createDataFrame(chosen, "key string, distance double")
