"""Which tests stand by which sources: by import and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def common_folders(a, b):
    """How many leading folders two paths share."""
    da, db = paths.dirs_of(a), paths.dirs_of(b)
    same = F.zip_with(da, db, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(da), F.size(db)).cast("long"))


def links(files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """test, source (paths): sources that a test imports, and of those its name points at in its language the nearest ones."""
    told = files.withColumn("is_test", paths.is_test(F.col("rel"))).withColumn("name", paths.name_of(F.col("rel")))
    tests = told.where("is_test").select(F.col("rel").alias("test"), "language", paths.test_stem(F.col("name")).alias("stem"))
    sources = told.where(~F.col("is_test") & ~paths.is_vendored(F.col("rel")) & ~paths.is_config(F.col("rel")) & ~paths.is_doc(F.col("rel")))
    sources = sources.select(F.col("rel").alias("source"), "language", F.lower(F.regexp_replace("name", r"(.)\.[^.]*$", "$1")).alias("stem"))
    named = tests.where("stem <> ''").join(sources, ["language", "stem"]).withColumn("near", common_folders(F.col("test"), F.col("source")))
    best = named.withColumn("r", F.rank().over(Window.partitionBy("test").orderBy(F.desc("near")))).where("r = 1").select("test", "source")
    if imports is None:
        return best
    direct = imports.select(F.col("src").alias("test"), F.col("dst").alias("source")).join(tests.select("test"), "test", "left_semi").join(sources.select("source"), "source", "left_semi").where(~F.col("source").endswith("__init__.py"))
    return best.union(direct.select("test", "source")).distinct()
