"""What the operators of this subpackage share: reading tables, cutting lineage, segmenting text natively."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, independent of locale."""
    return F.translate(c, UPPER, UPPER.lower())


#: Shuffle files of a step whose result has been written are of no more use; without this they stay until the driver's next collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names; the shuffles that made it are dropped.

    Where the setting is absent a local session gets a temporary folder; a
    cluster session is refused, as its executors would not share the folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quarrylens-checkpoint-")
        sc.setCheckpointDir(where)
    with _cleaning(spark):
        return df.select("*").checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Marks around matches. ESCAPE stands for a literal U+0001 of the text, so that the marks are unambiguous.
MARK = "\u0001"
ESCAPE = MARK + "\u0002"
OPEN = MARK + "\u0003"
CLOSE = MARK + "\u0004"


def marked(text: Column, pattern: str) -> Column:
    """text with OPEN and CLOSE around each match of the Java pattern, in one linear pass.

    No pattern given here may match U+0001 to U+0004.
    """
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(ESCAPE)), F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))


def has_marks(m: Column) -> Column:
    return F.contains(m, F.lit(OPEN))


def pieces(m: Column) -> Column:
    """The text between marks: entries at odd places (from 0) are the matches."""
    return F.split(m, f"{MARK}[\u0003\u0004]")


def plain(piece: Column) -> Column:
    return F.replace(piece, F.lit(ESCAPE), F.lit(MARK))


RUN = 256


def with_sums_before(df: DataFrame, numbers: list[str], out: list[str]) -> DataFrame:
    """df with, for each array column of numbers, that of the sums of all entries before each entry; null stays null.

    Sums are made inside runs of ``RUN`` entries and over the sums of runs, so that no array is
    copied once an entry. In steps, as the analyser takes lambdas in lambdas only so deep.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
    runs, first = [f"{c}_runs" for c in out], [f"{c}_first" for c in out]

    def cut(c: str) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), lambda i: F.slice(c, i * RUN + 1, F.lit(RUN)))
        return F.when(F.size(c) > 0, each).when(F.size(c) == 0, F.array().cast("array<array<bigint>>"))

    df = df.withColumns({r: cut(c) for c, r in zip(numbers, runs, strict=True)})
    df = df.withColumns({f: F.transform(r, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda acc, x: acc + x)) for r, f in zip(runs, first, strict=True)})
    df = df.withColumns({f: F.aggregate(f, start, step)["sums"] for f in first})
    df = df.withColumns({r: F.transform(r, lambda run: F.aggregate(run, start, step)["sums"]) for r in runs})
    df = df.withColumns({o: F.flatten(F.zip_with(r, f, lambda run, at: F.transform(run, lambda x: x + at))) for o, r, f in zip(out, runs, first, strict=True)})
    return df.drop(*runs, *first)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet under the checkpoint folder and read again, and where it lies.

    Unlike a checkpoint it has the size of its files: the planner takes a join to be as large as the product of
    its sides, and a loop over checkpoints squares that number each round, until the number itself fills the driver.
    """
    spark = df.sparkSession
    checkpoint(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the checkpoint folder, and read again: for wide rows that are read more than once."""
    return stored_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of ``stored_at`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What drops the caches that operators keep in a Python worker between tasks.
CACHES: list = []


def tidy(keep=None) -> None:
    """Called as a task begins in a Python worker: what other operators have left there is given back."""
    import ctypes
    import gc

    import pyarrow as pa

    for drop in CACHES:
        if drop != keep:  # bound methods are made anew at each access
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
