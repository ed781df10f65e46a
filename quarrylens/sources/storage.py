"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed and checkpointed reliably, in the shared folder of spark.checkpoint.dir; a local session may go without the setting."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quarrylens-")
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


#: Rows that one task gets where a table is dealt by its size.
ROWS_EACH = 250_000


def tasks_for(spark, rows: int) -> int:
    """How many tasks so many rows are dealt to: as many as a shuffle has, and more as the table grows, so that what a task holds does not grow with it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt to so many tasks by its keys; as it is without a number."""
    return df if tasks is None else df.repartition(tasks, *keys)


def fresh_folder(spark) -> str:
    """A new path below the shared folder."""
    import uuid

    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
