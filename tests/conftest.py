import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def same_rows(df, relation) -> None:
    """The rows of a DataFrame and of a DuckDB relation, whatever their order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    plain = lambda v: tuple(v) if isinstance(v, list) else float(v) if isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert mine == theirs


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con
