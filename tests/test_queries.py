"""Every query with an SQL twin against DuckDB, and the others for their shape."""

import pytest

from pyspark.sql import functions as F

from quarrylens.operators import text
from quarrylens.plans.queries import ORACLES, QUERIES, over_all_rows
from quarrylens.sources.tables import TableFacts

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.columns == ["fid", "commits", "loc", "size_pct", "hotspot", "hotspot_rank", "is_hotspot"] and df.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_imports_of_all_rows(spark):
    """Every line item is in an edge, unless its two ends are the same file."""
    n = spark.read.parquet(f"{SMALL}/part.parquet").count()
    rows = [(r["l_partkey"], (r["l_partkey"] * 7 + r["l_suppkey"] * 13) % n) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect()]
    edges = TableFacts(spark, SMALL, all_rows=True).imports
    assert edges.agg(F.sum("mult")).first()[0] == sum(a != b for a, b in rows)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(a, b) for a, b in rows if a != b}


@pytest.mark.parametrize("name", ["g1_g2_cycles", "g3_closure", "g3_u6_impact", "g4_import_depth"])
def test_closures_of_all_rows(spark, duck, name):
    run, sql = over_all_rows(name)
    same_rows(run(spark, SMALL), duck.sql(sql))


def test_debt_of_long_texts(spark, tmp_path):
    """Fifty hits a text, at the start of a line or, with a colon, within it; a mention without a colon is none."""
    body = "\n".join(["The first", "see La: second", "see La third", *["Die: more * "] * 60])
    spark.createDataFrame([(1, body), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((r["id"], r["line"], r["marker"], r["note"]) for r in QUERIES["pa22_debt_in_texts"](spark, str(tmp_path)).collect())
    assert rows == [(1, 1, "The", "first"), (1, 2, "La", "second"), *[(1, i, "Die", "more") for i in range(4, 52)]]


def test_synthetic_repository_has_a_log(spark):
    rows = QUERIES["sc20_synthetic_repository"](spark, SMALL).collect()
    by_commit: dict = {}
    for r in rows:
        by_commit.setdefault(r["commit_id"], []).append(r)
    assert set(by_commit) == set(range(40)) and {r["fid"] for r in by_commit[39]} == set(range(10_000))
    assert all(1 <= len(by_commit[i]) <= 6 and sum(r["added"] for r in by_commit[i]) == 18 for i in range(39))
    assert all(r["author"] and r["ts"] and r["subject"] and r["rel"] for r in rows) and len({(r["fid"], r["commit_id"]) for r in rows}) == len(rows)


def test_json_rows_count_arrays(spark):
    texts = ['{"a":1,"b":2}', '{"a":[1],"b":[1,2,3,4]}', "[1,2,3,4,5]", '{"empty":[]}', '{"said":"[1,2,3]"}', "{", None, "[[1, 2], 3]", "{}", "[]", "17", '"x"', ' [1, 2] ', '{"a": {"b": [1, 2, 3]}}', "", '{"a": null, "b": [[], []]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, source string").select("n", text.json_rows(F.col("source")).alias("rows")).orderBy("n").collect()
    assert [r["rows"] for r in rows] == [2, 4, 5, 1, 1, None, None, 2, 0, 0, 0, 0, 2, 1, None, 2]
