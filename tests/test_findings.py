"""What a review found on larger tables, on small ones that show the same."""

import re
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from quarrylens.operators import folders, graph, history, signals
from quarrylens.sources import sinks, storage
from quarrylens.sources.tables import TableFacts
from quarrylens.plans.queries import ORACLES, QUERIES, coupling

from .conftest import SMALL, same_rows


@pytest.fixture
def store(spark, tmp_path):
    """Tables of a few rows, as the queries and DuckDB see them: orders are (key, date), line items (order, part, quantity, number)."""
    import duckdb

    con = duckdb.connect()

    def put(orders, items, parts=8):
        tables = {
            "nation": ([(i, f"NATION_{i}") for i in range(3)], "n_nationkey int, n_name string"),
            "customer": ([(i, i % 3) for i in range(6)], "c_custkey long, c_nationkey int"),
            "part": ([(i, f"red bolt{i}", f"Brand#{i % 3}", ("SMALL", "LARGE")[i % 2], i + 1, 900.0 + i) for i in range(parts)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
            "orders": ([(k, k % 6, "O", d, ("1-URGENT", "2-HIGH", "5-LOW")[k % 3]) for k, d in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
            "lineitem": ([(o, p, o % 5, n, float(q), 0.1, "R") for o, p, q, n in items], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        con.sql("SET TimeZone = 'UTC'")
        return str(tmp_path), con

    return put


def test_heat_that_rounds_to_zero_has_a_place(spark, store):
    """F1: files without a change for years have a churn above 0 that is 0.000000 when rounded."""
    day = [datetime(1990, 1, 1), datetime(1990, 6, 1), datetime(2001, 1, 1), datetime(2001, 2, 1)]
    sf_dir, con = store(list(enumerate(day)), [(0, 0, 5, 1), (0, 1, 7, 2), (1, 2, 9, 1), (2, 3, 4, 1), (3, 4, 4, 1), (3, 5, 30, 2)])
    df = QUERIES["w3_w12_heat"](spark, sf_dir)
    same_rows(df, con.sql(ORACLES["w3_w12_heat"]))
    assert [r["heat"] for r in df.orderBy("fid").collect()] == [(i + 1) / 6 for i in range(6)]


def test_import_edges_have_no_limit(spark):
    """more edges than the 300,000 at which they were cut."""
    imports = spark.range(300_010).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = sinks.import_edges(imports, imports.where("src < 7").union(imports.where("src = 3")))
    assert tuple(found.agg(F.count("*"), F.sum("violates")).first()) == (300_010, 7)


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """F4 to F18: changes, pairs and the edges of all rows are dealt to tasks by the number of rows, which no setting of the session bounds."""
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(storage, "ROWS_EACH", 500)
    t = TableFacts(spark, SMALL, all_rows=True)
    assert t.tasks == -(-n // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [df.rdd.getNumPartitions() for df in (t.changes, coupling(t), t.imports)] == [t.tasks] * 3
    monkeypatch.setattr(storage, "ROWS_EACH", 10**9)
    assert TableFacts(spark, SMALL).tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["a27_teams", "j3_python_imports_all_rows", "j4_relative_imports_all_rows", "a10_j5_coupling", "g6_edge_maps_all_rows"])
def test_many_tasks_give_the_same(spark, duck, monkeypatch, name):
    monkeypatch.setattr(storage, "ROWS_EACH", 500)
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


def test_names_are_looked_up_once(spark):
    """one name that all files import; a name that means the importer itself goes to the next candidate, and repeated imports are one."""
    files = spark.createDataFrame([("a/b.py",), ("a/b/c.py",), ("a/__init__.py",), ("v1.2/x.py",), ("v1.py",), *[(f"m{i}.py",) for i in range(5)]], "rel string")
    raw = [(f"m{i}.py", "a.b.c.name") for i in range(5)] + [("a/b/c.py", "a.b.c.name"), ("a/b.py", "a.b.other"), ("m1.py", "a.b.c.name"), ("m2.py", "nothing.here"), ("v1.2/x.py", ".y"), ("m3.py", "..")]
    found = graph.resolve_python(spark.createDataFrame(raw, "rel string, spec string"), files, 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted([(f"m{i}.py", "a.b.c.name", "a/b/c.py") for i in range(5)] + [("a/b/c.py", "a.b.c.name", "a/b.py"), ("a/b.py", "a.b.other", "a/__init__.py")])
    js = spark.createDataFrame([("s/a.ts",), ("s/a.js",), ("s/b.ts",)], "rel string")
    near = graph.resolve_relative(spark.createDataFrame([("s/b.ts", "./a"), ("s/b.ts", "./a"), ("s/a.js", "./a"), ("s/a.js", "./zz")], "rel string, spec string"), js, 3)
    assert sorted(tuple(r) for r in near.collect()) == [("s/a.js", "./a", "s/a.ts"), ("s/b.ts", "./a", "s/a.js")]


def shuffles(df) -> list[tuple[str, int]]:
    """Key and number of tasks of each shuffle in the plan of df, before any runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(k, int(n)) for k, n in re.findall(r"Exchange hashpartitioning\((\w+)#[^()]*?, (\d+)\)", plan)]


@pytest.fixture
def large(spark, monkeypatch):
    """The smallest tables as if no side of a join could be broadcast, in many tasks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(storage, "ROWS_EACH", 500)
    yield TableFacts(spark, SMALL, all_rows=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_commits_are_sorted_once(spark):
    """F7, F9 to F13: changes are read once to find the small commits; a change without a commit is in none."""
    changes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (None, 1), (None, 2), (3, 9)], "commit_id long, fid long")
    assert {(r["a"], r["b"]): r["n"] for r in history.coupling(changes, 2).collect()} == {(1, 2): 1}
    plan = history.small_commits(changes, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_bridges_are_dealt(spark, large):
    """both joins of the pairs have as many tasks as the table needs; files that are unknown or listed twice change nothing."""
    assert large.more_tasks == large.tasks
    found = shuffles(sinks.bridges(coupling(large), large.files, tasks=large.more_tasks))
    assert [n for k, n in found if k in "ab"].count(large.tasks) >= 2 and all(n == large.tasks for k, n in found if k in ("a", "b", "fid"))
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 7), (2, 3, 5), (2, 4, 9)], "a long, b long, n long")
    files = spark.createDataFrame([(1,), (2,), (3,), (3,)], "fid long")
    for tasks in (None, 7):
        assert [tuple(r) for r in sinks.bridges(pairs, files, 2, tasks).collect()] == [(1, 3, 7), (1, 2, 5)]


def test_cochange_is_dealt(large):
    """as above."""
    found = shuffles(folders.cochange(large.files, coupling(large), tasks=large.more_tasks))
    assert all(n == large.tasks for k, n in found if k in ("a", "b", "fid"))


def test_hidden_coupling_is_dealt(large):
    """as above, and the imports that part the pairs, too."""
    found = shuffles(signals.hidden_coupling(coupling(large), large.files, history.file_history(history.log(large.changes, large.commits)), large.imports, tasks=large.more_tasks))
    assert [n for k, n in found if k in ("a", "b")] == [large.tasks] * 4


@pytest.mark.parametrize("name", ["sk8_j22_bridges", "a26_j6_cochange", "r9_j7_hidden_coupling", "r9_j7_hidden_coupling_all_rows", "t8_partners_per_file", "t5_dependency_matrix_all_rows", "a1_a2_file_history", "w4_pr12_pr13_eras", "r16_timeline"])
def test_large_joins_give_the_same(spark, duck, large, name):
    """F7, F9 to F11, F13 to F17: against the twin with all joins by shuffles in many tasks."""
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))
