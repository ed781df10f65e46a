"""Operators that were built for size, against plain Python on inputs that take all their paths."""

import random

import pytest

from pyspark.sql import functions as F

from quarrylens.functions import measures
from quarrylens.operators import graph, history, rollups
from quarrylens.plans import report


def reached(edges):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        found[a] = seen
    return found


def test_colours_find_the_cycles(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(106, 120), (120, 121), (121, 120), (130, 130), (131, 132)]
    reach = reached(edges)
    want = {}
    for a in reach:
        ring = {b for b in reach[a] if b != a and a in reach.get(b, ())}
        if ring:
            want[a] = (min(ring | {a}), len(ring) + 1)
    df = spark.createDataFrame(edges, "src long, dst long")
    for limit in (graph.CLOSURE_EDGES, -1):
        monkeypatch.setattr(graph, "CLOSURE_EDGES", limit)
        assert {r["node"]: (r["cycle"], r["size"]) for r in graph.cycles(df).collect()} == want
        assert graph.cycles(df.limit(0)).count() == 0
    assert len({c for c, _ in want.values()}) >= 3


def test_running_counts_over_ranges(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.random() * 1e6, float(rng.randrange(20)), -3.5]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = {r["v"]: (r["upto"], r["total"]) for r in measures.with_upto(df.groupBy("v").count(), "v").collect()}
    assert got == {v: (sum(x <= v for x in values), 3000) for v in set(values)}
    places = {r["id"]: r["place"] for r in measures.placed_from_top(df, "v", [F.col("id")], "place").collect()}
    assert places == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    ranks = {r["id"]: r["r"] for r in measures.cume_rank(df, "v", "r").collect()}
    positive = [v for v in values if v > 0]
    assert all(abs(ranks[i] - (sum(0 < x <= v for x in positive) / len(positive) if v > 0 else 0)) < 1e-12 for i, v in enumerate(values))


def test_bulk_commits_are_not_gathered(spark):
    rows = [(1, f, 1, 1) for f in range(50)] + [(2, 1, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1), (3, 3, 1, 1), (4, 9, 1, 1)]
    changes = spark.createDataFrame(rows, "commit_id long, fid long, added long, deleted long")
    assert {(r["a"], r["b"]): r["n"] for r in history.coupling(changes, 5).collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
    assert [tuple(r) for r in rollups.co_change_partners(changes, 1, 5).collect()] == [(2, 2), (3, 1)]


def test_said_for_people():
    assert [report.human_bytes(n) for n in (0, 1023, 1024, 1536, 3 << 20, 5 << 40)] == ["0 B", "1,023 B", "1.0 KB", "1.5 KB", "3.0 MB", "5,120.0 GB"] and report.human(1234567) == "1,234,567"


@pytest.fixture
def tiny(spark):
    """Settings for many plans over few rows."""
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_deep_graphs_are_contracted(tiny, monkeypatch):
    """Depth and impact, and the cycles that both use, after contraction: a chain, a ladder, rings and random edges."""
    spark = tiny
    monkeypatch.setattr(graph, "PLAIN", 1)
    monkeypatch.setattr(graph, "PAIRS_EACH", -1)
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(7)] + [(200 + i, 200 + j) for i in range(6) for j in (i + 2 - i % 2, i + 3 - i % 2)]
    edges += [(400 + i, 400 + (i + 1) % 5) for i in range(5)] + [(404, 500), (500, 501), (5, 400)] + [(600 + rng.randrange(18), 600 + rng.randrange(18)) for _ in range(22)]
    reach, nodes = reached(edges), {n for e in edges for n in e}
    ring = {n: {m for m in reach.get(n, ()) if n in reach.get(m, ())} | {n} for n in nodes}
    depth: dict = {}

    def deep(c):
        if c not in depth:
            depth[c] = max((deep(min(ring[b])) + 1 for a, b in edges if a in ring[c] and b not in ring[c]), default=0)
        return depth[c]

    folder = {n: f"d{n % 7}" for n in nodes}
    files = spark.createDataFrame([(n, f"{folder[n]}/f{n}.py" if n % 11 else f"{folder[n]}/tests/test_{n}.py") for n in nodes], "fid long, rel string")
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["fid"]: r["depth"] for r in graph.import_depth(df).collect()} == {n: deep(min(ring[n])) for n in nodes}
    back = reached([(b, a) for a, b in edges if a % 11])
    want = {n: (len(back.get(n, set()) - {n}), len({folder[m] for m in back.get(n, set()) - {n}})) for n in nodes}
    assert {r["fid"]: (r["impact"], r["impact_folders"]) for r in graph.impact(df, files).collect()} == want
    monkeypatch.setattr(graph, "PAIRS_EACH", 256)
    assert {r["fid"]: (r["impact"], r["impact_folders"]) for r in graph.impact(df, files).collect()} == want
    assert {(r["impact"], r["impact_folders"]) for r in graph.impact(df.limit(0), files).collect()} == {(0, 0)}


def test_rounds_of_contraction_grow_with_the_logarithm(tiny):
    n = [len(graph.contracted(tiny.range(size).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("w")))[0]) for size in (10, 160)]
    assert n[1] <= n[0] + 10
