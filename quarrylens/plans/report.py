"""Reports and gates over an analysis, and the command line: ``python -m quarrylens stats|report|query ROOT``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import measures, paths
from ..operators import changes_since, folders, graph
from ..sources import storage
from . import dsl
from .analysis import Analysis, analyse

#: Conditions by name.
GATES = {"cycle": "cycles", "cycles": "cycles", "violation": "violations", "violations": "violations", "hotspot": "hotspots", "hotspots": "hotspots", "oversized": "oversized", "orphan": "orphans", "orphans": "orphans", "untested": "untested", "debt": "debt", "defect": "defects", "defects": "defects", "hub": "hubs", "hubs": "hubs", "clone": "clones", "clones": "clones"}


def human(n: int) -> str:
    """1234567 -> 1,234,567."""
    return f"{n:,}"


def human_bytes(n: int) -> str:
    """1536 -> 1.5 KB; whole bytes below 1024, gigabytes at most."""
    power = min(3, max(0, (max(1, int(n)).bit_length() - 1) // 10))
    return f"{n / 1024**power:,.1f} {('KB', 'MB', 'GB')[power - 1]}" if power else f"{int(n):,} B"


def lists(index: DataFrame, limit: int = DEFAULT.list_limit) -> dict[str, list[tuple]]:
    """The top of each list; only these rows come to the driver."""
    wanted = {
        "hotspots": ("is_hotspot", [F.col("hotspot_rank")], ["rel", "commits", "loc"]),
        "oversized": ("is_oversized", [F.desc("loc"), F.col("rel")], ["rel", "loc"]),
        "defects": ("is_defect", [F.desc("fixes"), F.col("rel")], ["rel", "fixes", "commits"]),
        "impact": ("impact > 0 and is_code", [F.desc("impact"), F.col("rel")], ["rel", "impact"]),
        "untested": ("untested", [F.col("hotspot_rank"), F.desc("loc"), F.col("rel")], ["rel", "loc"]),
        "orphans": ("is_orphan", [F.desc("loc"), F.col("rel")], ["rel", "loc"]),
    }
    return {name: [tuple(r) for r in index.where(keep).orderBy(*order).limit(limit).select(*columns).collect()] for name, (keep, order, columns) in wanted.items()}


def build(analysis: Analysis) -> dict:
    return {"totals": analysis.totals(), "lists": lists(analysis.index), "languages": [tuple(r) for r in analysis.index.where("not is_binary").groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.desc("loc"), "language").limit(30).collect()], "notes": analysis.notes}


def markdown(report: dict) -> str:
    out = ["# Repository report", "", "| measure | count |", "|-|-|", *(f"| {k} | {human(v)} |" for k, v in report["totals"].items()), "", "## Languages", "", "| language | files | lines |", "|-|-|-|", *(f"| {a} | {human(b)} | {human(c or 0)} |" for a, b, c in report["languages"])]
    for name, rows in report["lists"].items():
        if rows:
            out += ["", f"## {name.capitalize()}", "", *("- `" + str(r[0]) + "`" + "".join(f", {human(x)}" for x in r[1:]) for r in rows)]
    return "\n".join([*out, *(f"\n> {n}" for n in report["notes"])]) + "\n"


#: Which signal of a snapshot each total counts.
COUNTED = {"hotspots": "hotspot", "oversized": "oversized", "cycles": "cycle", "violations": "violation", "orphans": "orphan", "untested": "untested", "defects": "defect", "hubs": "hub", "clones": "clone"}
#: The column of the index that holds a signal.
HELD = {"hotspot": "is_hotspot", "oversized": "is_oversized", "cycle": "in_cycle", "violation": "violates", "orphan": "is_orphan", "untested": "untested", "defect": "is_defect", "hub": "is_hub", "clone": "is_clone"}
#: The column of the index that a declared budget limits.
LIMITED = {"max_file_loc": "loc", "max_function_cx": "max_complexity", "max_fanout": "fan_out", "max_import_depth": "depth"}


def snapshot(index: DataFrame) -> DataFrame:
    """key, loc, bits of an analysed index."""
    held = [F.col(HELD[s]) if s in HELD else F.lit(False) for s in changes_since.SIGNALS]
    return index.select(F.col("rel").alias("key"), "loc", measures.bitmask(*held).alias("bits"))


def compared(now: Analysis, then: Analysis) -> tuple[dict[str, int], dict[str, int]]:
    """How many files each total's signal was gained by, and the files by what became of them: added, removed, grown, shrunk."""
    moves = storage.cut(changes_since.delta(snapshot(now.index), snapshot(then.index)))
    gained = {r["signal"]: r["became"] or 0 for r in changes_since.signal_moves(moves).collect()}
    kinds = {r["delta"]: r["count"] for r in moves.where("delta <> ''").groupBy("delta").count().collect()}
    return {total: gained[signal] for total, signal in COUNTED.items()}, kinds


def over_budget(done: Analysis) -> int | None:
    """How many values are above the budgets of the rules file, None if it declares none. Binaries, data and vendored files have no budgets."""
    limits = {k: float(v) for k, v in (done.rules.get("budgets") or {}).items() if k in LIMITED and isinstance(v, int | float) and v > 0}
    if not limits:
        return None
    held = done.index.where(~F.col("is_binary") & F.col("rows").isNull() & ~paths.is_vendored(F.col("rel")))
    if "max_import_depth" in limits:
        held = held.join(graph.import_depth(done.imports.select("src", "dst")), "fid", "left").na.fill(0, ["depth"])
    return folders.budgets(held.select("rel", *[F.col(LIMITED[k]).alias(k) for k in limits]), limits).count()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="quarrylens")
    parser.add_argument("action", choices=("stats", "report", "query"))
    parser.add_argument("root")
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--rev", default="HEAD")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--fail-on", default="", help="conditions, comma-separated")
    parser.add_argument("--compare", metavar="REV", help="a revision that new signals are counted from")
    parser.add_argument("--baseline", help="a totals file of an earlier report")
    parser.add_argument("--save-totals", help="where to write this report's totals")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarrylens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = analyse(spark, args.root, args.rev)
    if args.action == "query":
        index = done.index.withColumns({"flags": sum((F.when(F.col(c), dsl.BITS[n]).otherwise(0) for c, n in (("is_hotspot", "hotspot"), ("is_oversized", "oversized"), ("is_orphan", "orphan"), ("in_cycle", "cycle"), ("is_defect", "defect"), ("is_hub", "hub"), ("is_clone", "clone"), ("untested", "untestedrisk"), ("is_test", "test"), ("is_doc", "doc"))), F.lit(0)).cast("long"), "owner": F.col("primary_author"), "fanin": F.col("in_degree"), "fanout": F.col("fan_out"), "cx": F.col("max_complexity")})
        for row in dsl.run(index, args.text, done.imports.select("src", "dst")).orderBy("rel").select("rel", "loc").toLocalIterator():
            print(f"{row['loc']}\t{row['rel']}")
        return 0
    report = build(done)
    print(json.dumps(report, default=str) if args.json else markdown(report) if args.action == "report" else "\n".join(f"{k}: {human(v)}" for k, v in report["totals"].items()))
    before = None
    if args.baseline:
        with open(args.baseline, encoding="utf-8") as f:
            before = json.load(f)
    if args.save_totals:
        with open(args.save_totals, "w", encoding="utf-8") as f:
            json.dump(report["totals"], f)
    became = None
    if args.compare:
        then = analyse(spark, args.root, args.compare)
        became, kinds = compared(done, then)
        before = before or then.totals()
        print(f"since {args.compare}: " + (", ".join(f"{human(n)} {k}" for k, n in sorted(kinds.items())) or "no file moved"), file=sys.stderr)
    conditions = [c for c in args.fail_on.split(",") if c.strip()]
    over = over_budget(done) if any(c.strip().lower() == "budgets" for c in conditions) else None
    failures, skipped = changes_since.gates(conditions, GATES, changes_since.figures(report["totals"], before, became, over))
    for line in skipped:
        print(f"not evaluated: {line}", file=sys.stderr)
    for line in failures:
        print(f"failed: {line}", file=sys.stderr)
    return int(bool(failures))
