"""A whole repository through the operators: an index with one row a file, and tables beside it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import measures, paths
from ..operators import clones, folders, graph, history, owners, signals, tests_map
from ..sources import repo, storage

#: Names that are reached by convention, not by an import.
ENTRY_NAMES = ("__init__.py", "__main__.py", "setup.py", "conftest.py", "manage.py", "wsgi.py", "asgi.py", "index.js", "index.ts", "index.jsx", "index.tsx", "main.js", "main.ts")
#: Languages of markup, data and configuration.
NOT_SOURCE = ("markdown", "text", "html", "css", "json", "jsonl", "yaml", "toml", "ini", "conf", "xml", "csv", "tsv", "data", "notebook", "docker", "make", "unknown")


@dataclass
class Analysis:
    """index: fid, rel, district, language, loc and a column for each measure and signal."""

    index: DataFrame
    changes: DataFrame
    commits: DataFrame
    imports: DataFrame
    couplings: DataFrame
    cycles: DataFrame
    clone_pairs: DataFrame
    violations: DataFrame
    notes: list[str] = field(default_factory=list)
    rules: dict = field(default_factory=dict)

    def totals(self) -> dict[str, int]:
        """One pass over the index, and the sizes of the tables beside it."""
        names = ("is_hotspot", "is_oversized", "is_defect", "is_hub", "is_orphan", "in_cycle", "is_clone", "untested", "violates")
        row = self.index.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("rows").isNull(), F.col("loc"))), F.lit(0)).alias("loc"), F.sum("debt").alias("debt"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names]).first()
        out = {"files": row["files"], "loc": row["loc"], "debt": row["debt"] or 0}
        keys = {"is_hotspot": "hotspots", "is_oversized": "oversized", "is_defect": "defects", "is_hub": "hubs", "is_orphan": "orphans", "untested": "untested"}
        out |= {k: row[n] or 0 for n, k in keys.items()}
        return out | {"cycles": self.cycles.select("cycle").distinct().count(), "clones": self.clone_pairs.count(), "violations": self.violations.count()}


def analyse(spark: SparkSession, root: str, rev: str = "HEAD", th: Thresholds = DEFAULT, depth: int = 1) -> Analysis:
    """The work tree and its history; with a rev other than HEAD that revision's tree, and the history up to it."""
    if rev == "HEAD":
        rels, _ = repo.listing(root)
        raw = repo.contents(spark, root, rels)
    else:
        rev, tree = repo.tree_at(root, rev)
        rels = [rel for rel, _ in tree]
        raw = repo.contents_at(spark, root, tree)
    records = storage.cut(repo.parsed(raw))
    base = raw.select("rel", "name", "ext", "size", "is_binary").join(records.drop("floors", "imports", "packages"), "rel", "left")
    files = base.withColumn("fid", F.xxhash64("rel")).withColumns({"district": paths.district(F.col("rel"), depth), "loc": F.coalesce("logical_loc", F.lit(0)), "is_test": paths.is_test(F.col("rel")), "is_doc": paths.is_doc(F.col("rel"))})
    files = storage.cut(files.withColumn("is_code", ~F.col("is_binary") & F.col("rows").isNull() & ~F.col("is_doc") & ~paths.is_vendored(F.col("rel"))))

    log_path = storage.fresh_folder(spark)
    repo.write_log(spark, root, log_path, rev)
    commits, raw_changes = repo.history(spark, log_path)
    commits = storage.cut(commits.select("commit_id", "author", "email", "ts", "subject"))
    every = storage.cut(raw_changes.groupBy("commit_id", F.xxhash64("rel").alias("fid")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")))
    rows = storage.cut(history.log(every, commits))
    known = rows.join(files.select("fid"), "fid", "left_semi")
    told = history.file_history(known)
    limit = history.bulk_limit(len(rels), th)
    couplings = storage.cut(history.coupling(every, limit))

    specs = repo.raw_imports(records)
    found = graph.resolve_python(specs.where("language = 'python'"), files).unionByName(graph.resolve_relative(specs.where("language <> 'python'"), files))
    imports = storage.cut(found.groupBy(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")).agg(F.count("*").alias("mult")))
    plain = imports.join(files.where(~F.col("rel").endswith("/__init__.py")).select(F.col("fid").alias("dst")), "dst", "left_semi")
    cycles = storage.cut(graph.cycles(plain.select("src", "dst")))

    code = files.where("is_code")
    floors = repo.symbols(records).withColumn("fid", F.xxhash64("rel")).groupBy("fid").agg(F.max("complexity").alias("max_complexity"), F.count("*").alias("floors"), F.max(F.col("is_entrypoint").cast("int")).alias("entry"))
    hot = signals.hotspots(code, told, th).select("fid", "hotspot", "hotspot_rank", "is_hotspot")
    big = signals.oversized(code, th).select("fid", "size_pct", "is_oversized")
    bad = signals.defects(told, th).select("fid", F.lit(True).alias("is_defect"))
    hubs = signals.hubs(imports, th).select("fid", "in_degree", "fan_out", "is_hub")
    idle = graph.orphans(code, imports.select("src", "dst"), told, history.head(rows), th).where(~paths.name_of(F.col("rel")).isin(*ENTRY_NAMES)).select("fid", F.lit(True).alias("idle"))
    impact = graph.impact(imports.select("src", "dst"), files)
    own = history.ownership(history.file_authors(known)).select("fid", "primary_author", "share", "bus_factor")
    texts = raw.join(records.where(F.col("language").isin(*sorted(_code_languages()))).select("rel"), "rel", "left_semi").where(~paths.is_test(F.col("rel")) & ~paths.is_vendored(F.col("rel"))).select(F.xxhash64("rel").alias("fid"), F.decode("content", "UTF-8").alias("text"))
    twins = storage.cut(clones.clone_pairs(clones.fingerprints(texts, th=th, longest=th.clone_source_chars), th))
    cloned = twins.select(F.explode(F.array("a", "b")).alias("fid")).distinct().withColumn("is_clone", F.lit(True))
    links = tests_map.links(files, found.select("src", "dst")).select(F.xxhash64("source").alias("fid")).distinct().withColumn("tested", F.lit(True))
    rules, _, error = repo.load_rules(root)
    layers, forbid = repo.layering(rules or {})
    between = folders.edges(files, imports)
    wrong = storage.cut(folders.rule_violations(between, layers, forbid) if layers or forbid else folders.majority_violations(between))
    violates = wrong.select(F.col("src").alias("fid")).distinct().withColumn("violates", F.lit(True))

    index = files
    for part in (told, own, floors, hot, big, bad, hubs, idle, impact, cloned, links, violates, cycles.select(F.col("node").alias("fid"), F.lit(True).alias("in_cycle"))):
        index = index.join(part, "fid", "left")
    flags = ["is_hotspot", "is_oversized", "is_defect", "is_hub", "idle", "is_clone", "tested", "violates", "in_cycle"]
    index = index.na.fill(False, flags).na.fill(0, ["commits", "fixes", "impact", "in_degree", "fan_out", "max_complexity", "entry"]).withColumn("debt", F.coalesce("debt_markers", F.lit(0)))
    source = F.col("is_code") & ~F.col("is_test") & (F.col("loc") > 0) & ~F.coalesce(F.col("language"), F.lit("unknown")).isin(*NOT_SOURCE) & ~paths.is_config(F.col("rel"))
    index = index.withColumns({"is_orphan": F.col("idle") & (F.col("entry") == 0), "untested": source & ~F.col("tested") & (F.col("is_hotspot") | F.col("is_oversized")), "height": measures.height(F.coalesce("language", F.lit("unknown")), F.col("loc"), F.col("rows"), F.col("is_binary"))})
    return Analysis(storage.cut(index), every, commits, imports, couplings, cycles, twins, wrong, [error] if error else [], rules or {})


def _code_languages() -> frozenset:
    from ..functions import parsers

    return parsers.CODE


def declared_owners(analysis: Analysis, root: str) -> DataFrame | None:
    """The index with declared owners, where the repository has a CODEOWNERS file."""
    for rel in ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS", ".gitlab/CODEOWNERS"):
        path = os.path.join(root, rel)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                return owners.declared(analysis.index, owners.parse_codeowners(f.read()))
    return None
