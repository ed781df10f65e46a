"""Operators on small inputs whose answers are known."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import measures, parsers, paths
from quarrylens.operators import changes_since, clones, externals, folders, graph, history, layout, owners, signals, tests_map
from quarrylens.plans import dsl
from quarrylens.sources import repo, sinks, snapshots


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_cycles(spark):
    found = {tuple(r) for r in graph.cycles(edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)])).collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}


def test_long_ring_and_empty_graph(spark):
    ring = spark.range(300).select(F.col("id").alias("src"), ((F.col("id") + 1) % 300).alias("dst"))
    assert {r["size"] for r in graph.cycles(ring).collect()} == {300}
    assert graph.closure(edges(spark, [])).count() == 0


def test_depth_and_impact(spark):
    e = edges(spark, [(3, 2), (2, 1), (4, 1), (5, 6), (6, 5), (6, 1)])
    depth = {r["fid"]: r["depth"] for r in graph.import_depth(e).collect()}
    assert depth == {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1}
    files = spark.createDataFrame([(1, "a/base.py"), (2, "a/mid.py"), (3, "b/top.py"), (4, "b/side.py"), (5, "c/x.py"), (6, "c/y.py")], "fid long, rel string")
    impact = {r["fid"]: (r["impact"], r["impact_folders"]) for r in graph.impact(e, files).collect()}
    assert impact[1] == (5, 3) and impact[2] == (1, 1) and impact[3] == (0, 0) and impact[5] == (1, 1)


@pytest.mark.parametrize(("lines", "factor"), [([90, 10], 1), ([40, 35, 25], 2), ([25, 25, 25, 25], 2)])
def test_bus_factor(spark, lines, factor):
    rows = spark.createDataFrame([(1, f"a{i}", n, 0.0) for i, n in enumerate(lines)], "fid long, author string, lines long, last_t double")
    assert history.ownership(rows).first()["bus_factor"] == factor


def test_commit_subjects(spark):
    yes = ["fix: crash", "Fixes #12", "hotfix for login", "a regression", "closes #4", "patched it"]
    no = ["prefix the table", "debug output", "add fixture", "affix label"]
    rows = spark.createDataFrame([(s,) for s in yes + no], "s string").select("s", paths.is_fix(F.col("s")).alias("f")).collect()
    assert {r["s"] for r in rows if r["f"]} == set(yes)
    assert spark.createDataFrame([("Revert \"x\"",), ("backed out y",), ("irrevertible",)], "s string").where(paths.is_revert(F.col("s"))).count() == 2


def test_path_kinds(spark):
    rels = ["tests/a.py", "hypothesis-testing/a.py", "x/test_a.py", "x/a.spec.ts", "x/FooTest.java", "vendor/x.py", "a/lib.min.js", "README.md", "index.md"]
    rows = {r["r"]: r for r in spark.createDataFrame([(x,) for x in rels], "r string").select("r", paths.is_test(F.col("r")).alias("t"), paths.is_vendored(F.col("r")).alias("v"), paths.is_doc(F.col("r")).alias("d"), paths.district(F.col("r"), 1).alias("k")).collect()}
    assert [r for r in rels if rows[r]["t"]] == ["tests/a.py", "x/test_a.py", "x/a.spec.ts", "x/FooTest.java"]
    assert [r for r in rels if rows[r]["v"]] == ["vendor/x.py", "a/lib.min.js"] and [r for r in rels if rows[r]["d"]] == ["README.md"]
    assert rows["README.md"]["k"] == "(root)" and rows["a/lib.min.js"]["k"] == "a"


def test_test_stems(spark):
    cases = {"test_layout.py": "layout", "layout_test.go": "layout", "LayoutTest.java": "layout", "layout.spec.js": "layout", "layout.py": "", "latest.py": "", ".test.js": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", paths.test_stem(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == cases


def test_links_prefer_near_sources(spark):
    files = spark.createDataFrame([("a/tests/test_x.py", "python"), ("a/x.py", "python"), ("b/x.py", "python"), ("a/x.js", "javascript")], "rel string, language string")
    assert [tuple(r) for r in tests_map.links(files).collect()] == [("a/tests/test_x.py", "a/x.py")]


def test_owner_patterns(spark):
    rules = owners.parse_codeowners("* @all\n*.js @js # code\n/build/ @ops\ndocs/* @docs\napps/**/x @x\n")
    files = spark.createDataFrame([("a.py",), ("d/a.js",), ("build/x/y.c",), ("sub/build/x",), ("docs/a.md",), ("docs/deep/a.md",), ("apps/a/b/x/z.py",)], "rel string")
    got = {r["rel"]: r["owners"][0] for r in owners.declared(files, rules).collect()}
    assert got == {"a.py": "@all", "d/a.js": "@js", "build/x/y.c": "@ops", "sub/build/x": "@all", "docs/a.md": "@docs", "docs/deep/a.md": "@docs", "apps/a/b/x/z.py": "@x"}


def test_globs():
    import re

    assert re.match(paths.glob_regex("src/**"), "src") and re.match(paths.glob_regex("src/**"), "src/a/b") and not re.match(paths.glob_regex("src/**"), "srcs/a")
    assert re.match(paths.glob_regex("src/ui"), "src/ui/x") and re.match(paths.glob_regex("*.p[!y]"), "a/b.px") and not re.match(paths.glob_regex(""), "x")


def test_choose_depth():
    assert folders.choose_depth([(1, 8, 0), (2, 320, 0), (3, 6400, 6400)], 6400) == 2
    assert folders.choose_depth([(1, 4, 4), (2, 4, 4)], 4) == 1


def test_grades(spark):
    rows = spark.createDataFrame([("d", 100, True, True), ("d", 100, False, False)], "folder string, loc long, hotspot boolean, defect boolean")
    got = changes_since.grades(rows, "folder").first()
    assert (got["score"], got["grade"]) == (50.0, "F")


def test_gates():
    names = {"cycles": "cycles", "hotspots": "hotspots", "hotspot": "hotspots"}
    judged = lambda *figures: changes_since.gates(["cycles", " Cycles-up", "new-hotspot", "budgets", "what", "what-up", ""], names, changes_since.figures(*figures))
    failed, unknown = judged({"cycles": 2, "hotspots": 3}, {"cycles": 1}, None, None)
    assert [f.split(":")[0] for f in failed] == ["cycles", " Cycles-up"] and len(unknown) == 5
    failed, unknown = judged({"cycles": 0, "hotspots": 3}, {"cycles": 1}, {"hotspots": 2}, 4)
    assert [f.split(":")[0] for f in failed] == ["new-hotspot", "budgets"] and len(unknown) == 3
    assert judged({"cycles": 1, "hotspots": 3}, {"cycles": 1}, {}, 0)[0] == ["cycles: 1, allowed 0"]


def test_builds(spark, tmp_path):
    """What a build is compared with, the census, and a build that got no further than its files."""
    files = spark.createDataFrame([("a", 3, 1), ("b", 4, 0)], "key string, loc long, bits long")
    row = lambda head, t, root="r": {"root": root, "keying": "path", "head": head, "head_t": float(t), "generated": str(t), "totals": {"files": t}}
    against = lambda head, root="r": [r["build"] for r in snapshots.baseline(snapshots.builds(spark, str(tmp_path)), root, "path", head).collect()]
    assert against("x") == [] and snapshots.census(snapshots.builds(spark, str(tmp_path)), "r", "path").count() == 0
    for i, (head, t) in enumerate((("x", 1), ("y", 2), ("y", 3), (None, 4)), 1):
        assert snapshots.append(spark, str(tmp_path), row(head, t), files.limit(i % 2 + 1)) == i
    assert (against("y"), against("x"), against(None), against("y", "another")) == ([4], [4], [4], [])
    files.write.parquet(f"{tmp_path}/files/build=5")  # no row: it is not there, and gets written over
    assert against("z") == [4] and snapshots.append(spark, str(tmp_path), row("z", 0), files.where("key = 'a'")) == 5
    assert [tuple(r) for r in snapshots.files_of(spark, str(tmp_path), 5).collect()] == [("a", 3, 1)]
    census = snapshots.census(snapshots.builds(spark, str(tmp_path)), "r", "path").collect()
    assert [(r["head"], r["generated"], r["totals"]) for r in census] == [("", "4", {"files": 4}), ("y", "3", {"files": 3}), ("x", "1", {"files": 1}), ("z", "0", {"files": 0})]


def test_owners_file():
    text = "# all\n*  @all # the rest\n[Docs] @x\n^[More]\n/a#b.py @c\n\tdocs/ @d @e\t#f\n#*.x @y\n"
    assert owners.parse_codeowners(text) == [("*", ["@all"]), ("^[More]", []), ("/a#b.py", ["@c"]), ("docs/", ["@d", "@e"])]


def test_depth_outside_the_band():
    assert folders.choose_depth([(1, 2, 0), (2, 3, 0)], 100) == 2 and folders.choose_depth([(1, 3, 0), (2, 70, 0), (3, 500, 0)], 100) == 1
    assert folders.choose_depth([(1, 1, 0), (2, 66, 0)], 100) == 2 and folders.choose_depth([(1, 1, 0), (2, 67, 0)], 100) == 1


def test_split_where_half_is_reached():
    cut = lambda *w: layout.split_weights([(str(i), x) for i, x in enumerate(w)])
    assert (cut(5, 1, 1), cut(3, 3, 2, 2), cut(1, 1), cut(1, 1, 9), cut(0, 0, 0)) == (1, 2, 1, 2, 1)
    rects, _ = layout.treemap([("a", 1000.0), ("b", 1.0)], 0, 0, 20, 10)
    assert rects[0][3] == 17.6


def test_long_literal_takes_no_stack(spark):
    line = lambda c: f'x = join(y, "{c * 1_000_000}")'
    rows = spark.createDataFrame([(i, "\n".join(line(c) for _ in range(8))) for i, c in enumerate(("a", '\\"'))], "fid long, text string")
    assert clones.fingerprints(rows).count() == 2


def test_clone_twins(spark):
    body = "\n".join(f"    value{i} = compute{i}(left, right) + {i}" for i in range(12))
    renamed = body.replace("value", "result").replace("left", "first")
    other = "\n".join(f"while queue{i} and not seen: print(seen[{i}]); break" for i in range(12))
    docs = spark.createDataFrame([(1, body), (2, renamed), (3, other), (4, None), (5, "")], "fid long, text string")
    prints = {r["fid"] for r in clones.fingerprints(docs).collect()}
    assert prints == {1, 2, 3}
    shared = clones.fingerprints(docs).groupBy("fp").agg(F.collect_set("fid").alias("f")).where("array_contains(f, 1)").first()["f"]
    assert sorted(shared) == [1, 2]


def test_filter_language(spark):
    index = spark.createDataFrame([(1, "src/a.py", "a.py", 600, dsl.BITS["hotspot"], "ada"), (2, "src/b.py", "b.py", 10, 0, "grace hopper"), (3, "lib/hotspot.py", "hotspot.py", None, 0, None)], "fid long, rel string, name string, loc long, flags long, owner string")
    ids = lambda q, e=None: sorted(r["fid"] for r in dsl.run(index, q, e).collect())
    assert ids("") == [1, 2, 3] and ids("hotspot") == [1, 3] and ids("is:hotspot") == [1] and ids("-is:hotspot loc<50") == [2, 3]
    assert ids('owner:"grace h" OR loc>=600') == [1, 2] and ids("nonsense:1") == [] and ids("-nonsense:1") == [1, 2, 3] and ids("OR | ||") == [1, 2, 3]
    assert ids("imports:src/", edges(spark, [(3, 1), (1, 2)])) == [1, 3] and ids("importedby:lib/", edges(spark, [(3, 1)])) == [1]


def test_parsers():
    py = parsers.parse("a.py", '"""Doc."""\nimport os\nfrom . import x\nfrom a.b import c as d\n\n\ndef documented(a):\n    """Says."""\n    # TODO: more\n    return [i for i in a if i] if a else 0\n\n\nclass K(ABC):\n    def m(self):\n        pass\n\n\nif __name__ == "__main__":\n    documented(1)\n')
    assert [(f["name"], f["kind"], f["depth"]) for f in py["floors"]] == [("documented", "function", 0), ("K", "class", 0), ("m", "method", 1)]
    assert py["imports"] == ["os", ".x", "a.b.c"] and py["abstract_count"] == 1 and py["debt_markers"] == 1 and py["floors"][0]["is_entrypoint"] and py["confidence"] == "high"
    js = parsers.parse("t.js", "(function () {\n  // note\n  function makeThing(a) { if (a && '}') { return 1; } }\n  const describe = (x) => { return x; };\n})();\nimport y from '@s/p/q'; require('./z');\n")
    assert [f["name"] for f in js["floors"]] == ["makeThing", "describe"] and js["packages"] == ["@s/p"] and js["imports"] == ["./z"] and js["comment_lines"] == 1
    assert parsers.parse("bad.py", "def (:\n")["confidence"] == "low"
    md = parsers.parse("r.md", "# A\n\ntext\n```\n# not\n```\n## B\n")
    assert [(f["name"], f["depth"]) for f in md["floors"]] == [("A", 0), ("B", 1)] and md["logical_loc"] == 4
    assert [parsers.json_rows(x) for x in ('{"a":1,"b":2}', '{"a":[1],"b":[1,2,3,4]}', "[1,2,3,4,5]", '{"empty":[]}')] == [2, 4, 5, 1]
    assert parsers.parse("c.csv", 'n,c\na,1\n"b\nb",2\n')["rows"] == 2 and parsers.parse("d.jsonl", '{}\n\n{}\n')["rows"] == 2


def test_repository(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "a.py").write_text("import pkg.b\n\n\ndef main():\n    pass\n")
    (root / "pkg" / "b.py").write_text("X = 1\n")
    (root / "blob.dat").write_bytes(b"\0\1")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ada", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "fix: first")
    rels, cut = repo.listing(str(root))
    assert rels == ["blob.dat", "pkg/__init__.py", "pkg/a.py", "pkg/b.py"] and not cut
    files = repo.contents(spark, str(root), rels)
    assert {r["rel"]: r["is_binary"] for r in files.select("rel", "is_binary").collect()} == {"blob.dat": True, "pkg/__init__.py": False, "pkg/a.py": False, "pkg/b.py": False}
    records = repo.parsed(files)
    assert [r["name"] for r in repo.symbols(records).collect()] == ["main"]
    found = graph.resolve_python(repo.raw_imports(records), files)
    assert [tuple(r) for r in found.collect()] == [("pkg/a.py", "pkg.b", "pkg/b.py")]
    log = f"{tmp_path}/log"
    repo.write_log(spark, str(root), log)
    commits, changes = repo.history(spark, str(log))
    assert commits.first()["subject"] == "fix: first" and {r["rel"] for r in changes.collect()} >= {"pkg/a.py", "pkg/b.py"}


def test_relative_imports(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/c.js",)], "rel string")
    raw = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib/c"), ("src/b/index.ts", "../a"), ("src/a.ts", "./a")], "rel string, spec string")
    assert {tuple(r) for r in graph.resolve_relative(raw, files).collect()} == {("src/a.ts", "./b", "src/b/index.ts"), ("src/a.ts", "../lib/c", "lib/c.js"), ("src/b/index.ts", "../a", "src/a.ts")}


def test_layout_stays_inside_and_apart():
    rects, streets = layout.treemap([(f"d{i}", float(100 - i)) for i in range(23)], 0, 0, 500, 400)
    assert len(rects) == 23 and streets
    for i, (_, x, y, w, d) in enumerate(rects):
        assert x >= -1e-9 and y >= -1e-9 and x + w <= 500 + 1e-9 and y + d <= 400 + 1e-9
        for _, a, b, c, e in rects[i + 1 :]:
            assert x + w <= a + 1e-9 or a + c <= x + 1e-9 or y + d <= b + 1e-9 or b + e <= y + 1e-9


def test_sinks(spark, tmp_path):
    words = ["", "a/b.py", "ü\udc80"]
    assert sinks.read_string_table(sinks.string_table(words)) == words
    key = b"k" * 80
    got = spark.createDataFrame([("a/b.py",)], "r string").select(sinks.hmac_column(key, F.col("r")).alias("h")).first()["h"]
    import hashlib
    import hmac

    assert got == hmac.new(key, b"a/b.py", hashlib.sha256).hexdigest()
    sinks.write_chunks(spark.createDataFrame([(1, "x"), (2, "y")], "fid long, district string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_ranks(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 1, 2, 5])], "fid long, v long")
    assert [r["p"] for r in measures.cume_rank(rows, "v", "p").orderBy("fid").collect()] == [0.0, 0.5, 0.5, 0.75, 1.0]
    assert [r["p"] for r in measures.row_rank(rows, "v", "fid", "p").orderBy("fid").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert signals.share_of(spark.range(50), 0.05).first()["cut"] == 2


@pytest.mark.parametrize(
    "name, text, found",
    [
        ("a/Requirements-dev.txt", "Flask>=2 # web\n-r other.txt\ngit+https://x/y\nhttps://x/z.whl\n\nruamel_yaml[jinja2]\nflask\n", ["flask", "ruamel-yaml"]),
        ("pyproject.toml", '[project]\ndependencies = ["A.B>1", 3]\n[project.optional-dependencies]\nx = ["c"]\n[dependency-groups]\ndev = ["d", {include-group = "x"}]\n', ["a-b", "c", "d"]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "3"\ne = "1"\n[tool.poetry.group.dev.dependencies]\nf = "1"\n', ["e", "f"]),
        ("pyproject.toml", "project = 3\ntool = [1]\n", []),
        ("pyproject.toml", "no [ toml", []),
        ("package.json", '{"dependencies": {"lodash.merge": "1", "@s/p_q": "1"}, "devDependencies": ["x"], "peerDependencies": null}', ["@s/p-q", "lodash-merge"]),
        ("package.json", "[1]", []),
        ("package.json", "{", []),
    ],
)
def test_manifests(name, text, found):
    assert [package for _, package in externals.parse_manifest(name, text)] == found


def test_npm_packages_meet_what_is_declared(spark):
    specs = ["react", "lodash/fp", "lodash.merge", "@s/p_q/deep", "fs/promises", "node:fs", "@/own", "~/own", "#own", "./own", "/own", "", None, "local"]
    imports = spark.createDataFrame([("a.js", x) for x in specs], "rel string, spec string")
    used = externals.npm_packages(imports, spark.createDataFrame([("local",)], "name string"))
    assert {r["package"] for r in used.collect()} == {"react", "lodash", "lodash-merge", "@s/p-q"}
    declared = spark.createDataFrame(externals.parse_manifest("package.json", '{"dependencies": {"lodash.merge": "1", "@s/p_q": "1", "lodash": "4", "left": "1"}}'), "ecosystem string, package string")
    assert {tuple(r) for r in externals.mismatches(used, declared).collect()} == {("react", "undeclared"), ("left", "unused")}


def test_primary_language_and_archetype(spark):
    rows = [("x", "python", 5), ("x", "go", 3), ("x", "go", 2), ("y", "go", 0)]
    files = spark.createDataFrame(rows, "district string, language string, loc long")
    assert {tuple(r) for r in folders.primary_language(files).collect()} == {("x", "go", 5), ("y", "go", 1)}
    kinds = spark.createDataFrame([("markdown", None, False, False, True, False), ("markdown", None, False, False, False, False), ("csv", 3, False, False, False, False), ("png", None, True, False, False, False), ("go", None, False, True, False, False), ("go", 1, True, True, True, True), ("go", None, False, False, False, False)], "language string, rows long, b boolean, t boolean, d boolean, r boolean")
    found = kinds.select(measures.archetype(F.col("language"), F.col("rows"), F.col("b"), F.col("t"), F.col("d"), F.col("r")).alias("kind"))
    assert sorted(r["kind"] for r in found.collect()) == sorted(["town_hall", "warehouse", "silo", "monument", "park", "ruin", "pending"])


def test_index_and_manifest_are_written(spark, tmp_path):
    out = f"file://{tmp_path}"
    sinks.write_index(spark.createDataFrame([(2, "b"), (1, "a")], "fid long, rel string"), f"{out}/index")
    assert {tuple(r) for r in spark.read.parquet(f"{out}/index").collect()} == {(1, "a"), (2, "b")}
    for parts in ({"files": 2}, {"name": "é\n", "files": 3}):
        sinks.write_manifest(spark, out, parts)
    assert [json.loads(r["value"]) for r in spark.read.text(f"{out}/manifest").collect()] == [{"name": "é\n", "files": 3}]
