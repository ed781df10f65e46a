"""A hand-built repository from its files to the report."""

import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import changes_since
from quarrylens.plans import report
from quarrylens.plans.analysis import analyse
from quarrylens.sources import repo


def test_report(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    sources = {
        "app/a.py": "from app.b import x\n" + "\n".join(f"def f{i}(v):\n    return v + {i}\n" for i in range(12)), "app/b.py": "from app import a\nx = 1\n# TODO: less\n", "app/__init__.py": "",
        "quarrylens.rules.json": '{"layers": ["app/a.py", "app/b.py"], "forbid": [{"from": "app/a.py", "to": ["app/b*"]}]}',
        "tests/test_a.py": "from app import a\n\n\ndef test():\n    assert a\n", "README.md": "# Read me\n\nText.\n", "data.csv": "a,b\n1,2\n3,4\n",
    }
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ada", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    for rel, body in sources.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(body)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    for i in range(3):
        with (root / "app/a.py").open("a") as f:
            f.write(f"y{i} = {i}\n")
        git("commit", "-qam", "fix: again")
    done = analyse(spark, str(root))
    totals = done.totals()
    assert (totals["files"], totals["cycles"], totals["debt"], totals["hotspots"]) == (7, 1, 1, 1)
    rows = {r["rel"]: r for r in done.index.collect()}
    assert rows["app/a.py"]["is_hotspot"] and rows["app/a.py"]["tested"] and rows["app/a.py"]["commits"] == 4 and rows["app/a.py"]["fixes"] == 3
    assert rows["app/b.py"]["in_cycle"] and rows["data.csv"]["rows"] == 2 and rows["app/a.py"]["primary_author"] == "Ada"
    assert sorted(r["reason"].split(":")[0] for r in done.violations.collect()) == ["forbidden", "layer 2 imports layer 1, which sits above it"]
    text = report.markdown(report.build(done))
    assert "`app/a.py`" in text and "| cycles | 1 |" in text
    # An ignored file is not opened, names that begin with a dot are read, and an earlier revision shows its own tree and history.
    (root / ".gitignore").write_text("build\n")
    (root / "build").mkdir()
    (root / "build/out.py").symlink_to("/nowhere")
    git("add", "-A")
    git("rm", "-q", "README.md")
    git("commit", "-qm", "update")
    now, then = repo.listing(str(root))[0], repo.tree_at(str(root), "HEAD~2")
    assert ".gitignore" in now and "README.md" not in now and "build/out.py" not in now
    assert [rel for rel, _ in then[1]] == sorted(sources) and len(then[0]) == 40
    read = {r["rel"]: bytes(r["content"]).decode() for r in repo.contents_at(spark, str(root), then[1]).collect()}
    assert read["app/b.py"] == sources["app/b.py"] and read["app/a.py"].endswith("y1 = 1\n") and {r["rel"] for r in repo.contents(spark, str(root), now).collect()} == set(now)
    for part in (1, 2, 1000):
        monkeypatch.setattr(repo, "LOG_BATCH", part)
        repo.write_log(spark, str(root), f"{tmp_path}/log{part}", "HEAD~1")
        commits, changes = repo.history(spark, f"{tmp_path}/log{part}")
        assert [r["subject"] for r in commits.orderBy("ord").collect()] == ["fix: again"] * 3 + ["first"] and changes.where("rel = 'app/a.py'").count() == 4
    old = analyse(spark, str(root), rev="HEAD~2")
    assert old.totals()["files"] == 7 and {r["rel"]: r["commits"] for r in old.index.collect()}["app/a.py"] == 3
    # Against an earlier revision at which app/a.py was no hotspot yet; a budget of one line is exceeded by both modules, the test and the README.
    then = replace(old, index=old.index.withColumn("is_hotspot", F.lit(False)))
    gained, kinds = report.compared(done, then)
    assert then.totals()["hotspots"] == 0 and gained["hotspots"] == 1 and gained["oversized"] == 0 and "removed" not in kinds
    done.rules["budgets"] = {"max_file_loc": 1, "max_import_depth": 5, "what": 1}
    figures = changes_since.figures(done.totals(), then.totals(), gained, report.over_budget(done))
    failed, unknown = changes_since.gates(["new-hotspot", "hotspots-up", "new-oversized", "budgets"], report.GATES, figures)
    assert failed == ["new-hotspot: 1, allowed 0", "hotspots-up: 1, allowed 0", "budgets: 4, allowed 0"] and unknown == []
    with pytest.raises(ValueError):
        repo.tree_at(str(root), "nothing")
