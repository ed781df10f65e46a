"""Facts from a repository on disk: files, symbols, raw imports, commits and changes.

The listing and the log come from git (from the disk where there is no repository); they are thin. Contents are
read by the tasks, from the shared folder or, for a revision, from git's objects, and parsed Arrow-batched.
"""

from __future__ import annotations

import itertools
import json
import os
import subprocess
import weakref
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers, paths

#: Extensions of binary files; those of known languages are text, and others are looked into.
BINARY = tuple(".png .jpg .jpeg .gif .bmp .ico .webp .tiff .svgz .pdf .zip .tar .gz .bz2 .xz .7z .rar .whl .jar .pyc .pyo .pyd .so .dylib .dll .a .o .class .exe .bin .dat .db .sqlite .sqlite3 .parquet .arrow .npy .npz .pkl .pickle .joblib .h5 .hdf5 .pt .pth .onnx .pb .tflite .safetensors .ckpt .mp3 .wav .ogg .flac .mp4 .mov .avi .mkv .webm .woff .woff2 .ttf .otf .eot .lockb .wasm".split())
TEXT = tuple(sorted(set(parsers.LANGUAGES) - set(BINARY)))
SNIFF = 8192
RECORD = "rel string, language string, logical_loc long, comment_lines long, doc_lines long, rows long, confidence string, parse_error string, class_count long, abstract_count long, debt_markers long, floors array<struct<name:string,kind:string,doc:string,line:int,end_line:int,loc:int,depth:int,is_entrypoint:boolean,complexity:int>>, imports array<string>, packages array<string>"


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else None


def is_worktree(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def listing(root: str, include_noise: bool = False, limit: int | None = None) -> tuple[list[str], bool]:
    """Relative paths in order, and whether limit cut some; ignored files count only with include_noise."""
    found = None
    if not include_noise and is_worktree(root):
        out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
        found = None if out is None else [p for p in set(out.split("\0")) if p and os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))]
    if found is None:
        found = []
        for at, folders, names in os.walk(root):
            folders[:] = [d for d in folders if d != ".git" and (include_noise or d not in paths.NOISE_DIRS)]
            found += [os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for n in names if include_noise or not (n in paths.NOISE_FILES or n.endswith(paths.NOISE_SUFFIXES))]
    kept = sorted(p for p in found if not p.startswith(("../", "/")))
    return (kept[:limit], len(kept) > limit) if limit else (kept, False)


FILES_AT_ONCE = 64


def _read(spark: SparkSession, rows: list[tuple], schema: str, opened) -> DataFrame:
    """rel, name, ext, size, is_binary, content (null where binary); opened makes a function from a row to its bytes, once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = opened()
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_ONCE):
                part = batch.iloc[at : at + FILES_AT_ONCE]
                data = [read(r) for r in part.itertuples(index=False)]
                yield pd.DataFrame({"rel": part.rel.to_numpy(), "size": [len(x) for x in data], "content": data})

    tasks = max(1, min(len(rows) // 50, 4 * spark.sparkContext.defaultParallelism))
    files = spark.createDataFrame(rows, schema).repartition(tasks, "rel").mapInPandas(run, "rel string, size long, content binary")
    files = files.withColumn("name", paths.name_of(F.col("rel"))).withColumn("ext", paths.extension(F.col("rel")))
    zero = F.contains(F.substring("content", 1, SNIFF), F.lit(b"\0"))
    binary = F.col("ext").isin(*BINARY) | (~F.col("ext").isin(*TEXT) & zero)
    return files.select("rel", "name", "ext", "size", binary.alias("is_binary"), F.when(~binary, F.col("content")).alias("content"))


def contents(spark: SparkSession, root: str, rels: list[str]) -> DataFrame:
    """The listed files as they are on disk, in a folder that all tasks share. Nothing else below it is opened."""
    base = os.path.abspath(root)

    def opened():
        def read(row) -> bytes:
            with open(os.path.join(base, row.rel), "rb") as f:
                return f.read()

        return read

    return _read(spark, [(r,) for r in rels], "rel string", opened)


def tree_at(root: str, rev: str) -> tuple[str, list[tuple[str, str]]]:
    """(commit, (rel, blob) of its files): what git holds for a revision; links and submodules are no files."""
    commit = (_git(root, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{rev}^{{commit}}") or "").strip()
    if not commit:
        raise ValueError(f"{rev} is no revision of {root}")
    found = []
    for line in (_git(root, "ls-tree", "-r", "-z", commit) or "").split("\0"):
        if line:
            (mode, kind, blob), rel = line.split("\t", 1)[0].split(), line.split("\t", 1)[1]
            if kind == "blob" and mode != "120000":
                found.append((rel, blob))
    return commit, sorted(found)


def contents_at(spark: SparkSession, root: str, files: list[tuple[str, str]]) -> DataFrame:
    """The files (rel, blob) of a revision, read from git's objects by the tasks; nothing is checked out."""
    base = os.path.abspath(root)

    def opened():
        git = subprocess.Popen(["git", "-C", base, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def close() -> None:
            git.stdin.close()
            git.stdout.close()
            git.wait()

        def read(row) -> bytes:
            git.stdin.write(f"{row.blob}\n".encode())
            git.stdin.flush()
            size = int(git.stdout.readline().split()[-1])
            data = git.stdout.read(size)
            git.stdout.read(1)
            return data

        weakref.finalize(read, close)  # the task drops read when it ends
        return read

    return _read(spark, files, "rel string, blob string", opened)


def parsed(files: DataFrame) -> DataFrame:
    """One parse record per text file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            rows = [{"rel": rel, **parsers.parse(name, bytes(content).decode("utf-8", "replace"))} for rel, name, content in zip(batch.rel, batch.name, batch.content, strict=True)]
            out = pd.DataFrame(rows, columns=columns)
            out["rows"] = out["rows"].astype("Int64")
            yield out

    return files.where("not is_binary").select("rel", "name", "content").mapInPandas(run, RECORD)


def symbols(records: DataFrame) -> DataFrame:
    return records.select("rel", F.explode("floors").alias("f")).select("rel", "f.*")


def raw_imports(records: DataFrame) -> DataFrame:
    return records.select("rel", "language", F.posexplode("imports").alias("ord", "spec"))


LOG_FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%ae%x1f%s"
LOG_BATCH = 20_000


def log_records(root: str, rev: str = "HEAD") -> Iterator[str]:
    """Commits with their changed lines, fields apart by U+001F, newest first; read from git as it writes them."""
    git = subprocess.Popen(["git", "-C", root, "log", "--date-order", "--no-renames", "--numstat", f"--pretty=format:{LOG_FORMAT}", rev], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    rest = b""
    while block := git.stdout.read(1 << 22):
        *whole, rest = (rest + block).split(b"\x1e")
        yield from (x.decode("utf-8", "replace") for x in whole if x)
    git.wait()
    if rest:
        yield rest.decode("utf-8", "replace")


def write_log(spark: SparkSession, root: str, path: str, rev: str = "HEAD") -> None:
    """The log as a table at path, in the shared folder, a batch at a time: the driver never holds all of it."""
    records, ord_ = log_records(root, rev), 0
    while True:
        batch = [(ord_ + i, r) for i, r in enumerate(itertools.islice(records, LOG_BATCH))]
        if batch or not ord_:
            spark.createDataFrame(batch, "ord long, value string").write.mode("append").parquet(path)
        ord_ += len(batch)
        if len(batch) < LOG_BATCH:
            return


def history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of a log written to path. Commits without changed files are left out."""
    raw = spark.read.parquet(path).where(F.length("value") > 0)
    parts = raw.select(F.split("value", "\n").alias("l"), "ord")
    head = F.split(F.element_at("l", 1), "\x1f")
    commits = parts.where(F.size(head) >= 5).select(F.element_at(head, 1).alias("commit_id"), F.element_at(head, 2).alias("author"), F.coalesce(F.try_to_timestamp(F.element_at(head, 3)), F.try_to_timestamp(F.substring(F.element_at(head, 3), 1, 19))).alias("ts"), F.element_at(head, 4).alias("email"), F.array_join(F.slice(head, 5, 1000), "\x1f").alias("subject"), "ord", "l")
    rows = commits.select("commit_id", F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("r")).where(F.contains("r", F.lit("\t")))
    cell = F.split("r", "\t")
    number = lambda i: F.coalesce(F.element_at(cell, i).try_cast("long"), F.lit(0))
    changes = rows.select("commit_id", renamed(F.element_at(cell, 3)).alias("rel"), number(1).alias("added"), number(2).alias("deleted"))
    return commits.drop("l").join(changes.select("commit_id").distinct(), "commit_id", "left_semi"), changes


def renamed(path):
    """The new name of ``a => b`` and ``x/{a => b}/y``."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "//+", "/")


RULES_FILES = (".quarrylens/rules.json", "quarrylens.rules.json")


def load_rules(root: str) -> tuple[dict | None, str, str]:
    """(rules, path, error) of the first rules file there is; it must hold a JSON object."""
    for rel in RULES_FILES:
        path = os.path.join(root, rel)
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8") as f:
                    data = json.load(f)
            except (OSError, ValueError) as e:
                return None, rel, f"{rel} could not be read: {e}"
            return (data, rel, "") if isinstance(data, dict) else (None, rel, f"{rel} must hold a JSON object")
    return None, "", ""


def layering(rules: dict) -> tuple[list[list[str]], list[tuple[list[str], list[str]]]]:
    """(layers, forbidden pairs) of patterns; what has another shape says nothing."""
    listed = lambda x: [x] if isinstance(x, str) else [p for p in x if isinstance(p, str)] if isinstance(x, list) else []
    forbid = []
    for entry in rules.get("forbid") or []:
        pair = (entry.get("from"), entry.get("to")) if isinstance(entry, dict) else entry if isinstance(entry, list) and len(entry) == 2 else None
        if pair:
            forbid.append((listed(pair[0]), listed(pair[1])))
    return [listed(x) for x in rules.get("layers") or []], forbid
