"""Chat formatting: reply trees.

Messages form trees by their parents. Iterative self-joins double each message's jump to
an ancestor, 1, 2, 4, ... up, and sum the scores on the way, so root paths of any depth are known
after log2(depth) joins. Leaves are ranked in their tree by the mean score of their path, then by id;
the paths of the chosen ones are enumerated by the same jumps, from the longest to the
shortest, and each is formatted as one conversation with its loss spans.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash
is doubled, and a control string gets a backslash behind its first character (in roles a line feed gets
one before it), so that no control string is left and ``read`` gives back every text. The loss mask spans the
escaped texts of assistant turns, without marks.

Defined results: null role and text are empty; a parent that is absent makes its child a root; messages whose
parents run in a circle are on no path; rows of one turn are ordered by role and text, and each is a turn; a null
conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, all broken inside texts.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and its loss spans in code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += head, body, END, "\n"
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        role = _ROLE.match(formatted, at + len(START))
        end = formatted.index(END, role.end())
        turns.append((unescape(role[1]), unescape(formatted[role.end() : end])))
        at = end + len(END) + 1
    return turns


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """tree, node, parent, score -> the jump tables (tree, node, up), 1, 2, 4, ... up; and tree, node, total, steps of root paths."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known")).distinct()
    now = checkpoint(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("steps")))
    most = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    tables, reach = [], 1
    done, active = now.where("up is null"), now.where("up is not null")
    while reach <= most and not active.isEmpty():
        tables.append(active.select("tree", "node", "up"))
        # Only messages whose jump has not passed the root take part; there are fewer of them each time.
        above = done.unionByName(active).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        now = checkpoint(active.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("steps") + F.col("_steps")).alias("steps")))
        done, active = done.unionByName(now.where("up is null")), now.where("up is not null")
        reach *= 2
    return tables, done.select("tree", "node", "total", "steps")


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """tree, node, parent, score -> tree, leaf, rank, node, place (0 at the root) of the top paths of each tree."""
    nodes = messages.select("tree", "node", "parent", "score")
    tables, roots = jumps(nodes)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = roots.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    found = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("steps") - 1).alias("place"))
    for k in reversed(range(len(tables))):
        up = found.join(tables[k], ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        found = checkpoint(found.unionByName(up))
    return found


_FORMATTED = "tree long, leaf long, rank int, formatted string, loss array<struct<start:long,end:long>>"


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """tree, node, parent, role, text, score -> one row per chosen path: tree, leaf, rank, formatted, loss."""
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths(messages, top).join(texts, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([text for text, _ in done], pa.string()), loss], ["tree", "leaf", "rank", "formatted", "loss"])

    return turns.select("tree", "leaf", "rank", "turns").mapInArrow(run, _FORMATTED)


def linear(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> messages of trees without branches; the score is the length of the text."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("tree"), nth.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length(F.coalesce("text", F.lit(""))).cast("double"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(done: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for tree, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((None if tree == -(2**63) else tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in _DIGESTS.split(", ")])

    return done.select("tree", "formatted", "loss").mapInArrow(run, _DIGESTS)
