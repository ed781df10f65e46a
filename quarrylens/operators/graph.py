"""The import graph: reach, cycles, depth, impact. edges: src, dst (src imports dst).

All of it is joins with reliable checkpoints; nothing is collected. Cycles, depth and impact go a few plain steps, which end most graphs. Deeper
ones are contracted (``contracted``): independent nodes of few edges go, and an edge takes the place of each way through one. Chains, trees and narrow
ladders are gone after a number of rounds that grows with the logarithm of their length; what is left is dense, so that few steps cross it. Values
(``Ways.spread``) go through the rounds once forward, over the rest until nothing moves, and once backward; tables of pairs that reach each other are made only below bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import measures, paths
from ..sources.storage import cut, dealt


def closure(edges: DataFrame, each: int | None = None) -> DataFrame | None:
    """src, dst for every path of one edge or more: as many rows as there are such pairs, for graphs where these are few.

    each: None is returned, before the join is run, where a step would join more than so many rows for each edge.
    """
    known = cut(edges.select("src", "dst").distinct())
    n = first = known.count()
    while True:
        if each is not None:
            into, out = known.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), known.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
            if (into.join(out, "node").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0) > each * first:
                return None
        further = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        known = cut(known.union(further).distinct())
        now = known.count()
        if now == n:
            return known
        n = now


#: Contraction ends when a round would touch a smaller share of the edges than this one.
LEAST_SHARE = 0.05


def contracted(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """edges a, b, w (length) -> rounds of edges at nodes that went, with a_gone and b_gone, and the edges that are left.

    Nodes go whose ways through are at most twice their edges, so the graph doesn't fill; of neighbours that fit, only the one
    of the least hash in this round. Paths of what is left, and their greatest lengths, are kept. Loops are dropped.
    """
    rounds: list[DataFrame] = []
    left = cut(edges.where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")))
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        fit = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o * i <= 2 * (o + i)").select("node", F.struct(F.xxhash64("node", F.lit(len(rounds))), "node").alias("p"))
        both = left.join(fit.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(fit.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        gone = fit.select("node").join(both.select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("node")).distinct(), "node", "left_anti")
        flag = lambda c, gone=gone: gone.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_gone"))
        marked = cut(left.join(flag("a"), "a", "left").join(flag("b"), "b", "left").select("a", "b", "w", F.coalesce("a_gone", F.lit(False)).alias("a_gone"), F.coalesce("b_gone", F.lit(False)).alias("b_gone")))
        n = marked.agg(F.count("*").alias("n"), F.count_if(F.col("a_gone") | F.col("b_gone")).alias("touched")).first()
        if n["touched"] == 0 or n["touched"] < n["n"] * LEAST_SHARE:
            return rounds, left
        rounds.append(marked.where("a_gone or b_gone"))
        through = marked.where("b_gone").select("a", F.col("b").alias("node"), "w").join(marked.where("a_gone").select(F.col("a").alias("node"), "b", F.col("w").alias("further")), "node").select("a", "b", F.col("w") + F.col("further"))
        left = cut(marked.where("not a_gone and not b_gone").select("a", "b", "w").union(through).where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")))


def gone_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.when(F.col("a_gone"), F.col("a")), F.when(F.col("b_gone"), F.col("b")))).alias("node")).where("node is not null").distinct()


#: Plain steps before a graph is contracted.
PLAIN = 64


class Ways:
    """Edges a, b, w along which values spread, contracted once when some value needs it."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    @cached_property
    def parts(self) -> tuple[list[DataFrame], DataFrame]:
        return contracted(self.edges)

    def spread(self, own: DataFrame, keys: list[str], gathered: Column, sent: Column) -> DataFrame:
        """What reaches each node: own (node, keys, value) and all that comes along edges; a node may have a row per keys.

        gathered: an aggregate of value that takes repeats (greatest, least, or); sent: what goes along an edge, of value and w.
        """
        by = ["node", *keys]
        send = lambda values, edges: values.withColumnRenamed("node", "a").join(edges.select("a", "b", "w"), "a").select(F.col("b").alias("node"), *keys, sent.alias("value"))
        gather = lambda rows: rows.groupBy(*by).agg(gathered.alias("value"))

        def steps(values: DataFrame, edges: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
            """Until nothing moves, or so many steps; only what moved in the last one is sent on."""
            moved = values
            while most is None or most > 0:
                came = send(moved, edges).withColumn("was", F.lit(None).cast(values.schema["value"].dataType))
                both = values.withColumn("was", F.col("value")).select(came.columns).union(came)
                now = cut(both.groupBy(*by).agg(gathered.alias("value"), F.first("was", ignorenulls=True).alias("was")).withColumn("moved", ~F.col("value").eqNullSafe(F.col("was"))).drop("was"))
                values, moved = now.drop("moved"), now.where("moved").drop("moved")
                if moved.isEmpty():
                    return values, True
                most = most and most - 1
            return values, False

        alive, settled = steps(cut(gather(own.select(*by, "value"))), self.edges, PLAIN)
        if settled:
            return alive
        rounds, rest = self.parts
        finished = []
        for edges in rounds:
            gone = gone_nodes(edges)
            finished.append(alive.join(gone, "node", "left_semi"))
            alive = cut(gather(alive.join(gone, "node", "left_anti").union(send(finished[-1], edges.where("a_gone")))))
        if not rest.isEmpty():
            alive, _ = steps(alive, rest, None)
        for edges, values in zip(reversed(rounds), reversed(finished)):
            alive = alive.union(cut(gather(values.union(send(alive, edges.where("b_gone"))))))
        return alive


def core(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """The edges between nodes that have some edge in and some edge out, again and again: all cycles are in it. True if no more can go; most: so many cuts."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    peeled = lambda e: e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    while n and most != 0:
        left = cut(peeled(left))
        now = left.count()
        if now == n:
            return left, True
        n = now
        most = most and most - 1
    return left, n == 0


#: Cores of no more edges are closed: at most 4 million pairs.
CLOSURE_EDGES = 2_000


def coloured(left: DataFrame) -> DataFrame:
    """node, mate of a core's strongly connected components of two nodes or more, by colours.

    Every node takes the least node that reaches it for its colour. A node of its own colour is the least of its component, which is
    what reaches it within the colour. Those go, and the core of the rest is coloured anew.
    """
    done = None
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        along = Ways(left.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("w")))
        colour = along.spread(nodes.withColumn("value", F.col("node")), [], F.min("value"), F.col("value")).withColumnRenamed("value", "colour")
        side = lambda c, as_, colour=colour: colour.select(F.col("node").alias(c), F.col("colour").alias(as_))
        within = cut(left.join(side("src", "c"), "src").join(side("dst", "c"), ["dst", "c"]).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("w")))
        members = cut(Ways(within).spread(colour.where("node = colour").select("node", F.col("colour").alias("value")), [], F.min("value"), F.col("value")).withColumnRenamed("value", "mate"))
        done = members if done is None else done.unionByName(members)
        rest = left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        left, _ = core(rest.select("src", "dst"))
    if done is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("mate")).limit(0)
    return done


def mates_of_core(left: DataFrame) -> DataFrame:
    """node, mate of a core, nodes that are their own mate left out: closed where it is small, coloured else."""
    if left.count() > CLOSURE_EDGES:
        return coloured(left).where("node <> mate")
    reach = closure(left)
    both = reach.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    return both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("mate")).where("node <> mate")


def strong(edges: DataFrame) -> DataFrame:
    """node, mate of the nodes (src, dst) in strongly connected components of two nodes or more; a component has one mate, and nodes that are their own one are left out.

    A node that was contracted belongs to a component where ways in and out of it have the same one, which the nodes that went after it know.
    """
    left, settled = core(edges, PLAIN)
    if settled:
        return cut(mates_of_core(left))
    rounds, rest = contracted(left.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("w")))
    mates = cut(mates_of_core(core(rest.select(F.col("a").alias("src"), F.col("b").alias("dst")))[0]))
    for marked in reversed(rounds):
        known = lambda c, mates=mates: mates.select(F.col("node").alias(c), "mate")
        before = marked.where("b_gone").join(known("a"), "a", "left").select(F.col("b").alias("node"), F.coalesce("mate", "a").alias("mate"))
        after = marked.where("a_gone").join(known("b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("mate", "b").alias("mate"))
        mates = mates.union(cut(before.join(after, ["node", "mate"], "left_semi").distinct()))
    return mates


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle (its least node), size of every strongly connected component of two nodes or more."""
    mates = strong(edges)
    members = cut(mates.union(mates.select("mate", "mate")).distinct())
    named = members.groupBy("mate").agg(F.min("node").alias("cycle"), F.count("*").alias("size"))
    return members.join(named, "mate").select("node", "cycle", "size")


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, c (its cycle, or itself) of all nodes of edges (src, dst), and the edges a, b between different ones."""
    of = cycles(edges).select("node", "cycle")
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(of, "node", "left").select("node", F.coalesce("cycle", "node").alias("c")))
    side = lambda at, c: nodes.select(F.col("node").alias(at), F.col("c").alias(c))
    return nodes, cut(edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a <> b").select("a", "b").distinct())


#: Bitmaps of 32,768 places that go through the graph together; more are further passes, so that a pass has a bounded size for each component.
TOGETHER = 8

#: Rows for each edge up to which pairs are joined: a bitmap takes the room of 256 of them.
PAIRS_EACH = 256


def reaching(ways: Ways, own: DataFrame) -> Iterator[DataFrame]:
    """own (node, kind, n: numbers from 1) -> passes of node, kind, bucket, value: bitmaps of the numbers that reach a node, its own included."""
    bucket = F.bitmap_bucket_number("n")
    last = own.agg(F.max(bucket)).first()[0] or 0
    for start in range(1, last + 1, TOGETHER):
        bits = own.where(bucket.between(start, start + TOGETHER - 1)).groupBy("node", "kind", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("value"))
        yield ways.spread(bits, ["kind", "bucket"], F.bitmap_or_agg("value"), F.col("value"))


def came_from_before(bits: DataFrame, dag: DataFrame, asked: DataFrame) -> DataFrame:
    """c, n of asked (c, n, bucket, bit) where some component before c has bit n."""
    before = bits.where("kind = 'folder'").withColumnRenamed("node", "a").join(dag.select("a", "b"), "a").groupBy(F.col("b").alias("c"), "bucket").agg(F.bitmap_or_agg("value").alias("value"))
    byte = F.conv(F.hex(F.substring("value", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return asked.join(before, ["c", "bucket"]).where(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1).select("c", "n")


def impact(edges: DataFrame, files: DataFrame) -> DataFrame:
    """fid, impact, impact_folders: files, and their folders, that import a file in any number of steps. Tests and vendored files do not count.

    Where pairs take less room than bitmaps they are joined. Else importers and folders are numbered, and their bitmaps go along the condensed graph. A file doesn't count for itself: nor does
    its folder, unless another file of the folder is in its component or the folder comes from outside the component.
    """
    ok = files.where(~paths.is_test(F.col("rel")) & ~paths.is_vendored(F.col("rel"))).select(F.col("fid").alias("src"), paths.folder(F.col("rel")).alias("folder"))
    edges = cut(edges.join(ok.select("src"), "src", "left_semi").where("src <> dst").select("src", "dst").distinct())
    pairs = closure(edges, PAIRS_EACH)
    if pairs is not None:
        counted = pairs.where("src <> dst").join(ok, "src").groupBy(F.col("dst").alias("fid")).agg(F.count("*").alias("impact"), F.countDistinct("folder").alias("impact_folders"))
        return files.select("fid").join(counted, "fid", "left").na.fill(0)
    nodes, dag = condensed(edges)
    ways = Ways(dag.withColumn("w", F.lit(1)))
    sources = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(ok.withColumnRenamed("src", "node"), "node")
    numbers = measures.numbered(sources, [F.col("node")], "n").select("node", "c", "folder", "n")
    places = measures.numbered(numbers.select("folder").distinct(), [F.col("folder")], "n").select("folder", "n")
    within = cut(numbers.groupBy("c", "folder").agg(F.count("*").alias("mates")).join(places, "folder"))
    kind = lambda k: F.lit(k).alias("kind")
    bits = list(reaching(ways, cut(numbers.select(F.col("c").alias("node"), kind("file"), "n").union(within.select(F.col("c").alias("node"), kind("folder"), "n")))))
    sums = lambda k: F.sum(F.when(F.col("kind") == k, F.bitmap_count("value")).otherwise(0))
    reached = reduce(DataFrame.union, bits).groupBy(F.col("node").alias("c")).agg(sums("file").alias("files"), sums("folder").alias("folders"))
    # A component's only file of a folder: does the folder come from outside, too?
    lone = within.where("mates = 1").select("c", "folder", "n", F.bitmap_bucket_number("n").alias("bucket"), F.bitmap_bit_position("n").alias("bit"))
    came = reduce(DataFrame.union, [came_from_before(b, dag, lone) for b in bits])
    alone = lone.join(came, ["c", "n"], "left_anti").select("c", "folder", F.lit(1).alias("alone"))
    told = nodes.join(numbers.select("node", "folder", F.lit(1).alias("self")), "node", "left").join(reached, "c", "left").join(alone, ["c", "folder"], "left").na.fill(0)
    return files.select("fid").join(told.select(F.col("node").alias("fid"), (F.col("files") - F.col("self")).alias("impact"), (F.col("folders") - F.col("alone")).alias("impact_folders")), "fid", "left").na.fill(0)


def import_depth(edges: DataFrame) -> DataFrame:
    """fid, depth: the longest import chain below a file, a cycle counting as one place."""
    edges = cut(edges.select("src", "dst").distinct())
    nodes, dag = condensed(edges)
    ways = Ways(dag.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("w")))
    depth = ways.spread(nodes.select(F.col("c").alias("node"), F.lit(0).alias("value")), [], F.max("value"), F.col("value") + F.col("w"))
    return nodes.join(depth.select(F.col("node").alias("c"), F.col("value").alias("depth")), "c").select(F.col("node").alias("fid"), "depth")


def blast_radius(edges: DataFrame, start: list[int], hops: int = 4) -> DataFrame:
    """fid, hop: importers of start within so many steps, at their least distance."""
    spark = edges.sparkSession
    found = spark.createDataFrame([(i, 0) for i in start], "fid long, hop int")
    front = found
    for hop in range(1, hops + 1):
        near = edges.join(front.select(F.col("fid").alias("dst")), "dst").select(F.col("src").alias("fid")).distinct()
        front = cut(near.join(found, "fid", "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(front)
    return found


def orphans(files: DataFrame, edges: DataFrame, history: DataFrame, head: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Code that nothing imports and nobody has touched for long, in a language whose imports resolve."""
    seen = edges.select(F.col("dst").alias("fid")).distinct()
    resolved = files.join(seen, "fid", "left_semi").select("language").distinct()
    idle = files.join(resolved, "language", "left_semi").join(seen, "fid", "left_anti").join(history.select("fid", "last_t"), "fid").crossJoin(F.broadcast(head))
    idle = idle.where(~paths.is_test(F.col("rel")) & ~paths.is_config(F.col("rel")) & ~paths.is_vendored(F.col("rel")))
    idle = idle.withColumn("idle_days", F.greatest(F.lit(0.0), (F.col("head") - F.col("last_t")) / 86400.0))
    return idle.where(F.col("idle_days") >= th.stale_days).select("fid", "rel", "idle_days")


def resolved(imports: DataFrame, probes: DataFrame, order: Column) -> DataFrame:
    """rel, spec, key with key, n, dst of all files that a key may mean -> src, spec, dst: the first in order that is not the importer.

    A name is looked up once, however many files import it, and its few candidates go to the imports.
    """
    found = probes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "dst"))).alias("found"))
    dst = F.get(F.filter("found", lambda x: x["dst"] != F.col("rel")), F.lit(0))["dst"]
    return imports.join(found, "key").select(F.col("rel").alias("src"), "spec", dst.alias("dst")).where("dst is not null")


def resolve_python(imports: DataFrame, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """fid, rel, spec (a dotted name, leading dots are relative) -> src, spec, dst: the longest prefix that is a module, not itself.

    tasks: how many the imports are dealt to.
    """
    modules = files.where(F.col("rel").endswith(".py")).select(F.col("rel").alias("dst"), F.replace(F.regexp_replace("rel", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit(".")).alias("module"))
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    rest = F.regexp_replace("spec", r"^\.+", "")
    base = F.slice(paths.dirs_of(F.col("rel")), F.lit(1), F.greatest(F.lit(0), F.size(paths.dirs_of(F.col("rel"))) - F.greatest(F.lit(0), dots - 1)))
    names = F.filter(F.concat(F.when(dots > 0, base).otherwise(F.array().cast("array<string>")), F.split(rest, r"\.")), lambda x: x != "")
    steps = dealt(imports.select("rel", "spec"), tasks, "rel", "spec").distinct().select("rel", "spec", names.alias("key")).where(F.size("key") > 0)
    probes = steps.select("key").distinct().select("key", F.explode(F.sequence(F.lit(1), F.size("key"))).alias("n")).select("key", "n", F.array_join(F.slice("key", F.lit(1), F.col("n")), ".").alias("module"))
    return resolved(steps, probes.join(modules, "module"), -F.col("n"))


#: What may be missing at the end of a path import, in the order of trial.
SUFFIXES = ("", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")


def normal_path(path):
    """A path without . and .. segments."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) == 0), F.array(x)).otherwise(F.when((F.size(acc) == 0), F.when(x.isin("", "."), acc).otherwise(F.array(x))).otherwise(step(acc, x)))), "/")


def resolve_relative(imports: DataFrame, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """rel, spec (./ or ../) -> src, spec, dst: the first suffix that makes it a file, not itself. tasks: how many the imports are dealt to."""
    joined = normal_path(F.concat_ws("/", paths.folder(F.col("rel")), F.col("spec")))
    # The key is made before the shuffle, so that it is made once for both uses; as it can't be null, no filter makes it again.
    steps = dealt(imports.select("rel", "spec", F.coalesce(joined, F.lit("")).alias("key")), tasks, "rel", "spec").distinct()
    probes = steps.select("key").distinct().select("key", F.posexplode(F.array(*[F.concat("key", F.lit(s)) for s in SUFFIXES])).alias("n", "dst"))
    return resolved(steps, probes.join(files.select(F.col("rel").alias("dst")), "dst"), F.col("n"))
