"""MinHash near-dedup: fast similarity sketches, banding, exact verification.

**Sketch** (fast similarity sketching, after Dahlgaard, Knudsen and Thorup). A set is thrown into t bins, round after
round, each round with a hash function of its own. A bin keeps its least value, and values of an earlier
round are less than those of a later one. The first t rounds send each element to a bin that is drawn from its hash, round t + i
sends all of them to bin i; a set stops after the round in which its last bin is filled. So every coordinate fills, no bin is copied from
another one, and the share of equal coordinates of two sets is concentrated around their similarity as if the
coordinates were drawn independently. A set of n elements takes about one round if n is
well above t log t, and t log t throws in all if it is small.

**Banding.** t = ``BANDS`` * ``ROWS`` coordinates; documents with the same coordinates in one band share a bucket. Two sets of similarity s
have no bucket in common with probability (1 - s^5)^45: 2e-8 at s = 0.8, less above.

**Verification** is exact, on full sets of two-word shingles, and no bucket is cut short:

1. documents with equal sets are one class, whose least doc_id stands for it;
2. every document is compared with one centre, of all buckets' centres (least hash) that it has the least, and then
   with the centres of its buckets that are not in its component by then;
3. a bucket whose documents all lie in one component needs no more. Of the others those of at most ``SMALL`` documents give their pairs
   across components; larger ones go through the blocked product of ``jaccard``, where two blocks of shingle sets meet in a
   task. Components are the same as if all pairs of all buckets had been compared.

Defined results: null and empty text have an empty set and are linked with nothing; a text of
one word has that word as its only shingle; repeated rows are of one class; a null doc_id gets its own number
of shingles, and null for component and kept; an empty table gives an empty result; other columns are ignored by
``labelled`` and carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored, tidy
from .components import components, relabelled
from .jaccard import BROADCAST_IDS, Shingler, among, block_links, digest, overlaps

GRAM, PERCENT = 2, 80
BANDS, ROWS = 45, 5
SMALL = 16
#: Shingles that are sketched together.
TOGETHER = 1 << 18
_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(32)


def _hashed(x: np.ndarray, seed: int) -> np.ndarray:
    h = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sketches(sets: list[np.ndarray], t: int = BANDS * ROWS) -> np.ndarray:
    """One row of t coordinates a set (none empty): the round in the upper half of each, the least value of its bin in the lower half."""
    bins = np.full(len(sets) * t, _EMPTY)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    going = np.arange(len(sets))
    for i in range(2 * t):
        h = _hashed(elements, i + 1)
        to = (((h >> _LOW) * np.uint64(t)) >> _LOW).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, owner * t + to, (np.uint64(i) << _LOW) | (h & np.uint64(2**32 - 1)))
        open_ = (bins.reshape(-1, t)[going] == _EMPTY).any(axis=1)
        if not open_.all():
            still = np.zeros(len(sets), bool)
            still[going[open_]] = True
            keep = still[owner]
            elements, owner, going = elements[keep], owner[keep], going[open_]
            if not len(going):
                break
    return bins.reshape(-1, t)


def buckets(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The bucket of each set in each band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = _hashed(h + parts[:, :, k], k + 1)
    return h.view(np.int64)


def features(texts: DataFrame) -> DataFrame:
    """doc, text -> doc, n, d1, d2 (size and digest of the shingle set), bands (a bucket for each; none if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        shingler = Shingler(GRAM)

        def out(docs: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            of = iter(buckets(sketches(full))) if full else iter(())
            d1, d2 = zip(*map(digest, sets), strict=True)
            columns = [pa.array(docs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([next(of) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc", "n", "d1", "d2", "bands"])

        for batch in batches:
            docs, sets, size = [], [], 0
            for doc, s in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1)), strict=True):
                docs.append(doc)
                sets.append(s)
                size += len(s)
                if size >= TOGETHER:
                    yield out(docs, sets)
                    docs, sets, size = [], [], 0
            if docs:
                yield out(docs, sets)

    return texts.select("doc", "text").mapInArrow(run, "doc long, n long, d1 long, d2 long, bands array<long>")


def _current(rows: DataFrame, label: DataFrame | None, of: str, to: str) -> DataFrame:
    """rows with the component that the document in column of has by now."""
    if label is None:
        return rows.withColumn(to, F.col(of))
    return rows.join(label.select(F.col("node").alias(of), F.col("label").alias("_l")), of, "left").withColumn(to, F.coalesce("_l", of)).drop("_l")


def _across(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """The pairs a, b whose documents are in different components."""
    return _current(_current(pairs, label, "a", "ca"), label, "b", "cb").where("ca <> cb").select("a", "b")


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after further links a, b between documents or components."""
    between = stored(_current(_current(links, label, "a", "ca"), label, "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return label if label is not None else between.select(F.col("a").alias("node"), F.col("b").alias("label"))
    further = components(between)
    if label is None:
        return further
    return stored(relabelled(label, further).unionByName(further.join(label.select("node"), "node", "left_anti")))


def _compatible(n: str, m: str):
    """Whether sizes allow for a link."""
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (g, comp, ...) of buckets whose documents lie in several components."""
    mixed = stored(rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g"))
    return rows.join(mixed, "g")


def linked(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """node, label: the components of the documents that have links; buckets: g, doc, n."""
    # Written before they are joined: a join of two tables alone can be split where one bucket has very many rows.
    centre = F.min(F.struct(F.xxhash64("doc").alias("by"), "doc", "n")).alias("c")
    centres = stored(buckets.groupBy("g").agg(F.count("*").alias("size"), centre).where("size > 1"))
    rows = stored(buckets.join(centres, "g").select("g", "doc", "n", "size", "c"))
    own = stored(among(texts, rows.select("doc").distinct()))
    pair = [F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b")]

    def stars(of: DataFrame) -> DataFrame:
        return of.where(F.col("doc") != F.col("c.doc")).where(_compatible("n", "c.n"))

    first = stored(stars(rows).groupBy("doc").agg(F.min("c").alias("c")).select(*pair).distinct())
    label = _joined(None, overlaps(first, own, GRAM, PERCENT))
    opened = stored(_mixed(_current(rows, label, "doc", "comp")))
    large, small = opened.where(F.col("size") > SMALL), opened.where(F.col("size") <= SMALL)
    each = small.groupBy("g").agg(F.collect_list(F.struct("doc", "n", "comp")).alias("all"))
    each = each.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.doc < y.doc and x.comp <> y.comp").where(_compatible("x.n", "y.n"))
    rest = each.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).unionByName(stars(large).select(*pair)).distinct()
    # A pair that was compared and did not link need not be compared again.
    rest = stored(_across(rest.join(first, ["a", "b"], "left_anti"), label))
    if not rest.isEmpty():
        label = _joined(label, overlaps(rest, own, GRAM, PERCENT))
    large = stored(_mixed(_current(large.select("g", "doc", "n"), label, "doc", "comp")))
    if large.isEmpty():
        return label
    n_large = large.select("g").distinct().count()
    return _joined(label, block_links(large, own, lambda df: F.broadcast(df) if n_large <= BROADCAST_IDS else df, GRAM, PERCENT))


def labelled(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    each = checkpoint(features(texts))
    classes = checkpoint(each.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep")))
    stands = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc"))
    member = each.join(classes, ["d1", "d2"], "left").select("doc", "n", stands.alias("rep"), F.when(F.col("doc") == stands, F.col("bands")).alias("bands"))
    member = checkpoint(member)
    rows = member.where("n > 0 and doc = rep").dropDuplicates(["doc"]).select(F.explode("bands").alias("g"), "doc", "n")
    label = linked(texts, rows)
    done = member.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("component_id", F.when(F.col("doc").isNotNull(), F.coalesce("label", "rep")))
    return done.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, and those without one; all columns stay."""
    gone = labelled(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
