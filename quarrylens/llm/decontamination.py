"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as words: runs of letters, digits and marks in lower case, each
character of scripts without blanks a word of its own. An item of m words may differ
by k = m // 5 word edits. Split into k + 1 pieces, one piece of any such match is
intact, so exact hits of pieces (found for all items at once by one automaton pass
over the document) give every candidate place; Myers' bit-parallel edit distance over
the words around the hit decides. A document holds an item when some stretch of it is
within k edits.

The benchmark is read in blocks of at most ``block_items`` items and
``block_words`` words, and each block's automaton is broadcast (about 100 bytes a
word, 20 MB at most), so a large benchmark means more passes, not larger ones.

Defined results: null and wordless texts, and wordless items, match nothing; items
alike are reported each; one row per document row and item, the least distance and
the first place with it; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BLOCK_ITEMS, BLOCK_WORDS = 5_000, 200_000
WORDS = re.compile("[^\\W぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]")
HITS = "doc_id long, item_id long, distance int, budget int, first_word long, last_word long"


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def budget(m: int) -> int:
    return m // 5


def split_pieces(item: list[str]) -> list[tuple[int, list[str]]]:
    """(place in the item, words) of budget + 1 pieces whose sizes differ by one at most."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of pattern to a stretch of text, and the place after the first such stretch."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, list[str]]]):
        import ahocorasick

        self.items = items
        places = defaultdict(list)
        for n, (_, item) in enumerate(items):
            for at, piece in split_pieces(item):
                places[f" {' '.join(piece)} "].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (piece, found))
        self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple]:
        """(item_id, distance, budget, first word, last word) of each item that the text holds."""
        own = words(text)
        if not own:
            return []
        line = f" {' '.join(own)} "
        windows: dict[int, set] = defaultdict(set)
        blanks: list[int] = []  # the places before words
        for end, (piece, found) in self.automaton.iter(line):
            if not blanks:
                blanks = list(accumulate((len(w) + 1 for w in own), initial=0))
            word = bisect_left(blanks, end + 1 - len(piece))
            for n, at in found:
                windows[n].add(word - at)
        out = []
        for n, starts in windows.items():
            item_id, item = self.items[n]
            m, k = len(item), budget(len(item))
            best = (k + 1, 0, 0)
            merged: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(own), s + m + k)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                distance, end = myers(item, own[a:b])
                if distance < best[0]:
                    best = (distance, a, a + end)
                    if not distance:  # none is nearer, and those behind are not first
                        break
            if best[0] <= k:
                distance, a, end = best
                back, length = myers(item[::-1], own[a:end][::-1])
                out.append((item_id, distance, k, end - length if back == distance else a, end - 1))
        return out


def blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with words, a block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        item = words(row["text"])
        if not item:
            continue
        if block and (len(block) >= block_items or size + len(item) > block_words):
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row and item it holds: HITS."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None

    def against(items: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            matcher = Matcher(shared.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.match(text.as_py())]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "budget", "first_word", "last_word"])

        return texts.mapInArrow(run, HITS)

    for items in blocks(benchmark, block_items, block_words):
        part = against(items)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS) if out is None else out


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([not matcher.match(t) for t in texts], dtype=bool)

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, decided on the row's own text; all columns stay.

    Each block of the benchmark filters in place, so texts are not shuffled.
    """
    spark = docs.sparkSession
    names = docs.columns
    out = docs
    for items in blocks(benchmark):
        out = out.where(_is_clean(spark.sparkContext.broadcast(items))(F.col("text")))
    return out.select(*names)
