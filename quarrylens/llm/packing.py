"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised, closed with id 1, and cut at the sequence length. Best-fit
decreasing takes pieces from the longest to the shortest and puts each into the open
sequence with the least room that suffices. The outcome depends on the lengths alone,
and lengths are integers up to the sequence length, so the whole table is packed as
one: the driver gets the number of pieces of each length (``capacity`` numbers at
most), packs runs of equal lengths by the tree, and broadcasts the plan. Each piece
then looks up its sequence by its length and its rank among the pieces of that
length, which is counted in hash buckets so that no length is ever in one task.

Size of the plan: a run of sequences is filled alike, each visit of a length adds a
piece to every sequence of the run, one length splits one run at most, and a sequence
holds at most ``sqrt(2 * capacity)`` different lengths. That bounds the plan by
2 * capacity * sqrt(2 * capacity) rows (0.74 million for 4096, 30 MB), whatever the
number of documents.

The tokeniser sees each chunk between blanks once per worker: no token spans a blank,
special strings hold none, and normalisation does not reach over one, so the ids of a
text are those of its chunks in order. Chunks in Latin letters are made from their lower-case words. The
caches of chunks and of words have two generations of ``cache`` entries (``CACHE``, about 70 MB a
worker; 1.2 million take 280 MB and a third less time): a full one becomes the old one, and
what is used again moves over, so frequent words stay.

Defined results: null text is empty and yields the closing id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, checkpoint, tidy

CAPACITY = 4096
CLOSING_ID = 1
CACHE = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SegmentTree:
    """Over capacities 0..size-1: which have an open run of sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.open = bytearray(2 * self.leaves)

    def set(self, at: int, is_open: bool) -> None:
        at += self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest open capacity of at least least, or -1; climbs, then descends."""
        if least >= self.leaves:
            return -1
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return -1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset of the first) by length and rank.

    Pieces of one length with ranks from the first rank on fill a run of sequences in order.
    """
    tree, runs, rows, opened = SegmentTree(capacity + 1), {}, [], 0

    def push(room: int, sequence: int, n: int) -> None:
        if room and n:
            runs.setdefault(room, []).append((sequence, n))
            tree.set(room, True)

    for length in sorted((k for k in counts if counts[k]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                sequence, n = opened, -(-left // each)
                opened += n
            else:
                sequence, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
                each = room // length
            full, part = min(n, left // each), 0
            if full < n:
                part = left - full * each
            rows.append((length, rank, sequence, each, capacity - room))
            push(room - each * length, sequence, full)
            if part:
                push(room - part * length, sequence + full, 1)
            rest = full + bool(part)
            push(room, sequence + rest, n - rest)
            rank, left = rank + full * each + part, left - full * each - part
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


@functools.cache
def chunk_ids(path: str, entries: int):
    """A function from a text to its ids as little-endian uint32 bytes. Kept for the life of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    # For single lower-case words there is nothing to normalise or to split.
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
    fence, fence_id = (added[-1], tokenizer.token_to_id(added[-1])) if added else ("", -1)
    begins = {t.content[0] for t in tokenizer.get_added_tokens_decoder().values()}
    chunks_of: dict[str, bytes] = {"": b""}
    words_of: dict[str, bytes] = {}
    old_chunks: dict[str, bytes] = {}
    old_words: dict[str, bytes] = {}

    def encoded(texts: list[str], how: Tokenizer) -> Iterator[bytes]:
        """The ids of each text; a special token between them keeps them apart in one call."""
        if not fence:
            for e in how.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()
            return
        for at in range(0, len(texts), 128):
            got = np.array(how.encode_batch_fast([fence.join(texts[at : at + 128])], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(got == fence_id)).tolist()
            data = got.tobytes()
            for x, y in zip([0, *[c + 4 for c in cuts]], [*cuts, len(data)], strict=True):
                yield data[x:y]

    def learn(chunks: set[str]) -> None:
        """Chunks of Latin letters, with a comma or stop behind them or not, are made from their words; others are encoded whole."""
        simple, other, new = [], [], set()
        for chunk in chunks:
            if (known := old_chunks.get(chunk)) is not None:
                chunks_of[chunk] = known
                continue
            word, tail = chunk.lower(), ""
            if not word.isalpha() and word[-1] in ",.":
                word, tail = word[:-1], word[-1]
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                simple.append((chunk, word, tail))
                if word not in words_of:
                    if (known := old_words.get(word)) is not None:
                        words_of[word] = known
                    else:
                        new.add(word)
            else:
                other.append(chunk)
        fresh = [*new, *(t for t in ",." if t not in words_of)]
        words_of.update(zip(fresh, encoded(fresh, bare), strict=True))
        for chunk, word, tail in simple:
            chunks_of[chunk] = words_of[word] + words_of[tail] if tail else words_of[word]
        plain = [c for c in other if begins.isdisjoint(c)]
        chunks_of.update(zip(plain, encoded(plain, tokenizer), strict=True))
        for chunk in other:
            if not begins.isdisjoint(chunk):  # it may hold a special token
                chunks_of[chunk] = np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(text: str) -> bytes:
        nonlocal chunks_of, words_of, old_chunks, old_words
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join(map(chunks_of.__getitem__, chunks))
        except KeyError:
            if len(chunks_of) > entries:
                chunks_of, old_chunks = {"": b""}, chunks_of
            if len(words_of) > entries:
                words_of, old_words = {}, words_of
            learn({c for c in chunks if c not in chunks_of})
            return b"".join(map(chunks_of.__getitem__, chunks))

    return ids


CACHES.append(chunk_ids.cache_clear)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """One row per piece: PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep=chunk_ids.cache_clear)
        ids = chunk_ids(tokenizer_path, cache)
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(text.as_py() or "") + closing
                for n, at in enumerate(range(0, len(data), size)):
                    piece = data[at : at + size]
                    for column, value in zip(out, (doc, n, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, bucket_rows: int = 20_000, cache: int = CACHE) -> DataFrame:
    """PIECES with sequence_id and offset."""
    pieces = checkpoint(tokenised(docs, tokenizer_path, capacity, cache))
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = max(16, -(-sum(counts.values()) // bucket_rows))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_nth", nth).join(starts, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        shift = np.int64(1) << 44
        keys = rows[:, 0] * shift + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            found = rows[np.searchsorted(keys, length * shift + rank, "right") - 1]
            step = rank - found[:, 1]
            sequence = found[:, 2] + step // found[:, 3]
            offset = found[:, 4] + step % found[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
