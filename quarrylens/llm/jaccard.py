"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Row d of the incidence matrix A has a one for each distinct five-word shingle of
document d (64-bit hashes; two different shingles of one pair of documents collide
with probability about 1e-12). Entries of A A' are overlaps. Two documents link when
their overlap is at least 3/4 of their union, which bounds what has to be multiplied:

* documents with equal rows form one class, and its least doc_id stands for it;
* sizes must be within 3/4 of each other;
* of n shingles in any common order, two linked documents share one of their first
  n - ceil(3n/4) + 1, and k of their first n - ceil(3n/4) + k, here with k = n / 10. Only those
  columns of A are multiplied, and pairs whose overlap in them stays below k are discarded. The order is by counted
  document frequency: n-grams in more than ``HOT`` documents (the ``HOT_TABLE``
most frequent of them, a broadcast of 16 MB at most) come last, by frequency. The order
decides the work, never the result.

Columns without a place in the table give their pairs directly, also those of more than ``HOT`` documents that it had
no room for, the least frequent first, up to ``PAIRED`` documents and ``PAIRS`` for each document of the table: the least
frequent are mostly common words that meet by chance, where stars link nothing. Of a hot column, and of one that is longer
than that, only
the star around one document is multiplied at first; after linking, columns that lie in
one component need no more work. Those that do not are joined into groups, and in each the
documents outside its largest component are multiplied with all, in blocks of rows. Documents with the
same most frequent column lie in the same blocks, and only blocks that have a column in common meet.
A task gets two blocks of shingle sets, multiplies the columns that both have (those of few entries by
expansion, dense ones as matrices), drops overlaps below the bound, and emits a
spanning forest of what links. So a group of copies of any size costs a star, not its
square, and no link between different components is missed.

Defined results: null text is empty; texts without words have no shingles and link with
nothing; fewer than five words are one shingle; rows alike are linked; rows with a null
doc_id get no component; an empty table gives an empty result; other columns are
ignored by ``labelled`` and carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions, stored, tidy
from .components import components, relabelled

GRAM = 5
#: Two documents link from so many hundredths of their union on.
PERCENT = 75
SHARED = 10
HOT = 16
HOT_TABLE = 1_000_000
#: Columns that the table has no room for give their pairs up to so many documents, and so many pairs for each document (about a third lie in prefixes, 20 bytes each).
PAIRED, PAIRS = 256, 512
FLUSH = 1 << 19
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 2048
#: Groups of fewer than SPREAD full blocks are cut into about so many smaller ones, though not below SMALL_ROWS, so that several tasks share them.
SPREAD, SMALL_ROWS = 8, 256
BROADCAST_IDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


_NONSPACE = np.ones(256, bool)
_NONSPACE[[32, *range(9, 14)]] = False
#: A number for each byte, A-Z sharing those of a-z.
_BYTES = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SLICE = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, a slice of an Arrow column at a time."""

    def __init__(self, gram: int = GRAM):
        self.gram, self.powers = gram, np.ones(1, np.uint64)

    def _power(self, n: int) -> np.ndarray:
        while len(self.powers) < n:
            step = np.multiply.accumulate(np.full(len(self.powers), _MULTIPLIER, np.uint64))[-1]
            self.powers = np.concatenate([self.powers, self.powers * step])
        return self.powers

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and how many words precede each start. starts: where texts begin in data, from 0."""
        if len(starts) == 1 and len(data) > 2 * _SLICE:  # a very long text: slices cut at white space
            cuts, at = [], 0
            while at < len(data):
                spaces = np.flatnonzero(~_NONSPACE[data[at + _SLICE : at + 2 * _SLICE]])
                end = at + _SLICE + int(spaces[0]) if len(spaces) else len(data)
                cuts.append((at, end))
                at = end
            if len(cuts) > 1:
                return np.concatenate([self._words(data[x:y], starts)[0] for x, y in cuts]), np.zeros(1, np.int64)
        at = np.flatnonzero(_NONSPACE[data])
        if not len(at):
            return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        begin = np.searchsorted(at, starts)
        first[begin[begin < len(at)]] = True
        word = np.flatnonzero(first)
        sizes = np.diff(np.append(word, len(at)))
        place = np.arange(len(at)) - np.repeat(word, sizes)
        h = np.add.reduceat(_BYTES[data[at]] * self._power(int(sizes.max()))[place], word)
        return _mixed(h + sizes.astype(np.uint64) * _MULTIPLIER), np.searchsorted(word, begin)

    def _slice(self, data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        w, first = self._words(data, starts)
        n, gram = len(w), self.gram
        grams = np.full(max(0, n - gram + 1), gram, np.uint64)
        for i in range(gram):
            grams = _mixed(grams * _MULTIPLIER + w[i : n - gram + 1 + i]) if len(grams) else grams
        for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
            if b - a >= gram:
                s = np.sort(grams[a : b - gram + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for x in w[a:b]:
                    h = _mixed(h * _MULTIPLIER + x)
                yield h
            else:
                yield np.empty(0, np.uint64)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        column = pc.fill_null(column, "").cast(pa.large_string())
        if not len(column):
            return
        _, where, data = column.buffers()
        where = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(where, where[i] + _SLICE, "right")) - 1)
            j = min(j, len(column))
            yield from self._slice(data[where[i] : where[j]], where[i:j] - where[i])
            i = j


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def shared_least(n: int) -> int:
    """How many shingles two linked documents share among their first prefix_length + shared_least - 1."""
    return max(1, n // SHARED)


def digest(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64).tolist())


class Order:
    """The common order of n-grams: cold ones by hash, then hot ones by document frequency.

    limit: how long a cold column may be to give its pairs; None where none is longer.
    """

    def __init__(self, tokens: np.ndarray, frequency: np.ndarray, bits: int, limit: int | None = None):
        self.tokens, self.frequency, self.shift, self.limit = tokens, frequency, np.uint64(64 - bits), limit

    def _hot(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tokens):
            return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        short = s >> self.shift
        at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
        return self.tokens[at] == short, at

    def cold(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The cold n-grams of the long prefix of s, and how many hot ones it has behind them."""
        p = min(len(s), prefix_length(len(s)) + shared_least(len(s)) - 1)
        cold = s[~self._hot(s)[0]][:p]
        return cold, p - len(cold)

    def hot(self, s: np.ndarray) -> np.ndarray:
        """The hot n-grams of the prefix of s."""
        hot, at = self._hot(s)
        rest = s[hot]
        few = prefix_length(len(s)) - (len(s) - len(rest))
        if few <= 0:
            return s[:0]
        return rest[np.lexsort((rest, self.frequency[at[hot]]))[:few]]


def _out(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_FEATURES = [("doc", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("hot", pa.list_(pa.int64()))]
_POSTING = [("g", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("h", pa.int32())]
_PAIR = [("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_()), ("c", pa.int64()), ("least", pa.int64())]
_COUNTS = [("bucket", pa.int32()), ("payload", pa.binary())]
_EDGE = [("a", pa.int64()), ("b", pa.int64())]


def hot_order(texts: DataFrame, hot: int = HOT, table: int = HOT_TABLE) -> Order:
    """Document frequency of every n-gram, counted over all documents; what is above hot, bounded, comes to the driver.

    Counts are combined inside each task and travel as compressed sorted arrays, about two
    bytes an n-gram. n-grams are told apart by ``bits`` bits, about 256 values for each
    n-gram; sharing a value only moves an n-gram in the order.
    """
    docs = max(1, texts.count())
    bits = min(62, max(36, (docs * 1000 * 64).bit_length()))
    buckets = 1 << max(6, min(20, bits - 32, (docs // 500).bit_length()), bits - 32)
    low = np.uint64(bits - buckets.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tidy()
        shingler, packer = Shingler(), zstandard.ZstdCompressor(1)
        parts, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(parts) >> np.uint64(64 - bits), return_counts=True)
            bucket = (tokens >> low).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            payload = []
            for a, b in zip(cuts, [*cuts[1:], len(tokens)], strict=True):
                rest = (tokens[a:b] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint32)
                payload.append(packer.compress(np.diff(rest, prepend=np.uint32(0)).astype(np.uint32).tobytes() + np.minimum(n[a:b], 2**32 - 1).astype(np.uint32).tobytes()))
            return _out(_COUNTS, bucket[cuts].astype(np.int32), payload)

        for s in (s for batch in batches for s in shingler.sets(batch.column(1))):
            key = digest(s)
            if not len(s) or key in seen:
                continue
            seen.add(key)
            parts.append(s)
            size += len(s)
            if size >= FLUSH:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        arrays = [np.frombuffer(unpacker.decompress(x.as_py()), np.uint32) for x in group.column("payload")]
        tokens = np.concatenate([np.cumsum(x[: len(x) // 2], dtype=np.uint32) for x in arrays])
        n = np.concatenate([x[len(x) // 2 :] for x in arrays]).astype(np.int64)
        by = np.argsort(tokens, kind="stable")
        tokens, n = tokens[by], n[by]
        cuts = np.flatnonzero(np.diff(tokens.astype(np.int64), prepend=-1))
        total = np.add.reduceat(n, cuts)
        keep = total > hot
        full = (np.int64(group.column("bucket")[0].as_py()) << np.int64(low)) | tokens[cuts][keep].astype(np.int64)
        return pa.table({"token": full, "df": total[keep]})

    found = texts.mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInArrow(merge, "token long, df long")
    found = checkpoint(found)
    every, full = found, found.count() > table
    if full:
        least = found.approxQuantile("df", [1 - table / found.count()], 0.001)[0]
        found = found.where(F.col("df") > least).orderBy(F.desc("df"), "token").limit(table)
    got = found.toArrow()
    tokens, df = got.column("token").to_numpy().astype(np.uint64), got.column("df").to_numpy()
    limit = None
    if full:  # what the table has no room for is no more frequent than anything in it
        longest = int(df.min()) if len(df) else int(least)
        some = every.where(F.col("df") <= min(longest, PAIRED)).groupBy("df").count().orderBy("df").toArrow()
        length, columns = (some.column(i).to_numpy() for i in range(2))
        within = length[np.cumsum(columns * length * (length - 1) // 2) <= PAIRS * docs]
        limit = max(hot, int(within.max(initial=0)))
        limit = None if len(within) == len(length) and longest <= PAIRED else limit
    by = np.argsort(tokens)
    return Order(tokens[by], df[by], bits, limit)


def features(texts: DataFrame, order) -> DataFrame:
    """doc, n, d1, d2 (digest of the shingle set), hot (hot n-grams of the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        shingler = Shingler()
        for batch in batches:
            out: list[list] = [[] for _ in _FEATURES]
            for doc, s in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1)), strict=True):
                hot = order.value.hot(s).view(np.int64).tolist() if len(s) else []
                for column, value in zip(out, (doc, len(s), *digest(s), hot), strict=True):
                    column.append(value)
            yield _out(_FEATURES, *out)

    return texts.mapInArrow(run, "doc long, n long, d1 long, d2 long, hot array<long>")


def cold_pairs(texts: DataFrame, order) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, star: pairs of compatible sizes whose overlap in cold columns does not rule a link out; g, doc, n: the rows of columns beyond the order's limit).

    Two linked documents share ``shared_least`` shingles in their long prefixes, and no more of them can be hot than
    the one has that has fewer; overlaps are summed up over all cold columns and pairs below that bound are discarded.
    Two that share a column beyond the limit are found there, and the bound holds for two that do not.
    star marks pairs with the least doc_id of a column; the others matter only if these do not connect them.
    """
    limit = order.value.limit

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        shingler, seen = Shingler(), set()
        for batch in batches:
            tokens, docs, sizes, hots = [], [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1)), strict=True):
                if not len(s) or doc is None or (key := digest(s)) in seen:
                    continue
                seen.add(key)
                cold, hot = order.value.cold(s)
                tokens.append(cold)
                docs.append(np.full(len(cold), doc, np.int64))
                sizes.append(np.full(len(cold), len(s), np.int32))
                hots.append(np.full(len(cold), hot, np.int32))
            if tokens:
                tokens, docs, sizes, hots = (np.concatenate(x) for x in (tokens, docs, sizes, hots))
                for at in range(0, len(tokens), 100_000):
                    part = slice(at, at + 100_000)
                    yield _out(_POSTING, tokens[part].view(np.int64), docs[part], sizes[part], hots[part])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]

        def summed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Pairs with their overlap in these columns; a key of both ids sorts them."""
            a, b, star, least = np.concatenate(found, axis=1)
            by = np.lexsort((b, a))
            a, b, star, least = a[by], b[by], star[by], least[by]
            cuts = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if len(a) else np.empty(0, np.int64)
            if len(cuts):
                yield _out(_PAIR, a[cuts], b[cuts], np.logical_or.reduceat(star.astype(bool), cuts), np.diff(np.append(cuts, len(a))), least[cuts])

        def pairs(g: np.ndarray, doc: np.ndarray, n: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(g):
                return
            cuts = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
            lengths = np.diff(np.append(cuts, len(g)))
            first = np.repeat(cuts, lengths)
            behind = np.repeat(cuts + lengths, lengths) - np.arange(len(g)) - 1  # each document with those behind it in its column
            upto = np.cumsum(behind)
            found, size, at = [], 0, 0
            while at < len(g):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FLUSH, "right")))
                w = behind[at:end]
                left = np.repeat(np.arange(at, end), w)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
                ok = (doc[left] != doc[right]) & (4 * np.minimum(n[left], n[right]) >= 3 * np.maximum(n[left], n[right]))
                left, right = left[ok], right[ok]
                least = np.maximum(1, np.minimum(n[left], n[right]) // SHARED) - np.minimum(h[left], h[right])
                found.append(np.stack([np.minimum(doc[left], doc[right]), np.maximum(doc[left], doc[right]), left == first[left], least]))
                size += len(left)
                at = end
                if size >= FLUSH:
                    yield from summed(found)
                    found, size = [], 0
            if found:
                yield from summed(found)

        def beyond(rows: list[np.ndarray]) -> pa.RecordBatch:
            g, doc, n, _ = rows
            return _out(_PAIR, doc, g, pa.nulls(len(g), pa.bool_()), n.astype(np.int64), np.zeros(len(g), np.int64))

        def within(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole columns: the long ones as they are, pairs of the others."""
            if limit is not None and len(rows[0]):
                _, of, counts = np.unique(rows[0], return_inverse=True, return_counts=True)
                long = counts[of] > limit
                if long.any():
                    yield beyond([x[long] for x in rows])
                    rows = [x[~long] for x in rows]
            yield from pairs(*rows)

        opened = None  # a long column that goes on
        for batch in batches:
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            if opened is not None and len(now[0]):
                more = int(np.searchsorted(now[0], opened, "right"))
                if more:
                    yield beyond([x[:more] for x in now])
                    now = [x[more:] for x in now]
                opened = opened if not len(now[0]) else None
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            rest = [x[last:] for x in now]
            if limit is not None and len(rest[0]) > limit:
                yield beyond(rest)
                opened, rest = rest[0][0], [x[:0] for x in rest]
            if last:
                yield from within([x[:last] for x in now])
        yield from within(rest)

    postings = texts.mapInArrow(post, "g long, doc long, n int, h int")
    columns = postings.repartition(partitions(texts.sparkSession), "g").sortWithinPartitions("g", "doc")
    found, long = columns.mapInArrow(multiply, "a long, b long, star boolean, c long, least long"), None
    if limit is not None:
        found = stored(found)
        long = found.where("star is null").select(F.col("b").alias("g"), F.col("a").alias("doc"), F.col("c").alias("n"))
        found = found.where("star is not null")
    sums = found.groupBy("a", "b").agg(F.max("star").alias("star"), F.sum("c").alias("c"), F.max("least").alias("least"))
    return sums.where("c >= least").select("a", "b", "star"), long


def overlaps(pairs: DataFrame, texts: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b that link, by the overlap of the whole sets of their texts (doc, text).

    The text of b travels with the pair, that of a meets it; pairs of one a come together, so its set is made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        shingler = Shingler(gram)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else np.empty(0, np.int64)
            own = list(shingler.sets(batch.column(2).take(pa.array(begins))))
            of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(a)))).tolist()
            keep = np.zeros(len(a), bool)
            for i, y in enumerate(shingler.sets(batch.column(3))):
                x = own[of[i]]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield _out(_EDGE, a[keep], b[keep])

    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return right.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc is in ids (distinct doc). Ids alone are broadcast, and only if few: 8 bytes each."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")


def encoded(texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc, text -> doc, shingles: the sorted set as bytes, eight for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        shingler = Shingler(gram)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingler.sets(batch.column(1))], pa.binary())], ["doc", "shingles"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, shingles binary")


def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right.

    Only columns that both sides have count. Those whose product has few entries are expanded,
    the others multiplied as dense slices; a column is dense in a slice of rows, so there are few of them.
    """
    na, nb = len(left), len(right)
    total = np.zeros(na * nb, np.int64)
    values = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    if not len(common):
        return total.reshape(na, nb)
    columns = []
    for k in range(2):
        at = np.minimum(np.searchsorted(common, values[k]), len(common) - 1)
        shared = common[at] == values[k]
        column, row = at[shared], rows[k][shared]
        by = np.argsort(column, kind="stable")
        columns.append(column[by])
        rows[k] = row[by]
    counts = [np.bincount(c, minlength=len(common)) for c in columns]
    begins = [np.cumsum(c) - c for c in counts]
    work = counts[0] * counts[1]
    dense = work * 64 > na * nb
    few = np.flatnonzero(~dense)
    upto = np.cumsum(work[few])
    at = 0
    while at < len(few):  # about FLUSH entries at a time
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FLUSH, "right")))
        cols = few[at:end]
        w = work[cols]
        nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        of = np.repeat(cols, w)
        i = rows[0][begins[0][of] + nth // counts[1][of]]
        j = rows[1][begins[1][of] + nth % counts[1][of]]
        cells, n = np.unique(i * nb + j, return_counts=True)
        total[cells] += n
        at = end
    many = np.flatnonzero(dense)
    total = total.reshape(na, nb)
    for at in range(0, len(many), 1024):
        place = np.full(len(common), -1)
        place[many[at : at + 1024]] = np.arange(len(many[at : at + 1024]))
        sides = []
        for k, size in enumerate((na, nb)):
            here = place[columns[k]]
            part = np.zeros((size, 1024), np.float32)
            part[rows[k][here >= 0], here[here >= 0]] = 1
            sides.append(part)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def block_links(open_rows: DataFrame, texts: DataFrame, bounded: Callable[[DataFrame], DataFrame], gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Links between documents of different components that share a hot column.

    open_rows: g, doc, n, comp. Columns joined by documents are a group. Documents outside the largest component of
    a group are multiplied with all of it, a block of rows by a block of rows. Blocks hold documents of
    sizes within a power of two, so a document meets blocks of one power or two, and documents of one home, the column
    of theirs that most have, lie in as few blocks as can hold them. Groups and homes are no more
    than hot n-grams, so tables by them are bounded where those are.
    """
    # n-grams are nodes beside the documents; their least document names the group.
    each = open_rows.groupBy("g").agg(F.min("doc").alias("m"), F.count("*").alias("c"))
    joined = open_rows.join(bounded(each), "g")
    group = components(joined.select(F.col("doc").alias("a"), F.col("m").alias("b")))
    docs = joined.groupBy("doc").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.struct("c", "g"))["g"].alias("home"))
    rows = checkpoint(docs.join(group.select(F.col("node").alias("doc"), F.col("label").alias("s")), "doc"))
    sizes = rows.groupBy("s", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("s").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    rows = rows.join(bounded(main), "s").withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("rare", F.col("comp") != F.col("main"))

    def size(n: Column) -> Column:
        """Rows of a block, in a group of n."""
        room = F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2.0), F.col("band") + 1)))
        return F.greatest(F.lit(8), F.least(room, F.greatest(F.lit(SMALL_ROWS), F.ceil(n / SPREAD))))

    homes = rows.groupBy("s", "band", "home").agg(F.count("*").alias("in_home"), F.sum(F.col("rare").cast("long")).alias("rare_in_home"))
    whole = Window.partitionBy("s", "band")
    upto = whole.orderBy("home").rowsBetween(Window.unboundedPreceding, 0)
    homes = homes.select("*", *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_from") for c in ("in_home", "rare_in_home")], *[size(F.sum(c).over(whole)).alias(f"{c}_per") for c in ("in_home", "rare_in_home")])

    def block(own: str) -> Column:
        """The homes of a group one after the other, the documents of each in the order of a hash, cut into blocks."""
        return F.floor((F.col(f"{own}_from") + F.pmod(F.xxhash64("doc"), F.col(own))) / F.col(f"{own}_per")).cast("int")

    placed = rows.join(bounded(homes), ["s", "band", "home"])
    placed = checkpoint(placed.select("s", "doc", "comp", "band", "rare", block("in_home").alias("ai"), F.when(F.col("rare"), block("rare_in_home")).alias("ri")))
    # Blocks that have a column in common, of compatible sizes.
    columns = open_rows.select("g", "doc").join(placed, "doc")
    rare_blocks = columns.where("rare").select("g", "s", F.col("band").alias("rb"), "ri").distinct()
    all_blocks = columns.select("g", F.col("band").alias("ab"), "ai").distinct()
    meet = checkpoint(rare_blocks.join(all_blocks, "g").where("abs(rb - ab) <= 1").select("s", "rb", "ri", "ab", "ai").distinct())
    sets = placed.join(encoded(among(texts, placed.select("doc")), gram), "doc")
    keys = ["s", "rb", "ri", "ab", "ai"]
    as_rare = sets.where("rare").select("s", F.col("band").alias("rb"), "ri", "comp", "shingles").join(meet, ["s", "rb", "ri"]).select(*keys, F.lit(True).alias("r"), "comp", "shingles")
    as_all = sets.select("s", F.col("band").alias("ab"), "ai", "comp", "shingles").join(meet, ["s", "ab", "ai"]).select(*keys, F.lit(False).alias("r"), "comp", "shingles")

    def multiply(table: pa.Table) -> pa.Table:
        def side(r: bool) -> tuple[np.ndarray, list[np.ndarray]]:
            t = table.filter(pa.array(table.column("r").to_numpy() == r))
            return t.column("comp").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]

        (ca, sa), (cb, sb) = side(True), side(False)
        a, b = [], []
        if len(sa) and len(sb):
            total = product(sa, sb)
            union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - total
            i, j = np.nonzero((100 * total >= percent * union) & (ca[:, None] != cb[None, :]))
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[up]
                return x

            for x, y in zip(ca[i].tolist(), cb[j].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    parent[rx] = ry
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return as_rare.unionByName(as_all).groupBy(*keys).applyInArrow(multiply, "a long, b long")


def labelled(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(hot_order(texts))
    each = checkpoint(features(texts, order))
    # Written before it is joined: a join of two tables alone can be split where one digest has very many rows.
    classes = checkpoint(each.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep")))
    member = checkpoint(each.join(classes, ["d1", "d2"], "left").select("doc", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc")).alias("rep"), F.when(F.col("doc") == F.col("rep"), F.col("hot")).otherwise(F.array().cast("array<long>")).alias("hot")))
    reps = member.where("doc <> rep").select("doc", "rep").distinct()

    def standing(pairs: DataFrame) -> DataFrame:
        """The pairs with each document replaced by the one that stands for its class."""
        for c in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("doc").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "star").groupBy("a", "b").agg(F.max("star").alias("star"))

    pairs, long = cold_pairs(texts, order)
    cold = checkpoint(standing(pairs))
    hot = member.where("doc = rep").dropDuplicates(["doc"]).select("doc", "n", F.explode("hot").alias("g"))
    n_hot = len(order.value.tokens)
    if long is not None:
        long = long.join(reps.select("doc", F.col("rep").alias("_r")), "doc", "left").select(F.coalesce("_r", "doc").alias("doc"), "n", "g").distinct()
        hot = hot.unionByName(long)
        n_hot += long.select("g").distinct().count()
    hot = checkpoint(hot)
    # Tables of one row a hot n-gram meet the rows of a very hot one by broadcast, unless there are very many hot ones.

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_hot <= BROADCAST_IDS else df

    centre = hot.groupBy("g").agg(F.min(F.struct(F.xxhash64("doc").alias("by"), "doc", "n")).alias("c"))
    stars = hot.join(bounded(centre), "g").where("doc <> c.doc and 4 * least(n, c.n) >= 3 * greatest(n, c.n)").select(F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b")).distinct()
    first = checkpoint(cold.where("star").select("a", "b").union(stars).distinct())
    needed = checkpoint(cold.select(F.col("a").alias("doc")).union(cold.select("b")).union(hot.select("doc")).distinct())
    own = stored(among(texts.withColumnRenamed("doc_id", "doc"), needed))
    links = checkpoint(overlaps(first, own))
    label = components(links)

    def current(rows: DataFrame, of: str, to: str) -> DataFrame:
        return rows.join(label.select(F.col("node").alias(of), F.col("label").alias("_l")), of, "left").withColumn(to, F.coalesce("_l", of)).drop("_l")

    left = current(current(cold.where("not star").select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    columns = checkpoint(current(hot, "doc", "comp"))
    mixed = columns.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
    open_rows = checkpoint(columns.join(bounded(mixed), "g").select("g", "doc", "n", "comp"))
    rest = current(current(overlaps(left, own), "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    if not open_rows.isEmpty():
        rest = rest.unionByName(block_links(open_rows, own, bounded))
    rest = checkpoint(rest.distinct())
    if not rest.isEmpty():  # links between components join whole components
        further = components(rest)
        label = relabelled(label, further).unionByName(further.join(label.select("node"), "node", "left_anti"))
    done = member.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return done.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), F.col("rep").alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, and those without one; all columns stay."""
    gone = labelled(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
