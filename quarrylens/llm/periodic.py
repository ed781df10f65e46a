"""Periodic runs: stretches of words that repeat with a fixed period, found by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(24, 3q) words that no neighbouring word extends. In terms of the
lag q it is an island: at least max(24 - q, 2q) places in a row whose word equals the one q
places on. So a lag can hold a run only if it has as many matches as one island needs:

1. **Matches of every lag** up to a third of the text are counted exactly. Frequent (heavy) words
   by autocorrelation: the power spectra of their indicators are added up, and one inverse
   transform gives all their lags. Rare (light) words by the differences of their places. Where
   heavy ends follows from the counts, as the cut of least work.
2. **Lags with enough matches get an island scan.** An island covers two neighbouring multiples
   of half its least length, so only those places, and then a few between them, are looked at; what
   is left is followed to both ends.
3. By Fine and Wilf a smaller period of a stretch of 3q words divides q, and the stretch is the very
   run of that period. Lags come in ascending order, so a stretch that is known already is left out, and
   islands inside a known run whose period divides the lag are stepped over.

``found`` gives each document's runs and its text without the repetitions: of each run the words
behind the first q go, what is left is joined by single spaces. Words are ``[^\\x20\\x09-\\x0D]+``, compared as they
are written.

Work: n log n for each heavy word, one step for each pair of a light word, n log n probes. A document is one
row and is handled in one task; memory is some 100 bytes a word.

Defined results: null and empty text have no words, no runs and the text ""; a repeated row gives
its result again; a null doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

LEAST, TIMES = 24, 3
#: Measured nanoseconds of one point of a transform and of one pair of places; they decide the work, never the result.
POINT, PAIR = 14.0, 5.0
#: Places looked at between two probes before an island is followed.
BETWEEN = 40
FLUSH = 4 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def transform_size(least: int) -> int:
    """The least 2^k, 3 * 2^k or 5 * 2^k that is at least so large."""
    return min(m << max(0, -(-least // m) - 1).bit_length() for m in (1, 3, 5))


def heavy_words(counts: np.ndarray, size: int) -> int:
    """How many of the most frequent words (counts descending) are heavy."""
    pairs = np.append(0, np.cumsum(counts.astype(float) ** 2)) / 2
    k = np.arange(len(counts) + 1)
    return int(np.argmin(POINT * size * (k + (k > 0)) + PAIR * (pairs[-1] - pairs)))


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag 0..most the number of places whose word equals the one so far on; the entry of lag 0 means nothing."""
    n = len(ids)
    found = np.zeros(most + 1, np.int64)
    counts = np.bincount(ids)
    by_count = np.argsort(-counts, kind="stable")
    by_count = by_count[: int(np.count_nonzero(counts > 1))]
    size = transform_size(n + most + 1)
    heavy = heavy_words(counts[by_count], size)
    if heavy:
        power = np.zeros(size // 2 + 1)
        for word in by_count[:heavy].tolist():
            spectrum = np.fft.rfft((ids == word).astype(float), size)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = by_count[heavy:]
    if not len(light):
        return found
    rank = np.full(len(counts), -1)
    rank[light] = np.arange(len(light))
    place = np.flatnonzero(rank[ids] >= 0)
    place = place[np.argsort(rank[ids[place]], kind="stable")]  # words of more places first, places ascending
    word, sizes = rank[ids[place]], counts[light]
    for d in range(1, int(sizes[0])):
        end = int(sizes[: int(np.searchsorted(-sizes, -d, "left"))].sum())  # places of words that have more than d
        lag = (place[d:end] - place[: end - d])[word[d:end] == word[: end - d]]
        lag = lag[lag <= most]
        if not len(lag):
            break
        found += np.bincount(lag, minlength=most + 1)
    return found


def _matching(ids: np.ndarray, q: int, at: int, end: int) -> int:
    """The first place from at on, below end, whose word differs from the one q places on."""
    step = 64
    while at < end:
        upto = min(end, at + step)
        wrong = np.flatnonzero(ids[at:upto] != ids[at + q : upto + q])
        if len(wrong):
            return at + int(wrong[0])
        at, step = upto, step * 2
    return end


def _matching_back(ids: np.ndarray, q: int, at: int) -> int:
    """The first place of the matches that end before at."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        wrong = np.flatnonzero(ids[low:at] != ids[low + q : at + q])
        if len(wrong):
            return low + int(wrong[-1]) + 1
        at, step = low, step * 2
    return 0


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    most = n // TIMES
    lags = np.arange(most + 1)
    enough = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    enough[0] = n + 1
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    known: set[tuple[int, int]] = set()
    out = []
    for q in np.flatnonzero(lag_matches(ids, most) >= enough).tolist():
        need, end = int(enough[q]), n - q
        stride = need // 2
        probes = np.arange(0, end, stride)
        hit = ids[probes] == ids[probes + q]
        left = probes[:-1][hit[:-1] & hit[1:]]
        for p in [p for p in by_period if q % p == 0] if len(left) else []:
            starts, ends = by_period[p]
            k = np.searchsorted(starts, left, "right") - 1
            left = left[(k < 0) | (left + q >= ends[k])]
        for part in range(1, BETWEEN):
            if len(left) < 2:
                break
            between = left + stride * part // BETWEEN
            left = left[ids[between] == ids[between + q]]
        done, new = 0, []
        for at in left.tolist():
            if at < done:
                continue
            upto = _matching(ids, q, at, end)
            first = _matching_back(ids, q, at) if upto > at else at
            done = max(upto, at + 1)
            if upto - first >= need and (first, upto - first + q) not in known:
                new.append((first, upto - first + q))
        if new:
            known.update(new)
            out += [(start, length, q) for start, length in new]
            by_period[q] = (np.array([start for start, _ in new]), np.array([start + length for start, length in new]))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, of: list[tuple[int, int, int]]) -> np.ndarray:
    """The numbers of the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in of:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document after repetitions have been planted in a tenth of all documents; None in the others."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def found(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (by start, then period), text: the document without its repetitions.

    arrange(doc_id, n) may say which word stands at each of the n places, as ``planted`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()

        def out(rows: list) -> pa.RecordBatch:
            ids, lists, texts = zip(*rows, strict=True)
            each = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in lists]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(each, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "text"])

        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                doc, words = doc.as_py(), (text.as_py() or b"").split()
                ids = numbered(words)
                if arrange is not None and (at := arrange(doc, len(words))) is not None:
                    ids, words = ids[at], [words[i] for i in at.tolist()]
                of = runs(ids)
                rows.append((doc, of, b" ".join([words[i] for i in kept_words(len(words), of).tolist()] if of else words)))
                size += len(rows[-1][2]) + 40 * len(of) + 40
                if size > FLUSH:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


def digests(of: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length over period, and digests of all runs and of the text, from what ``found`` gives."""
    # Two different fractions of numbers below 2^26 differ as doubles, and equal ones are equal.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    of = of.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.floor(F.expr("(1000 * best.length) div best.period")).cast("long")
    return of.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
