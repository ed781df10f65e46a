"""Spelling variants: forward and backward minimal acyclic automata with perfect-hash word numbers.

Words are counted over all texts. Two words are near if they differ by one inserted, deleted or
replaced code point. One error leaves one half of a word as it is, so for each word w of m code points

* a **forward** automaton of the dictionary is walked along the first half of w exactly, and the rest is completed with
  one error;
* a **backward** automaton, of the reversed words, is walked along the second half exactly, from its end, and the rest
  is completed with one error.

The automata are minimal and acyclic, built from sorted words. Every transition knows how many
words come before it, so the sums along a path are the number of its word among the sorted ones (a minimal perfect hash); what
is found are such numbers, and a set of them drops what was found twice. A word that both directions find
counts in the forward one alone, which either side can tell from the two words.

**Spark.** Words meet by (direction, m, exact half): each word is a query under its own length, and lies in the
dictionaries of the lengths around it. Rows are dealt out by that key, and a task builds automata of a bounded number
of words at a time. A key of more than ``LIMIT`` rows is cut again in the same way: the half that holds the error has two
halves, and one of them is exact. After log2(m) cuts the error lies in one code point; then all
that differs are two code points at most, so a key has fewer words than there are pairs of letters (90 of them). So no
key stays large, whatever the words. Neighbours are counted where they are found; only one row a word and key goes on.

Defined results: null and empty text have no words; a null doc_id counts as any other, but no letter is taken from its
words; a repeated row counts again; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, partitions, tidy

LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TIMES, PLANTED = 6, 5, 5, 199
#: Rows of one key above which it is cut again, and words of one automaton.
LIMIT, CHUNK = 2000, 20_000
BROADCAST_KEYS = 500_000


def occurrences(docs: DataFrame) -> DataFrame:
    """word: every run of letters of every text, lower-cased (A-Z), long enough; from one in ``PLANTED`` a letter is taken, by the checksum of document and run."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    runs = runs.select("run", F.when(F.col("doc_id").isNotNull() & (h % PLANTED == 0), h).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h").isNotNull(), shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; words have their places as numbers."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.next: list[dict] = []  # letter -> (state, words before it)
        register: dict = {}
        size: list[int] = []
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]  # of the last word: final, finished transitions

        def settle(state: tuple[bool, list[tuple[str, int]]]) -> int:
            final, arcs = state
            key = (final, tuple(arcs))
            if key not in register:
                before, moves = int(final), {}
                for letter, to in arcs:
                    moves[letter] = (to, before)
                    before += size[to]
                register[key] = len(size)
                size.append(before)
                self.final.append(final)
                self.next.append(moves)
            return register[key]

        last = ""
        for word in words:
            same = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            for i in range(len(last), same, -1):
                to = settle(path.pop())
                path[-1][1].append((last[i - 1], to))
            path += [(False, []) for _ in range(len(word) - same)]
            path[-1] = (True, path[-1][1])
            last = word
        for i in range(len(last), 0, -1):
            to = settle(path.pop())
            path[-1][1].append((last[i - 1], to))
        self.root = settle(path[0])

    def near(self, word: str, exact: int) -> set[int]:
        """The numbers of the words that begin with the first exact letters of word and differ from it by one error."""
        moves, final = self.next, self.final
        state, number = self.root, 0
        for letter in word[:exact]:
            if (step := moves[state].get(letter)) is None:
                return set()
            state, number = step[0], number + step[1]
        found: set[int] = set()
        seen: set[tuple[int, int, int]] = set()
        end = len(word)

        def rest(state: int, number: int, i: int) -> None:
            while i < end:
                if (key := (state, number, i)) in seen or (step := moves[state].get(word[i])) is None:
                    return
                seen.add(key)
                state, number, i = step[0], number + step[1], i + 1
            if final[state]:
                found.add(number)

        for i in range(exact, end + 1):
            here = moves[state]
            for letter, (to, before) in here.items():
                rest(to, number + before, i)  # one letter more
                if i < end and letter != word[i]:
                    rest(to, number + before, i + 1)  # another letter
            if i < end:
                rest(state, number, i + 1)  # one letter less
                if (step := here.get(word[i])) is None:
                    break
                state, number = step[0], number + step[1]
        return found


def exact_ends(m, path: str) -> tuple:
    """How many code points are exact at the start and at the end of a word of m (a number or a column): in each step one half of what is left, f the first, b the second."""
    half = (lambda x: F.floor(x / 2).cast("int")) if isinstance(m, Column) else (lambda x: x // 2)
    first, last, left = m * 0, m * 0, m
    for side in path:
        one = half(left)
        if side == "f":
            first, left = first + one, left - one
        else:
            last, left = last + (left - one), one
    return first, last


def owned(word: str, other: str, path: str) -> bool:
    """Whether this path, the first of those that do, is to count a near word."""
    first, last = exact_ends(len(word), path)
    if other[:first] != word[:first] or (last and other[-last:] != word[-last:]):
        return False
    # Where the path went to the second half, the first half must not be exact.
    sooner = (exact_ends(len(word), path[:k] + "f")[0] for k, side in enumerate(path) if side == "b")
    return all(other[:a] != word[:a] for a in sooner)


def _keyed(rows: DataFrame, path: str) -> DataFrame:
    """word, n, m -> path and key beside them: words of one key agree in what the path says is exact."""
    first, last = exact_ends(F.col("m"), path)
    ends = F.xxhash64(F.substr("word", F.lit(1), first), F.substr("word", F.length("word") - last + 1, last))
    return rows.select("word", "n", "m", F.lit(path).alias("path"), ends.alias("key"))


def dealt(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n -> word, n, m, path, key, so that words that are near share a key, and no key has many rows."""
    length = F.length("word")
    around = F.filter(F.array(length - 1, length, length + 1), lambda m: m >= LEAST_LENGTH)
    every = words.select("word", "n", F.explode(around).alias("m"))
    done, left = [], [(path, every) for path in "fb"]
    longest = words.agg(F.max(length)).first()[0] or 0
    while left:
        rows = [_keyed(x, path) for path, x in left]
        together = rows[0]
        for x in rows[1:]:
            together = together.unionByName(x)
        large = checkpoint(together.groupBy("path", "m", "key").agg(F.count("*").alias("c")).where(F.col("c") > limit).drop("c"))
        paths = {r["path"] for r in large.select("path").distinct().collect()}  # at most two for each of the log2(longest word) cuts
        few = large.count() <= BROADCAST_KEYS
        next_left = []
        for (path, x), keyed in zip(left, rows, strict=True):
            if path not in paths or 1 << len(path) >= longest:
                done.append(keyed)
                continue
            of = F.broadcast(large.where(F.col("path") == path)) if few else large.where(F.col("path") == path)
            done.append(keyed.join(of, ["path", "m", "key"], "left_anti").select(*keyed.columns))
            again = keyed.join(of, ["path", "m", "key"], "left_semi").select("word", "n", "m")
            next_left += [(path + side, again) for side in "fb"]
        left = next_left
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return found


def matches(rows: DataFrame) -> DataFrame:
    """word, near (how many near words this key has), best (the most frequent of them, first in code-point order, as -n and word)."""

    def looked_up(path: str, m: int, words: list[str], counts: list[int]) -> Iterator[tuple]:
        if len(words) < 2:
            return
        back = path[-1] == "b"
        turned = [w[::-1] for w in words] if back else words
        order = sorted(range(len(words)), key=turned.__getitem__)
        automaton = Automaton([turned[i] for i in order])
        first, last = exact_ends(m, path)
        for word, own in zip(words, turned, strict=True):
            if len(word) != m:
                continue
            found = [order[k] for k in automaton.near(own, last if back else first)]
            found = [i for i in found if owned(word, words[i], path)]
            if found:
                n, best = min((-counts[i], words[i]) for i in found)
                yield word, len(found), n, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()

        def groups() -> Iterator[tuple[str, int, list[str], list[int]]]:
            """Whole keys of one path and m, so many that they have about CHUNK words."""
            now, last, words, counts = None, None, [], []
            for batch in batches:
                for path, m, key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != (path, m) or (key != last and len(words) >= CHUNK):
                        if words:
                            yield *now, words, counts
                        now, words, counts = (path, m), [], []
                    last = key
                    words.append(word)
                    counts.append(n)
            if words:
                yield *now, words, counts

        for group in groups():
            if found := list(looked_up(*group)):
                word, near, n, best = zip(*found, strict=True)
                best = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(best, pa.string())], ["n", "word"])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), best], ["word", "near", "best"])

    rows = rows.select("path", "m", "key", "word", "n").repartition(partitions(rows.sparkSession), "path", "m", "key")
    return rows.sortWithinPartitions("path", "m", "key").mapInArrow(run, "word string, near long, best struct<n:bigint,word:string>")


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of the chain of forms, by doubling."""
    reach = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("on"))
        step = checkpoint(reach.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reach = step.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word (distinct), n -> word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n (ties: the first in code-point order) if that is ``TIMES`` its own n or more.
    """
    words = checkpoint(words.select("word", "n"))
    none = F.lit(None).cast("struct<n:bigint,word:string>")
    rows = matches(dealt(words)).select("word", F.lit(0).cast("long").alias("n"), "near", "best").unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")))
    each = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.n") >= TIMES * F.col("n")
    each = checkpoint(each.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")))
    return each.join(roots(each.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    """The words of docs that occur ``LEAST_COUNT`` times or more, with their variants."""
    return variants(occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT))
