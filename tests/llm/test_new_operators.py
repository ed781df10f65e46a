"""Periodic runs, MinHash and spelling variants against brute force, and on odd input."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import html_extract, minhash, periodic, pii, secrets, spelling
from quarrylens.llm.common import checkpoint

from .test_operators import docs_of, none, odd  # noqa: F401

# -- 11 periodic runs ------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            stretch = w[start : start + length]
            if length >= max(24, 3 * q) and all(any(stretch[k] != stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    w, letters = [], rng.choice([1, 2, 2, 3, 5, 30])
    while len(w) < n:
        if w and rng.random() < 0.3:
            p = rng.randrange(1, min(len(w), 30) + 1)
            for _ in range(rng.randrange(1, 100)):
                w.append(w[-p])
        else:
            w.append(rng.randrange(letters))
    return w[:n]


@pytest.mark.parametrize("point", [14.0, 1e-3, 1e9])  # as measured, all heavy, all light
def test_runs_against_brute_force(monkeypatch, point):
    monkeypatch.setattr(periodic, "POINT", point)
    rng = random.Random(point)
    for _ in range(150):
        w = repetitive(rng, rng.randrange(0, 160))
        ids = np.array(w, np.int64)
        assert periodic.runs(ids) == brute_runs(w)
        if most := len(w) // 3:
            assert periodic.lag_matches(ids, most).tolist()[1:] == [sum(x == y for x, y in zip(w, w[q:])) for q in range(1, most + 1)]


def test_runs_of_long_texts_take_seconds():
    rng = np.random.default_rng(1)
    zipf = np.unique(rng.zipf(1.3, 200_000) % 50_000, return_inverse=True)[1]
    for ids, want in ((np.zeros(200_000, np.int64), 1), (np.arange(200_000) % 7, 1), (np.arange(200_000) % 50_000, 1), (zipf, 0)):
        began = time.time()
        assert len(periodic.runs(ids.astype(np.int64))) == want
        assert time.time() - began < 30


def test_documents_lose_repetitions(spark, odd, none):  # noqa: F811
    rng = random.Random(4)
    texts = [" ".join(f"w{x}" for x in repetitive(rng, rng.randrange(0, 120))) for _ in range(40)] + ["a b " * 30, None, "", " \n\t "]
    got = {r["doc_id"]: r for r in periodic.found(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        runs = brute_runs(words)
        assert [tuple(r) for r in got[i]["runs"]] == runs
        kept = [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs)]
        assert got[i]["text"] == b" ".join(kept).decode()
    planted = {r["doc_id"]: r for r in periodic.digests(periodic.found(docs_of(spark, ["x y z " * 50] * 200), periodic.planted)).collect()}
    for i in range(200):
        h, words = zlib.crc32(str(i).encode()), ["x", "y", "z"] * 50
        if h % 10 == 0:
            a, g = (h // 10) % 150, h // 10
            words = words[:a] + [words[a + (k - a) % (1 + (150 - a) // (3 + g % 8))] for k in range(a, 150)]
        want = brute_runs(words)
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        assert (planted[i]["n_runs"], planted[i]["start"], planted[i]["length"], planted[i]["period"], planted[i]["exponent_milli"]) == (len(want), *best, 1000 * best[1] // best[2])
    rows = periodic.digests(periodic.found(odd, periodic.planted)).collect()
    assert len(rows) == odd.count() and {r["n_runs"] for r in rows} == {0, 1} and periodic.found(none).count() == 0


# -- 12 MinHash ------------------------------------------------------------------------


def two_word_set(text):
    w = [x for x in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_near(rows):
    """doc_id -> (size, least doc_id reachable)."""
    sets = {}
    for i, text in rows:
        sets[i] = two_word_set(text)
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    for n, shared in ((1, 1), (3, 2), (20, 15), (300, 240), (5000, 4500)):
        x = rng.integers(0, 2**64, 2 * n - shared, np.uint64)
        a, b = x[:n], x[n - shared :]
        both = minhash.sketches([a, b, np.union1d(a, b)])
        assert both.shape == (3, minhash.BANDS * minhash.ROWS) and (both != np.uint64(2**64 - 1)).all()
        assert (both[2] == np.minimum(both[0], both[1])).all()  # of a union it is the least of both
        assert abs((both[0] == both[1]).mean() - shared / (2 * n - shared)) < 0.15


def drifting(seed, n=60, length=60, change=2):
    rng = random.Random(seed)
    words = [f"s{seed}w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        for _ in range(change):
            words[rng.randrange(length)] = f"s{seed}x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Chains of copies that drift apart, groups around the threshold, exact copies; with buckets that go through blocks."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(100)]
    around = [" ".join(w if rng.random() > 0.055 else f"z{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    texts = [*drifting(1), *drifting(2, change=4), *around, *around[:5], around[0].upper(), "one", "ONE", "one two", "", None, *["same words here"] * 5]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.labelled(docs_of(spark, texts)).collect()}
    want = brute_near(list(enumerate(texts)))
    assert got == want and 5 < len({c for _, c in want.values()}) < len(texts) - 60


def test_blocks_find_what_centres_miss(spark, monkeypatch):
    """One bucket for all: every link must still be found, whatever the centres say."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    texts = [" ".join(w if rng.random() > 0.08 else f"z{rng.randrange(10**6)}" for w in base) for _ in range(80)]
    docs = docs_of(spark, texts).withColumnRenamed("doc_id", "doc")
    each = checkpoint(minhash.features(docs))
    shared = each.select(F.lit(1).cast("long").alias("g"), "doc", "n")
    label = {r["node"]: r["label"] for r in minhash.linked(docs, shared).collect()}
    want = {i: c for i, (_, c) in brute_near(list(enumerate(texts))).items()}
    assert {i: label.get(i, i) for i in want} == want and len(set(want.values())) < len(texts)


def test_near_copies_of_odd_rows(spark, odd, none):  # noqa: F811
    got = minhash.labelled(odd).collect()
    want = brute_near([(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()])
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, *want[i]) for i in [r["doc_id"] for r in odd.where("doc_id is not null").collect()])
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, None)]
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None} | {i for i, (_, c) in want.items() if i == c}
    assert minhash.labelled(none).count() == 0 and minhash.deduplicated(none).count() == 0


# -- 13 spelling variants --------------------------------------------------------------


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        near = [v for v in n if one_error(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, w, n[w], len(near)]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: (f, r, c, k, n[f] if f else None) for w, (f, r, c, k) in out.items()}


def random_words(seed, n, letters="ab", least=6, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(least, most + 1))) for _ in range(n)})


def test_automaton_is_minimal_and_numbers_words():
    for seed in range(30):
        words = random_words(seed, 60, "abc"[: 1 + seed % 3], 0, 7)
        automaton = spelling.Automaton(words)
        right: dict = {}

        def language(state):
            if state not in right:
                right[state] = frozenset(([""] if automaton.final[state] else []) + [c + x for c, (to, _) in automaton.next[state].items() for x in language(to)])
            return right[state]

        assert language(automaton.root) == set(words) and len(set(right.values())) == len(automaton.next)
        for w in words:
            for exact in (0, len(w) // 2, len(w)):
                assert automaton.near(w, exact) == {i for i, v in enumerate(words) if v[:exact] == w[:exact] and one_error(w, v)}


def test_each_near_word_is_counted_by_one_path():
    words = random_words(3, 150)
    for leaves in ("f b", "ff fb b", "f bf bb", "fff ffb fb bf bbf bbb"):
        for w in words[:40]:
            for v in words:
                if one_error(w, v):
                    assert sum(spelling.owned(w, v, path) for path in leaves.split()) == 1


@pytest.mark.parametrize("limit", [2000, 12])
def test_variants_against_brute_force(spark, monkeypatch, limit):
    """Few letters, so that keys are hot; cut down to one code point where the limit is low."""
    monkeypatch.setattr(spelling, "dealt", lambda words, f=spelling.dealt: f(words, limit))
    monkeypatch.setattr(spelling, "CHUNK", 50)
    words = [*random_words(1, 250), *random_words(2, 80, "aé×ÿ", 6, 7), "internationalisation", "internationalization", *(["a" * 500, "a" * 501, "a" * 250 + "b" + "a" * 249] if limit > 30 else [])]
    rng = random.Random(5)
    n = {w: rng.choice([5, 6, 30, 200, 2000]) for w in words}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute_variants(n) and any(v[0] and v[0] != v[1] for v in got.values())
    sizes = spelling.dealt(spark.createDataFrame(list(n.items()), "word string, n long")).groupBy("path", "m", "key").count()
    assert limit > 30 or sizes.where("length(path) > 1").count() > 10


def test_occurrences(spark, odd, none):  # noqa: F811
    texts = ["Straße ÉCOLE école Éducation éducation xÀÿz abcdefg1hijklmn don't under_scores" * 3, None, "", "Verylongword " * 400]
    want: Counter = Counter()
    for i, text in enumerate(texts):
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
            elif run:
                h = zlib.crc32(f"{i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
                want[word] += len(word) >= 6
                run = ""
    got = {r["word"]: r["count"] for r in spelling.occurrences(docs_of(spark, texts)).groupBy("word").count().collect()}
    assert got == {w: c for w, c in want.items() if c}
    many = docs_of(spark, ["lettering"] * 2000)
    want = Counter(w for i in range(2000) for h in [zlib.crc32(f"{i}:lettering".encode())] for w in ["lettering"[: h % 9] + "lettering"[h % 9 + 1 :] if h % 199 == 0 else "lettering"])
    got = {r["word"]: r["count"] for r in spelling.occurrences(many).groupBy("word").count().collect()}
    assert got == want and len(got) > 3
    assert spelling.grouped(none).count() == 0 and spelling.grouped(odd).count() == 0 and spelling.grouped(spark.createDataFrame([(None, "unnamed " * 9)], "doc_id long, text string")).count() == 1


# -- mended: HTML that leaves tags out, long texts of pseudonyms and secrets ------------


def test_omitted_and_unclosed_tags():
    model = html_extract.train()
    body = "<article><h1>A title of some words</h1><p>The first paragraph, with a few words. And more of them.</p><p>Another one, which is as long as the first one was.</p></article>"
    want = html_extract.extract(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>", model)
    assert want.startswith("A title of some words\nThe first") and want.count("\n") == 2
    for page in (
        f"<!DOCTYPE html><html><head><title>t</title>{body}</html>", f"<title>t</title><meta charset=utf-8>{body}", f"<html><head><title>t</title><script>var a = '<p>';</script><body>{body}",
        f"<head><title>t</title></head><body><noscript>{body}", f"<head><noscript><link rel=x></noscript><style>p {{}}</style>{body}", f"<head><title>t</title><body><svg>{body}", f"<head><title>t</title></head><noscript>no scripts here</noscript><body>{body}",
    ):
        assert html_extract.extract(page, model) == want, page


def test_long_texts_take_seconds(spark):
    began = time.time()
    hosts = pii.pseudonymised(docs_of(spark, ["a@b" + ".c" * 500_000, "12 " * 30_000, "+1" + ".2" * 5_000]), "k").orderBy("doc_id").collect()
    assert [r["n_email"] for r in hosts] == [1, 0, 0] and hosts[1]["text"] == "12 " * 30_000
    docs = docs_of(spark, ["eyJ" * 350_000, "eyJaaaaaaaaaa." * 75_000, "x eyJaaaaaaaa.bbbbbbbb.cccccccc y"])
    spans = [r["spans"] for r in secrets.digest_columns(secrets.findings(docs, secrets.update(docs))).orderBy("doc_id").collect()]
    assert spans[0] == "" and spans[1].startswith("jwt:0:41") and spans[2] == "jwt:2:31"
    assert time.time() - began < 120
