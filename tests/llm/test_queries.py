"""The queries on the smallest tables, and the pipeline against its stages done by hand."""

import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrylens.llm import decontamination, quality
from quarrylens.llm.queries import ORACLES, QUERIES, tokenizer_path

from ..conftest import SMALL, same_rows
from .test_operators import best_fit, brute_components, brute_groups, edit_distance

ROWS = {"op3_html": "pages", "op4_sharding": "documents", "op5_exact_dedup": "documents", "op7_secrets": "documents", "op8_jaccard": "documents", "op9_quality": "documents", "op1_pii": "documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        same_rows(df, duck.sql(ORACLES[name]))
    elif name in ROWS:
        assert df.count() == spark.read.parquet(f"{SMALL}/{ROWS[name]}.parquet").count()
    else:
        assert df.count() > 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    sizes = [len(ids(docs))]
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and ids(kept) <= ids(docs)
        docs = kept
        sizes.append(len(ids(docs)))
    poor = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    assert len(ids(docs) & poor) <= 0.05 * len(poor) and sizes == sorted(sizes, reverse=True)
    packed = p.run(spark, SMALL)
    assert ids(packed) == ids(docs) and packed.columns[:4] == ["doc_id", "piece", "start", "length"]


def plain_posteriors(rows, labels):
    """Of each id the evidence, the posteriors of its host, its path and itself, and the verdict, worked out in plain Python from the fitted weights."""
    x = {r["doc_id"]: quality.measures(r["text"]) for r in rows}
    pairs = [(x[i], y) for i, y in labels if i in x and y is not None]
    xs, ys = np.array([a for a, _ in pairs], float), np.array([float(b) for _, b in pairs])
    order = np.lexsort((*xs.T, ys))
    model = quality.fit(xs[order], ys[order])
    e = {i: float(quality.evidence(model, np.array([m], float))[0]) for i, m in x.items()}
    p = {i: 1 / (1 + math.exp(-v - model["prior"])) for i, v in e.items()}
    hosts, places = {}, {}
    for r in rows:
        hosts.setdefault(r["source"], []).append(p[r["doc_id"]])
        places.setdefault((r["source"], r["lang"]), []).append(p[r["doc_id"]])
    mean = sum(p.values()) / len(p)

    def strength(groups, above):
        n = sum(map(len, groups.values()))
        between = sum(len(g) * (sum(g) / len(g) - above(k)) ** 2 for k, g in groups.items()) / n
        within = sum(sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups.values()) / n * len(groups) / n
        return min(1e6, max(1.0, mean * (1 - mean) / max(between - within, 1e-9) - 1))

    kh, kp = strength(hosts, lambda k: mean), strength(places, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]))
    out = {}
    for r in rows:
        h, g, own = hosts[r["source"]], places[r["source"], r["lang"]], p[r["doc_id"]]
        host = (sum(h) + kh * mean) / (len(h) + kh)
        path = min(1 - 1e-6, max(1e-6, (sum(g) - own + kp * host) / (len(g) - 1 + kp)))
        posterior = 1 / (1 + math.exp(-(e[r["doc_id"]] + math.log(path / (1 - path)))))
        out[r["doc_id"]] = (e[r["doc_id"]], host, path, posterior, posterior >= quality.THRESHOLD)
    return out


def plain_quality(rows, labels):
    return {i for i, v in plain_posteriors(rows, labels).items() if v[-1]}


@pytest.mark.parametrize("twice", [False, True])
def test_quality_against_plain_python(spark, tmp_path, twice):
    """Every posterior of every document; with labels that are listed twice, too."""
    where = SMALL
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if twice:
        where = str(tmp_path)
        labels = labels.unionByName(labels.where("quality = 0").withColumn("toxic", labels["quality"]))
        labels.write.parquet(f"{where}/labels.parquet")
        docs.write.parquet(f"{where}/documents.parquet")
    want = plain_posteriors([r.asDict() for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = QUERIES["op9_quality"](spark, where).collect()
    assert len(got) == len(want)
    for r in got:
        *numbers, keep = want[r["doc_id"]]
        assert np.allclose([r["evidence"], r["host_posterior"], r["path_posterior"], r["posterior"]], numbers, rtol=1e-6, atol=1e-9) and r["keep"] == keep


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage's ids, and the pieces, from definitions; with a copy, a near copy and a leak planted for good documents."""
    import corpus_pipeline as p

    tables = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = [r.asDict() for r in tables["documents"].where("n_chars < 2500 and doc_id is not null").collect()]
    good = {r["doc_id"] for r in tables["labels"].where("quality = 1").collect()}
    item = max((r["text"] for r in tables["benchmark"].collect()), key=lambda t: len(t.split()))
    seeds = [r for r in docs if r["doc_id"] in good and len(r["text"].split()) > 100][:4]
    for k, r in enumerate(seeds):
        words = r["text"].split(" ")
        for j, text in enumerate((r["text"].upper(), " ".join([*words[:50], "otherwise", *words[50:]]), " ".join([*words[:60], item, *words[60:]]))):
            docs.append(r | {"doc_id": 10_000 + 10 * k + j, "text": text, "n_chars": len(text)})
    spark.createDataFrame(docs, tables["documents"].schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        tables[t].write.parquet(f"{tmp_path}/{t}.parquet")

    want = [plain_quality(docs, [(r["doc_id"], r["quality"]) for r in tables["labels"].collect()])]
    rows = [r for r in docs if r["doc_id"] in want[-1]]
    want.append({max(ids) for ids in brute_groups(rows)[1].values()})
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in want[-1]])
    want.append({i for i, (_, least) in groups.items() if i == least})
    items = [w for r in tables["benchmark"].collect() if (w := decontamination.words(r["text"] or ""))]
    text = {r["doc_id"]: r["text"] for r in rows}
    want.append({i for i in want[-1] if not any(edit_distance(w, decontamination.words(text[i])) <= len(w) // 5 for w in items)})
    assert len(docs) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 0

    got, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        got.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert got == want
    tokenizer, size = Tokenizer.from_file(tokenizer_path()), 4096
    ids = {i: [*tokenizer.encode(text[i], add_special_tokens=False).ids, 1] for i in want[-1]}
    pieces = {(i, n // size, n, len(x[n : n + size]), zlib.crc32(np.array(x[n : n + size], "<u4").tobytes())) for i, x in ids.items() for n in range(0, len(x), size)}
    packed = p.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == pieces and len(packed) == len(pieces)
    used: dict = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sorted(size - n for n in used.values()) == best_fit([n[3] for n in pieces], size)
