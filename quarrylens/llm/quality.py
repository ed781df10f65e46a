"""Quality classifier: hierarchical empirical Bayes.

A logistic model over measures of the whole text (repetition, shouting, layout, word forms) is fitted on
at most ``LABELLED`` labelled documents, taken by hash of their id; the bound is a parameter. Its
log odds are a document's evidence. Documents are then grouped by host and by path
within host over the whole table: each group's mean is shrunk to the level above it, paths to
hosts and hosts to the global mean, with strengths that the method of moments estimates from the spread
between groups. A document's posterior is its own evidence on top of its path's posterior
without itself. Sparse sites so fall back on the global prior, large ones on their own record.

Group statistics are sums, combined before they are shuffled. They are broadcast when they number at
most ``BROADCAST_GROUPS`` (about 100 bytes each), and joined by a shuffle beyond.

Defined results: null and wordless texts are judged by the same measures (all zero); null hosts and
paths are groups of their own; a document listed twice counts twice, and so does one labelled twice; unlabelled or one-sided labels give
even evidence; an empty table gives an empty result; ``kept`` returns rows with all their columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored, tidy

LABELLED = 20_000
BROADCAST_GROUPS = 100_000
THRESHOLD = 0.5
MEASURES = 18


def measures(text: str | None) -> list[float]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    words = text.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * MEASURES
    counts = Counter(words)
    unique, most = len(counts), counts.most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    adjacent = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    upper, lower, digits = chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum()
    marks = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
    mean = len(text) / n
    return [
        math.log(n), unique / n, most / n, pairs, adjacent, repeated, upper / max(1, upper + lower), digits / size,
        marks / size, chars[33] / n, chars[124] / n, (chars[44] + chars[46]) / n, mean, max(map(len, counts)) / 100,
        len(lines) / n, (chars[35] + chars[36] + chars[37] + chars[42] + chars[94] + chars[126]) / n, (chars[60] + chars[62] + chars[123] + chars[125] + chars[59] + chars[61]) / n, unique / math.sqrt(n),
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Measures with their squares, so that both ends of one may be odd."""
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict:
    """Logistic regression by Newton steps on standardised measures."""
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(MEASURES), "scale": np.ones(MEASURES), "w": np.zeros(2 * MEASURES + 1), "prior": 0.0}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = expanded(np.clip((x - mean) / scale, -6, 6))
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    rate = y.mean()
    return {"mean": mean, "scale": scale, "w": w, "prior": float(np.log(rate / (1 - rate)))}


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of quality against the prior rate of the labels."""
    if not len(x):
        return np.empty(0)
    return np.clip(expanded(np.clip((x - model["mean"]) / model["scale"], -6, 6)) @ model["w"], -30, 30) - model["prior"]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, target: str = "quality") -> dict:
    """Measures of the bounded sample come to the driver, not its texts."""
    some = labels.where(F.col(target).isNotNull()).select(F.col("doc_id").alias("_l"), F.col(target).cast("double").alias("_y")).orderBy(F.xxhash64("_l"), "_l").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_l")).select("text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([measures(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y double").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, MEASURES)
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the sum does not depend on the order in which tasks end
    return fit(x[order], y[order])


def _score(model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        for texts in batches:
            yield pd.Series(evidence(model.value, np.array([measures(t) for t in texts], float).reshape(-1, MEASURES)))

    return score


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, within: float, between: float) -> float:
    """Beta strength of a prior whose groups spread by between around it."""
    return float(min(1e6, max(1.0, mean * (1 - mean) / max(between - within, 1e-9) - 1)))


JUDGED = ("_evidence", "_host", "_path", "_posterior", "_keep")


def judged(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", labelled: int = LABELLED, carry: tuple[str, ...] | None = None) -> DataFrame:
    """_row (the columns to carry, all by default, out of the way of other names), and JUDGED: evidence, posteriors of the groups and of the document, verdict.

    Each text is scored once: rows are written with their evidence, and group sums and verdicts read that table.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, labelled))
    of = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0"))
    base = docs.select(F.struct(*(carry or ("*",))).alias("_row"), of(host).alias("_h"), of(path).alias("_q"), _score(model)(F.col("text")).alias("_evidence"))
    base = stored(base)
    base = base.withColumn("_p", 1 / (1 + F.exp(-F.col("_evidence") - F.lit(model.value["prior"]))))
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    paths = checkpoint(sums(base.select("_h", "_q", F.lit(1).alias("n"), F.col("_p").alias("s"), (F.col("_p") * F.col("_p")).alias("ss")), "_h", "_q"))
    hosts = checkpoint(sums(paths, "_h"))
    total = hosts.agg(F.sum("n"), F.sum("s"), F.sum("ss")).first()
    n = total[0] or 1
    mean = min(1 - 1e-6, max(1e-6, (total[1] or 0.0) / n)) if total[0] else 0.5
    # Spread of the groups' means around the level above, less what chance alone gives.
    spread = lambda df, m: df.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)) / F.sum("n"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n") * F.count("*") / F.sum("n")).first()
    h = spread(hosts, F.lit(mean))
    above = hosts.select("_h", F.col("s").alias("hs"), F.col("n").alias("hn"))
    nested = paths.join(above, "_h")
    p = spread(nested, F.col("hs") / F.col("hn"))
    kh, kp = (_strength(mean, x[1] or 0.0, x[0] or 0.0) for x in (h, p))
    groups = nested.select("_h", "_q", "n", "s", ((F.col("hs") + kh * mean) / (F.col("hn") + kh)).alias("_host"))
    groups = F.broadcast(groups) if paths.count() <= BROADCAST_GROUPS else groups
    joined = base.join(groups, ["_h", "_q"])
    path_ = (F.col("s") - F.col("_p") + kp * F.col("_host")) / (F.col("n") - 1 + kp)
    joined = joined.withColumn("_path", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_)))
    joined = joined.withColumn("_posterior", 1 / (1 + F.exp(-(F.col("_evidence") + _logit(F.col("_path"))))))
    return joined.withColumn("_keep", F.col("_posterior") >= THRESHOLD).select("_row", *JUDGED)


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs (or the columns to carry) with JUDGED, which replace columns of these names."""
    return judged(docs, labels, **how).select(*[F.col("_row")[c].alias(c) for c in how.get("carry") or docs.columns if c not in JUDGED], *JUDGED)


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    return judged(docs, labels, **how).where("_keep").select("_row.*")
