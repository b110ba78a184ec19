"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic classifier on shape features of the text gives each document a probability p. Sums of p by host, and by path
within it, are grouped aggregates. The global mean is the prior of a host, and the host's posterior mean is the prior of its
paths; how strongly each level shrinks (pseudo-documents) follows from the variance between hosts, or paths, against that
within them (method of moments), so a sparse site falls back on its parent. A document's own p is left out of its path.
The score moves the document's log odds by the path's log odds against the global ones.

The classifier is fitted to at most about SAMPLE labelled documents a class, chosen by a hash of the id; sums, means and
variances are over all documents. A label that is given repeatedly counts once, and of documents that share an id the one of the
least features is learned from.

Defined cases: null texts count as empty; null host or path is a site of its own; null labels are not learned from; without
labels of both classes p is 0.5 everywhere; a path of one document has its host's posterior; equal evidence gives equal scores;
repeated rows are documents of their own; a null id is kept, is not held out and is not learned from; very long texts are read
whole; other columns are not read, so none can clash; an empty table gives no rows.

The sums of sites are broadcast up to BROADCAST_SITES; beyond that they are joined by shuffle, for which documents of a site are
dealt to SALTS parts, so that one site with a third of all rows is no single task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, label_sample, read

SAMPLE = 4000
#: Share of a path's log odds that moves a document's, and the score from which a document is kept.
PULL, KEEP = 0.5, 0.5
#: Bounds of the pseudo-documents of a level.
LEAST, MOST = 1.0, 1000.0
FEATURES = 9
#: Sites whose sums may be broadcast (about 100 bytes each), and parts of a site beyond that.
BROADCAST_SITES, SALTS = 200_000, 64
_SYMBOL = re.compile(r"[^\w\s.,;:'\"-]")


def shape(text: str) -> list[float]:
    """Length, word length, symbols, case, digits, repeats of words and lines, sentence ends, long words."""
    words = text.split()
    n, lines = len(words), text.split("\n")
    if not n:
        return [0.0] * FEATURES
    chars = sum(map(len, words))
    letters = sum(map(text.count, "etaoinsrhldcu"))
    upper = len(re.findall("[A-Z]", text))
    return [
        np.log1p(n) / 5, chars / n / 10, min(1.0, 5 * len(_SYMBOL.findall(text)) / chars), upper / chars, letters / chars,
        len(set(words)) / n, len(set(lines)) / len(lines), min(1.0, 10 * (text.count(". ") + text.count(".\n")) / n), float(n < 10),
    ]


def fold(key: Column) -> Column:
    """Held-out documents: one in five."""
    return F.crc32(key.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray | None:
    lab, counts = label_sample(labels.select(F.col(key).alias("k"), F.col(label).alias("y")), {1: SAMPLE, 0: SAMPLE})
    if len(counts) < 2:
        return None
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(lab), "k").select("k", "t", "y")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["k"], pa.array([shape(t or "") for t in b["t"].to_pylist()], pa.list_(pa.float64())), b["y"]], ["k", "x", "y"])

    each = some.mapInArrow(rows, f"k {dict(some.dtypes)['k']}, x array<double>, y int")
    got = each.groupBy("k", "y").agg(F.min("x").alias("x")).toArrow()  # bounded by SAMPLE: one row a label
    x, y = np.array(got["x"].to_pylist()).reshape(-1, FEATURES), got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    order = np.lexsort([*x.T, y])
    x, y = np.column_stack([x, x**2, np.ones(len(x))])[order], y[order]
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    weight = weight / weight.mean()
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def evidence(docs: DataFrame, coef: np.ndarray | None, text: str = "text") -> DataFrame:
    """docs without text, with p."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shape(t or "") for t in b[text].to_pylist()]).reshape(-1, FEATURES)
            z = np.column_stack([x, x**2, np.ones(len(x))]) @ coef if coef is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(1 / (1 + np.exp(-np.clip(z, -12, 12))))], [*keep, "p"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "p double"]))


def strength(within: Column, between: Column) -> Column:
    """Pseudo-documents of a level from the two variances."""
    return F.least(F.greatest(F.coalesce(within / F.when(between > 0, between), F.lit(MOST)), F.lit(LEAST)), F.lit(MOST))


def posteriors(p: DataFrame) -> DataFrame:
    """p: host, path, p. One row per path with the sums and posteriors of it and its host, and the global mean mu."""
    sums = [F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n")]
    paths = cut(p.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum("n").alias("hn"))
    total = hosts.agg(
        (F.sum("hs") / F.sum("hn")).alias("mu"),
        (F.sum(F.col("hq") - F.col("hs") * F.col("hs") / F.col("hn")) / F.greatest(F.sum("hn") - F.count("*"), F.lit(1))).alias("within"),
        F.var_samp(F.col("hs") / F.col("hn")).alias("spread"), F.avg(1 / F.col("hn")).alias("inv"),
    ).select("mu", strength(F.col("within"), F.col("spread") - F.col("within") * F.col("inv")).alias("k_host"))
    level = paths.join(hosts.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2"))).select("host", "path", "s", "q", "n", "hs", "hn")
    inner = level.agg(
        (F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))).alias("w2"),
        F.avg(F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("b2"), F.avg(1 / F.col("n")).alias("i2"),
    ).select(strength(F.col("w2"), F.col("b2") - F.col("w2") * F.col("i2")).alias("k_path"))
    mu, k_host, k_path = (F.lit(x if x is not None else 1.0) for x in (*total.first(), *inner.first()))  # one row each
    host_mean = (F.col("hs") + k_host * mu) / (F.col("hn") + k_host)
    return level.select("host", "path", "s", "n", host_mean.alias("host_posterior"), mu.alias("mu"), k_path.alias("k_path"))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(docs: DataFrame, coef: np.ndarray | None, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    p = cut(evidence(docs.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.col(text).alias("t")), coef, "t"))
    site = cut(posteriors(p).withColumnsRenamed({"host": "host2", "path": "path2"}))
    same = F.col("host").eqNullSafe(F.col("host2")) & F.col("path").eqNullSafe(F.col("path2"))
    if site.count() <= BROADCAST_SITES:
        d = p.join(F.broadcast(site), same)
    else:
        dealt = p.withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(SALTS)))
        d = dealt.join(site.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("salt") == F.col("salt2")))
    d = d.select(F.col("id").alias(key), "p", "s", "n", "host_posterior", "mu", "k_path")
    others = (F.col("s") - F.col("p") + F.col("k_path") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k_path"))
    d = d.withColumn("path_posterior", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6)))
    z = logit(F.col("p")) + PULL * (logit(F.col("path_posterior")) - logit(F.col("mu")))
    d = d.withColumn("score", 1 / (1 + F.exp(-z)))
    return d.select(key, F.col("p").alias("document_evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("kept"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: source. Path: lang within it, as URLs of the table pages begin with the language after the host."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(fold(F.col("doc_id")), F.lit(False))
    coef = fit(docs, labels.filter(~held))
    return score(docs, coef, F.col("source"), F.col("lang")).withColumn("held_out", held)
