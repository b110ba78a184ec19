"""Language identification with language-bitmask n-gram filters.

One table of SLOTS words holds a Bloom filter for every language at once: bit l of a slot belongs to language l. An n-gram
is looked up in PROBES slots, and the AND of these is the set of all languages that contain it. A text's popcount for each
language is corrected for that language's false positive rate, and the largest corrected share decides.

The filters are learned from at most about SAMPLE documents a language (by a hash of the id) of the training fold. A
language's filter has the n-grams that make up at least MIN_SHARE of its n-grams and are at least RIVAL times as usual as
in any other language, so their number is bounded; the table is PROBES reads in SLOTS * 8 bytes for every 64 languages. The
number of languages is that of the labels' values, which the driver lists.

Defined cases: null texts and texts without a letter are `und`, score 0; with no training rows every text is `und`; equal
shares go to the language with more training documents, then by name; repeated rows are documents of their own; a null id is
kept, is not held out and is not learned from; very long texts are read whole, STEP characters at a time where texts end; other
columns are kept, but those named like a result (lang_pred, score; case does not count) are replaced by it; empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, read
from .packed import U, mix

GRAM, SLOTS, PROBES = 4, 1 << 18, 3
SAMPLE, MIN_SHARE, RIVAL = 2000, 2e-5, 0.2
STEP = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= STEP:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside words, with one blank on either side, and the text of each."""
    low = [f" {t.lower()} " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    alpha = letters()[cp]
    cp = np.where(alpha, cp, 32).astype(np.uint64)
    m = max(len(cp) - GRAM + 1, 0)
    h, inner = np.zeros(m, np.uint64), np.ones(m, bool)
    for j in range(GRAM):
        h = h * U(0x100000001B3) + cp[j : j + m]
        if 0 < j < GRAM - 1:
            inner &= alpha[j : j + m]
    inner &= doc[:m] == doc[GRAM - 1 :] if m else inner
    return mix(h[inner]), doc[:m][inner]


def probes(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> U(20 * i)) & U(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def fold(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string")) % n


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the table, of shape (languages / 64, SLOTS)."""
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("k is not null and t is not null and l is not null")
    counts = sorted(((r["count"], r["l"]) for r in d.groupBy("l").count().collect()), key=lambda x: (-x[0], x[1]))
    names = [n for _, n in counts]
    if not names:
        return [], np.zeros((1, SLOTS), np.uint64)
    share = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    bound = F.element_at(F.create_map(*[x for c, n in counts for x in (F.lit(n), F.lit(min(1.0, SAMPLE / c)))]), F.col("l"))
    code = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, codes = b["t"].to_pylist(), np.array(b["l"])
            for a, z in chunks(texts):
                h, doc = grams(texts[a:z])
                both, n = np.unique(np.stack([codes[a:z][doc].astype(np.uint64), h]), axis=1, return_counts=True)
                yield pa.record_batch({"l": both[0].astype(np.int32), "h": both[1].view(np.int64), "n": n.astype(np.int64)})

    rows = cut(d.filter(share < bound).select("t", code.alias("l")).mapInArrow(count, "l int, h bigint, n bigint").groupBy("l", "h").agg(F.sum("n").alias("n")))
    total = rows.groupBy("l").agg(F.sum("n").alias("total"))
    rows = rows.join(F.broadcast(total), "l").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= MIN_SHARE)
    best = rows.groupBy("h").agg(F.max("share").alias("top"))
    rows = rows.join(best, "h").filter(F.col("share") >= RIVAL * F.col("top")).select("l", "h")
    got = rows.toArrow()  # 1 / MIN_SHARE rows a language at most
    table = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
    code_of, h = got["l"].to_numpy().astype(np.int64), got["h"].to_numpy().view(np.uint64)
    for i in range(len(names)):
        for p in probes(h[code_of == i]):
            table[i // 64][np.unique(p)] |= U(1) << U(i % 64)
    return names, table


def predict(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred and score."""
    fill = np.array([((table[i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(names))])
    false_rate = fill**PROBES
    docs = plain(docs, "lang_pred", "score")
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b[text].to_pylist()]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for a, z in chunks(texts):
                h, doc = grams(texts[a:z])
                n = np.bincount(doc, minlength=z - a)
                at = probes(h)
                shares = np.zeros((len(names), z - a))
                for w in range(len(table)):
                    masks = table[w][at[0]]
                    for p in at[1:]:
                        masks &= table[w][p]
                    for i in range(64 * w, min(64 * w + 64, len(names))):
                        hit = np.bincount(doc, (masks >> U(i % 64)) & U(1), minlength=z - a)
                        shares[i] = (hit - n * false_rate[i]) / (np.maximum(n, 1) * (1 - false_rate[i] + 1e-12))
                if len(names):
                    best[a:z] = np.where(n > 0, shares.argmax(0), -1)
                    score[a:z] = np.where(n > 0, np.clip(shares.max(0), 0, 1), 0)
            has = np.array([any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t)) for t in texts], bool)
            pred = [names[i] if i >= 0 and x else ("und" if not names or not x else names[0]) for i, x in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double"]))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    names, table = learn(docs.filter(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), names, table)
