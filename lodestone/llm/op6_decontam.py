"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

DataFrame functions only. Each benchmark item gives its windows of N consecutive words (an item of fewer words, but not
none, one window of all). The hashes of these windows, and of the LEAD words each begins with, set bits of a bitmap that goes
with the plan (16 bits a window at least, MOST_BITS at most; a fuller bitmap passes more windows on and changes no result). Each
document is read once: its places are tested against the bitmap where it lies, first by the words that begin there, then by the
whole window, and only windows that pass leave the row, as place, length and words. These
are then verified by their words against the windows themselves, which are broadcast where their texts and items take
BROADCAST_BYTES at most, else joined by shuffle. Texts are not shuffled.

Defined cases: null or empty texts have no words and no hits; each row of documents gives one row, repeated ones too; a null id
is kept, and rows of one id are told apart by their texts; a window in several items counts for each; repeated item rows count
once; items with null ids are one item, whose id is in no list; a very long text is one row; other columns are not read by hits() and kept by cleaned(); empty
tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, let, lower_az, read, words

N = 13
#: Bytes of window texts and item ids that may be broadcast.
BROADCAST_BYTES = 64 << 20
LEAD, PROBES, LEAST_BITS, MOST_BITS = 3, 2, 1 << 16, 1 << 26
#: Runs of word characters, either case, and runs of all others.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CANDIDATE = "array<struct<pos:int,len:int,win:string>>"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """win (the words joined by a space), len, h (hash of the words' hashes), lead (of the first ones) and the item ids as strings."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(N)))
    b = b.select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.slice(F.col("w"), i + 1, F.col("len")))).alias("v"))
    return b.groupBy(F.array_join("v", " ").alias("win"), "len", F.xxhash64(hashes(F.col("v"))).alias("h"), lead_hash(F.col("v")).alias("lead")).agg(F.collect_set(F.struct("item")).alias("items"))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def lead_hash(v: Column) -> Column:
    out = F.xxhash64(*[F.xxhash64(F.get(v, F.lit(k))) for k in range(LEAD)])
    for n in range(LEAD - 1, 0, -1):
        out = F.when(F.size(v) == n, F.xxhash64(*[F.xxhash64(F.get(v, F.lit(k))) for k in range(n)])).otherwise(out)
    return out


def slots(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 32 * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def bitmap(win: DataFrame, n: int) -> tuple[Column, int]:
    """The set bits of all windows as an array of longs, and their number; the plan holds it as a constant."""
    bits = LEAST_BITS
    while bits < min(16 * (PROBES + 1) * n, MOST_BITS):
        bits *= 2
    at = win.select(F.explode(F.array(*slots(F.col("h"), bits), slots(F.col("lead"), bits)[0])).alias("s"))
    one = F.expr("shiftleft(1L, cast(s & 63 as int))")
    rows = at.groupBy(F.shiftrightunsigned("s", 6).cast("int").alias("k")).agg(F.bit_or(one).alias("v")).collect()  # MOST_BITS / 64 at most
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r["k"]] = r["v"]
    return F.from_json(F.lit(json.dumps(longs)), "array<bigint>"), bits


def candidates(w: Column, lengths: list[int], bitmap_: Column, bits: int) -> Column:
    """The windows of the words whose hashes the bitmap has: array of (pos, len, win)."""

    def known(h: Column, probes: int) -> Column:
        tests = [F.bit_get(F.get(bitmap_, F.shiftrightunsigned(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1 for s in slots(h, bits)[:probes]]
        return functools.reduce(operator.and_, tests)

    def of_length(n: int, hashed: Column) -> Column:
        def begins(i: Column) -> Column:
            return let(F.xxhash64(*[F.get(hashed, i + k) for k in range(min(LEAD, n))]), lambda h: known(h, 1))

        def whole(i: Column) -> Column:
            return let(F.xxhash64(F.slice(hashed, i + 1, F.lit(n))), lambda h: known(h, PROBES))

        at = F.filter(F.filter(F.sequence(F.lit(0), F.size(w) - n), begins), whole)
        rows = F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("win")))
        return F.when(F.size(w) >= n, rows).otherwise(F.array().cast(CANDIDATE))

    return let(hashes(w), lambda hashed: F.flatten(F.array(*[of_length(n, hashed) for n in lengths])))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, spans (array of (pos, len), sorted), n_items and items (sorted strings)."""
    win = cut(item_windows(benchmark))
    about = win.agg(F.count("*").alias("n"), F.sum(F.octet_length("win") + F.aggregate("items", F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x["item"]), F.lit(0)) + 16)).alias("bytes"), F.collect_set("len").alias("lengths")).first()
    lengths = sorted(about["lengths"])  # N values at most
    text_hash = F.xxhash64("text").alias("text_hash")
    if not lengths:
        return docs.select("doc_id", text_hash, F.size(words(F.col("text"))).cast("long").alias("n_words"), F.array().cast("array<struct<pos:int,len:int>>").alias("spans"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    longs, bits = bitmap(win, about["n"])
    scanned = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), candidates(w, lengths, longs, bits).alias("c")))
    rows = cut(docs.select("doc_id", text_hash, scanned.alias("x")).select("doc_id", "text_hash", F.col("x.n").cast("long").alias("n_words"), F.col("x.c").alias("c")))
    known = win.select("win", "len", "items")
    if about["bytes"] + 64 * about["n"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    sure = rows.filter(F.size("c") > 0).select("doc_id", "text_hash", F.inline("c")).join(known, ["win", "len"])
    found = sure.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("all")
    )
    found = found.select("doc_id", "text_hash", "spans", F.size("all").cast("long").alias("n_items"), F.array_sort(F.array_compact(F.transform("all", lambda x: x["item"]))).alias("items"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_h"})
    same = rows["doc_id"].eqNullSafe(found["_id"]) & (rows["text_hash"] == found["_h"])
    out = rows.select("doc_id", "text_hash", "n_words").join(found, same, "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cleaned(docs: DataFrame, benchmark: DataFrame, documents: bool = True) -> DataFrame:
    """docs without the contaminated documents; or, if documents is False, all docs with the hit words cut from the texts."""
    key, text_hash, spans = (fresh(docs, x) for x in ("_id", "_h", "_spans"))
    found = report(hits(docs, benchmark)).filter("contaminated" if documents else "n_hit > 0")
    found = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans)).dropDuplicates([key, text_hash])
    same = docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[text_hash])
    if documents:
        return docs.join(found, same, "left_anti")
    # words and what stands between them, in turn; the number of words before a piece is that of the place
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PIECES), F.lit(0))
    first = F.when(lower_az(F.substring("text", 1, 1)).rlike(WORD), 0).otherwise(1)

    def hit(k: Column) -> Column:
        at = ((k - first) / 2).cast("int")
        return ((k - first) % 2 == 0) & F.exists(spans, lambda s: (at >= s["pos"]) & (at < s["pos"] + s["len"]))

    kept = F.array_join(F.filter(pieces, lambda x, k: ~hit(k)), "")
    return docs.join(found, same, "left").withColumn("text", F.when(F.col(spans).isNotNull(), kept).otherwise(F.col("text"))).select(*docs.columns)


def covered(spans: Column) -> Column:
    """Number of places inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["pos"] + s["len"])
        return F.struct((a["n"] + end - F.greatest(a["end"], s["pos"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def report(found: DataFrame) -> DataFrame:
    n_hit = covered(F.col("spans")).cast("long")
    return found.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "items",
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return report(found).drop("text_hash", "spans", "items")


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (SELECT item, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
bi AS (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM bn),
b AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM bi),
ln AS (SELECT DISTINCT n FROM b),
di AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, ln WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM di),
hit AS (SELECT d.doc_id, d.i, d.n, b.item FROM dwin d JOIN b USING (win, n)),
place AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN place USING (doc_id) LEFT JOIN it USING (doc_id)
"""
