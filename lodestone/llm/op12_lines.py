"""Line dedup as keep bitmaps, with DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Each document emits two 64-bit hashes, the place and
whether the key is new to the document; these rows are range-partitioned by the hashes and sorted by document and place within
them, so that a window streams each key's occurrences in order: the first one, and the number of documents. Lines that go set
bits, which meet by document: what comes back is a map from word number to the 64 bits of its lines, only of words that lose any.
Texts are not shuffled to find them; apply() joins the bitmaps with the texts.

A key with more than a HEAVY-th of all lines would fill its range. Such keys, less than HEAVY of them, are found by a
frequency sketch over all lines, counted exactly by partial aggregation and matched by broadcast, apart from the ranges. What
the sketch says decides where a key is counted, never how.

Keys of at least min_chars code points that stand in at least min_docs documents lose their lines: all of them (keep_first
False), or all but the first by (doc_id, hash of the text, place).

Defined cases: null and empty texts have one empty line; each row is a document, also where ids or whole rows repeat; rows equal
in id and text share one bitmap, so with keep_first both keep the line that is the first; a null id is kept; a very long text is
one row; other columns are kept by apply(), but those named like a result (n_lines, n_dropped; case does not count) are
replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, lower_az, plain, read

MIN_CHARS, MIN_DOCS = 1, 10
HEAVY = 2000
ENDS = " \t\n\x0b\x0c\r"
KEY = ["h", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line with a key: doc_id, th (hash of the text), h, h2, pos and new, which is 1 at the key's first place in the document."""
    keys = F.transform(lines_of(lower_az(F.col("text"))), lambda x: F.btrim(x, F.lit(ENDS)))
    hashed = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(MIN_DOCS), k).alias("h2"), i.alias("pos"), F.char_length(k).alias("n")))
    long = F.array_sort(F.filter(hashed, lambda x: x["n"] >= min_chars))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), long.alias("s"))

    def new(x: Column, i: Column) -> Column:
        before = F.get(F.col("s"), i - 1)
        return F.when((i > 0) & (before["h"] == x["h"]) & (before["h2"] == x["h2"]), 0).otherwise(1)

    return rows.select("doc_id", "th", F.inline(F.transform("s", lambda x, i: F.struct(x["h"].alias("h"), x["h2"].alias("h2"), x["pos"].alias("pos"), new(x, i).alias("new")))))


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, th, n_dropped and dropped, a map from word number to bits, of the documents that lose lines."""
    rows = cut(occurrences(docs, min_chars))
    about = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {HEAVY}, {8 * HEAVY})").alias("top")).first()
    often = [x["item"] for x in about["top"] or [] if x["count"] * HEAVY > about["n"]]  # less than HEAVY
    heavy = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in often], "h long"))
    place = F.struct("doc_id", "th", "pos")

    # a key's occurrences stream by; rows equal in id, text and place rank alike
    order = Window.partitionBy(*KEY).orderBy("doc_id", "th", "pos")
    ranged = rows.join(heavy, "h", "left_anti").repartitionByRange(*KEY).sortWithinPartitions(*KEY, "doc_id", "th", "pos")
    streamed = ranged.select("doc_id", "th", "pos", F.sum("new").over(Window.partitionBy(*KEY)).alias("n_docs"), (F.rank().over(order) == 1).alias("first"))

    mine = rows.join(heavy, "h", "left_semi")
    counted = mine.groupBy(*KEY).agg(F.sum("new").alias("n_docs"), F.min(place).alias("least"))
    settled = mine.join(F.broadcast(counted), KEY).select("doc_id", "th", "pos", "n_docs", place.eqNullSafe(F.col("least")).alias("first"))

    gone = streamed.unionByName(settled).filter(F.col("n_docs") >= min_docs)
    if keep_first:
        gone = gone.filter(~F.col("first"))
    bit = F.expr("shiftleft(1L, cast(pos & 63 as int))")
    word = gone.groupBy("doc_id", "th", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return word.groupBy("doc_id", "th").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply(docs: DataFrame, found: DataFrame, digest: bool = False) -> DataFrame:
    """docs without the lines that the bitmaps drop, with n_lines (before) and n_dropped; with digest, doc_id, these and kept_sha256 only."""
    docs = docs.select("doc_id", "text") if digest else plain(docs, "n_lines", "n_dropped")
    key, hashed, bits, n = (fresh(docs, x) for x in ("_id", "_h", "_bits", "_n"))
    found = found.select(F.col("doc_id").alias(key), F.col("th").alias(hashed), F.col("dropped").alias(bits), F.col("n_dropped").alias(n))
    both = docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[hashed]), "left")
    stays = F.filter(lines_of(F.col("text")), lambda x, i: F.coalesce(F.bit_get(F.try_element_at(bits, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)) == 0)
    text = F.when(F.col(bits).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    n_lines, n_dropped = F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_dropped")
    if digest:
        return both.select("doc_id", n_lines, n_dropped, F.sha2(F.coalesce(text, F.lit("")), 256).alias("kept_sha256"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines, n_dropped)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs, bitmaps(docs), digest=True)


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
"""
