"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share the size of the whole corpus; no
target exceeds CAP times its source's size, and what is cut is shared anew by weight until none is above.

A source takes floor(target / size) certain copies of each document. What is then missing, R words, is drawn without
replacement: document i has inclusion probability pi_i in proportion to 1 / sqrt(size_i), so that the expected words are R
and long documents do not dominate the error, and documents are ranked by the Pareto variable
u / (1 - u) * (1 - pi_i) / pi_i, where u comes from a hash of the id. The sample is fixed in words: ranked documents are
taken while at least half of the document still fits. Documents of more than 2 R words never fit and are not ranked.

The running sum over a source is found in steps that do not gather a source in one task: sums of LEVEL ranges of the rank
variable show the range in which R is reached, sums of LEVEL parts of that range narrow it again, and only documents of
that part (about a millionth of the source) are sorted. Tables of one row a source (targets, masses, cut points) are broadcast
up to BROADCAST_SOURCES rows, so that documents are not shuffled by source; beyond that no source is large and they are joined by
shuffle. The targets sort all sources, one row each, in one task.

Defined cases: null text has size 0; null source is a source of its own; equal rank variables are ordered by id, then
size, rows equal in both taken as one order among themselves gives, which changes no row of the result; a null id ranks by
the hash of no id, first among its equals; a repeated row is a document of its own; very long texts only count; an empty table
gives no rows; other columns are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, tokens

CAP = 3
WEIGHTS = (5, 2, 1)
LEVEL = 1024
#: Rows of a table of sources that may be broadcast: about 100 bytes each.
BROADCAST_SOURCES = 200_000


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, sid, source_size, target. sizes has source and size.

    Sources are sorted by CAP * size / weight; those that the fill level reaches are capped, which closed form equals
    repeated sharing."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("long"))
    everything, by_ratio = W.partitionBy(), W.orderBy(F.col("source_size") * CAP / F.col("w"), "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*", (F.col("source_size") * CAP / F.col("w")).alias("ratio"), F.row_number().over(by_ratio).alias("rn"),
        (F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    s = s.withColumn("level", F.col("left").cast("double") / F.col("left_w").cast("double"))
    s = s.withColumn("capped", F.col("level") >= F.col("ratio"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("rn"))).over(everything)
    target = F.when(F.col("capped"), F.col("source_size").cast("double") * CAP).otherwise(level * F.col("w"))
    return s.select("source", "sid", "source_size", target.alias("target"))


def uniform(key, seed: int):
    """In (0, 1), from 52 bits of an md5; SQL engines agree on it."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(4503599627370496.0)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) and copies of each document; docs has doc_id, source and text."""
    sized = cut(docs.select("doc_id", "source", F.size(tokens(F.col("text"))).cast("long").alias("size")))
    per = cut(targets(sized))
    few = per.count() <= BROADCAST_SOURCES

    def by_source(rows: DataFrame) -> DataFrame:
        """A table of one row a source, computed once."""
        rows = cut(rows)
        return F.broadcast(rows) if few else rows

    rows = sized.withColumnRenamed("source", "_source")
    per = F.broadcast(per) if few else per
    d = rows.join(per, rows["_source"].eqNullSafe(per["source"])).select("doc_id", "size", "sid", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("whole", whole)
    d = d.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    d = d.withColumn("fits", (F.col("size") > 0) & (F.col("size") <= 2 * F.col("rest")))
    root = F.sqrt(F.col("size").cast("double"))
    mass = by_source(d.filter("fits").groupBy("sid").agg(F.sum(F.floor(root * 1000)).alias("mass")))
    d = d.join(mass, "sid", "left")
    pi = F.least(F.greatest(F.col("rest") * 1000 / (root * F.col("mass").cast("double")), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(F.col("doc_id"), seed)
    d = d.withColumn("q", F.when(F.col("fits"), u / (1 - u) * ((1 - pi) / pi)))
    key = F.floor(F.col("q") / (1 + F.col("q")) * (LEVEL * LEVEL)).cast("long")
    d = d.withColumns({"k1": F.floor(key / LEVEL), "k2": key % LEVEL})

    def cut_point(rows: DataFrame, k: str, base: str) -> DataFrame:
        """Per source the part in which rest is reached and the sum before it; none where it isn't reached."""
        w = W.partitionBy("sid").orderBy(k)
        h = rows.groupBy("sid", k).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first(base).alias("b"))
        h = h.withColumn("end", F.sum("s").over(w) + F.col("b"))
        return by_source(h.filter("end > rest and end - s <= rest").groupBy("sid").agg(F.min(k).alias(f"{k}_cut"), F.min(F.col("end") - F.col("s")).alias(f"{k}_base")))

    d = d.join(cut_point(d.filter("fits").withColumn("zero", F.lit(0).cast("long")), "k1", "zero"), "sid", "left")
    d = d.join(cut_point(d.filter("fits and k1 = k1_cut"), "k2", "k1_base"), "sid", "left")
    edge = F.col("fits") & (F.col("k1") == F.col("k1_cut")) & (F.col("k2") == F.col("k2_cut"))
    sure = F.col("fits") & (F.col("k1_cut").isNull() | (F.col("k1") < F.col("k1_cut")) | ((F.col("k1") == F.col("k1_cut")) & (F.col("k2_cut").isNull() | (F.col("k2") < F.col("k2_cut")))))
    d = d.withColumns({"edge": F.coalesce(edge, F.lit(False)), "drawn": F.coalesce(sure, F.lit(False))})
    upto = W.partitionBy("sid").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    near = d.filter("edge").withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("k2_base"))
    near = near.withColumn("drawn", F.col("before") + F.col("size") / 2 <= F.col("rest")).drop("before")
    out = d.filter("not edge").unionByName(near)
    copies = F.col("whole") + F.col("drawn").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / w AS ratio,
    row_number() OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, sid) AS rn,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM s2 WINDOW b AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (SELECT *, level >= ratio AS capped FROM s3),
s5 AS (SELECT *, (SELECT arg_min(level, rn) FROM s4 WHERE NOT capped) AS fill FROM s4),
s AS (SELECT source, sid, source_size, CASE WHEN capped THEN CAST(source_size AS DOUBLE) * 3 ELSE fill * w END AS target FROM s5),
e AS (
  SELECT doc_id, size, sid, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), f AS (SELECT *, target - whole * source_size AS rest FROM e),
g AS (SELECT *, size > 0 AND size <= 2 * rest AS fits FROM f),
h AS (
  SELECT *, sum(CASE WHEN fits THEN CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1000) AS BIGINT) END) OVER (PARTITION BY sid) AS mass,
    (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':0'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM g
), p AS (
  SELECT *, least(greatest(rest * 1000 / (sqrt(CAST(size AS DOUBLE)) * CAST(mass AS DOUBLE)), 1e-9), 1 - 1e-9) AS pi FROM h WHERE fits
), r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY u / (1 - u) * ((1 - pi) / pi), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p
), c AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN before + CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END AS copies FROM r
  UNION ALL SELECT doc_id, size, source_size, target, whole FROM h WHERE NOT fits
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
