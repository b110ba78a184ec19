"""Graph questions on the driver tables: nations point at the nations that supply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources.tables import table


def trade(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    o, c, s = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), "l_orderkey", "l_linenumber", "l_partkey", cents.alias("cents"))


def partners(spark: SparkSession, d: str) -> DataFrame:
    """The two nations that supply each nation most."""
    sums = trade(spark, d).filter("src <> dst").groupBy("src", "dst").agg(F.sum("cents").alias("cents"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("cents"), "dst"))
    return sums.withColumn("rank", rank).filter("rank <= 2").select("src", "dst")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))


TRADE_SQL = """trade AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, l_orderkey, l_linenumber, l_partkey,
    CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""
E_SQL = TRADE_SQL + """, sums AS (SELECT src, dst, sum(cents) AS cents FROM trade WHERE src <> dst GROUP BY src, dst),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cents DESC, dst) AS rank FROM sums) WHERE rank <= 2)"""
DEG_SQL = E_SQL + """, deg AS (
  SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS dependents, (SELECT count(*) FROM e WHERE src = n_nationkey) AS dependencies FROM nation
), g AS (SELECT *, dependents + dependencies AS coupling FROM deg)"""


def edge_build(spark, d):
    return graph.last_wins(trade(spark, d).drop("cents"), ["l_orderkey", "l_linenumber", "l_partkey"])


def degree_hotspots(spark, d):
    return graph.hotspots(graph.degrees(nodes(spark, d), partners(spark, d)))


def coupling_summary(spark, d):
    return graph.coupling(graph.degrees(nodes(spark, d), partners(spark, d)))


def cycles_bounded(spark, d):
    c = graph.cycles(partners(spark, d), longest=5)
    return c.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


def followed(spark, d) -> DataFrame:
    """Edges from a part to one of its brand on the next line of an order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("src <> dst")
    brand = table(spark, d, "part").select("p_partkey", "p_brand")
    a, b = (brand.select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"b_{x}")) for x in ("src", "dst"))
    return lines.join(a, "src").join(b, "dst").filter("b_src = b_dst").select("src", "dst").distinct()


def strong_components(spark, d):
    """Parts that lead to one another by orders of their brand."""
    return graph.components(followed(spark, d))


def part_cycles(spark, d):
    """All cycles of up to ten parts."""
    c = graph.cycles(followed(spark, d))
    return c.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


def mutual_edges(spark, d):
    return graph.mutual(partners(spark, d))


#: Regions that a nation of a region may buy from, besides its own.
ALLOWED = [("AFRICA", "EUROPE"), ("AMERICA", "ASIA"), ("ASIA", "AMERICA"), ("EUROPE", "AMERICA"), ("EUROPE", "ASIA")]


def layer_violations(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    layers = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("layer"))
    allowed = spark.createDataFrame(ALLOWED, "source_layer string, target_layer string")
    return graph.forbidden(partners(spark, d), layers, allowed).select("source_layer", "target_layer", "src", "dst")


def domain_crossings(spark, d):
    """Orders of a segment for a brand family other than its own."""
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    family = F.regexp_extract("p_brand", r"^([A-Za-z]+#?\d)", 1)
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    rows = rows.groupBy(F.lower(F.substring("c_mktsegment", 1, 4)).alias("from_domain"), family.alias("to_domain")).agg(F.count("*").alias("crossings"))
    allowed = spark.createDataFrame([("auto", "Brand#1"), ("buil", "Brand#2"), ("furn", "Brand#3"), ("mach", "Brand#4")], "from_domain string, to_domain string")
    return rows.join(allowed, ["from_domain", "to_domain"], "left_anti")


def focus_reach(spark, d):
    start = nodes(spark, d).filter("id = 0")
    return graph.reach(partners(spark, d), start, 3)


QUERIES = {f.__name__: f for f in (edge_build, degree_hotspots, coupling_summary, cycles_bounded, strong_components, part_cycles, mutual_edges, layer_violations, domain_crossings, focus_reach)}
FOLLOWED_SQL = """l AS (SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS q FROM lineitem),
e AS (SELECT DISTINCT p AS src, q AS dst FROM l JOIN part a ON a.p_partkey = p JOIN part b ON b.p_partkey = q WHERE a.p_brand = b.p_brand AND p <> q)"""
ORACLES = {
    "strong_components": f"""WITH RECURSIVE {FOLLOWED_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT *, count(*) OVER (PARTITION BY component) AS size FROM c""",
    "part_cycles": f"""WITH RECURSIVE {FOLLOWED_SQL}, p AS (
  SELECT src AS first, dst AS at, [src, dst] AS path FROM e WHERE dst > src
  UNION ALL SELECT first, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.at WHERE e.dst > first AND NOT list_contains(path, e.dst) AND len(path) < 10
) SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p JOIN e ON e.src = p.at AND e.dst = p.first""",
    "edge_build": f"""WITH {TRADE_SQL} SELECT src, dst, l_orderkey, l_linenumber, l_partkey FROM trade
QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""",
    "degree_hotspots": f"WITH {DEG_SQL} SELECT * FROM g ORDER BY dependents DESC, id LIMIT 20",
    "coupling_summary": f"WITH {DEG_SQL} SELECT round(avg(coupling), 6) AS avg_coupling, max(coupling) AS max_coupling, min(coupling) AS min_coupling, count(*) AS files FROM g",
    "cycles_bounded": f"""WITH RECURSIVE {E_SQL}, p AS (
  SELECT src AS first, dst AS at, [src, dst] AS path FROM e WHERE dst > src
  UNION ALL SELECT first, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.at
  WHERE e.dst > first AND NOT list_contains(path, e.dst) AND len(path) < 5
) SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p JOIN e ON e.src = p.at AND e.dst = p.first""",
    "mutual_edges": f"WITH {E_SQL} SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
    "layer_violations": f"""WITH {E_SQL}, l AS (SELECT n_nationkey AS id, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.layer AS source_layer, b.layer AS target_layer, src, dst FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst
WHERE a.layer <> b.layer AND (a.layer, b.layer) NOT IN ({", ".join(map(str, ALLOWED))})""",
    "domain_crossings": """SELECT * FROM (SELECT lower(substr(c_mktsegment, 1, 4)) AS from_domain, regexp_extract(p_brand, '^([A-Za-z]+#?\\d)', 1) AS to_domain, count(*) AS crossings
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
WHERE (from_domain, to_domain) NOT IN (('auto', 'Brand#1'), ('buil', 'Brand#2'), ('furn', 'Brand#3'), ('mach', 'Brand#4'))""",
    "focus_reach": f"""WITH RECURSIVE {E_SQL}, p AS (SELECT CAST(0 AS INTEGER) AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM p JOIN e ON src = id WHERE distance < 3)
SELECT id, min(distance) AS distance FROM p GROUP BY id""",
}
