"""Graph operators over nodes(id) and edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import settle

#: Cycles of more nodes are not listed.
MAX_CYCLE = 10


def last_wins(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row per (src, dst): that of the largest order columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    top = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select("src", "dst", "r.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dependents (in), dependencies (out), coupling; isolated nodes have zeros."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dependencies"))
    d = nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["dependents", "dependencies"])
    return d.withColumn("coupling", F.col("dependents") + F.col("dependencies"))


def hotspots(degree: DataFrame, top: int = 20) -> DataFrame:
    return degree.orderBy(F.desc("dependents"), "id").limit(top)


def coupling(degree: DataFrame) -> DataFrame:
    def zero(c):
        return F.coalesce(c, F.lit(0))

    return degree.agg(
        zero(F.round(F.avg("coupling"), 6)).alias("avg_coupling"), zero(F.max("coupling")).alias("max_coupling"),
        zero(F.min("coupling")).alias("min_coupling"), F.count("*").alias("files"),
    )


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those whose source has no way in or whose target has no way out, until none is left: all cycles are among them."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = settle(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of the nodes in strongly connected components of two nodes or more.

    Colours go forward: each node takes the smallest id that reaches it. What of a colour reaches the node of that id is its component; it
    is taken out, and the rest is trimmed and coloured again. Each round is a join on single ids and an aggregation; paths are never built."""
    e = settle(edges.select("src", "dst").filter("src <> dst").distinct())
    done = e.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    while not (e := trimmed(e)).isEmpty():
        color = settle(e.select(F.col("src").alias("id")).distinct().withColumns({"color": F.col("id"), "new": F.lit(True)}))
        while not (moved := color.filter("new")).isEmpty():
            told = e.join(moved.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("told"))
            # a node that learns nothing smaller has nothing to pass on
            less = F.coalesce(F.col("told") < F.col("color"), F.lit(False))
            color = settle(color.join(told, "id", "left").select("id", F.when(less, F.col("told")).otherwise(F.col("color")).alias("color"), less.alias("new")))
        one, two = (color.select(F.col("id").alias(x), F.col("color").alias(f"c_{x}")) for x in ("src", "dst"))
        inner = settle(e.join(one, "src").join(two, "dst").filter("c_src = c_dst").select("src", "dst", F.col("c_src").alias("component")))
        edge = settle(color.filter("id = color").select("id", F.col("color").alias("component")))
        found = edge
        while not edge.isEmpty():
            back = inner.join(edge.withColumnRenamed("id", "dst"), ["dst", "component"]).select(F.col("src").alias("id"), "component").distinct()
            edge = settle(back.join(found, ["id", "component"], "left_anti"))
            found = settle(found.unionByName(edge))
        done = done.unionByName(found)
        gone = found.select("id")
        e = settle(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    many = done.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return done.join(many, "component").select("id", "component", "size")


def cycles(edges: DataFrame, longest: int = MAX_CYCLE, selfloops: bool = True) -> DataFrame:
    """cycle (array of nodes from its smallest one) and length, for every simple cycle of at most `longest` nodes. Paths grow within strongly
    connected components only, and no further than the component has nodes."""
    e = settle(edges.select("src", "dst").distinct())
    loops = e.filter("src = dst").select(F.array("src").alias("cycle"))
    part = settle(components(e))
    one, two = (part.select(F.col("id").alias(x), F.col("component").alias(f"p_{x}")) for x in ("src", "dst"))
    e = settle(e.filter("src <> dst").join(one, "src").join(two, "dst").filter("p_src = p_dst").select("src", "dst"))
    longest = min(longest, part.agg(F.max("size")).first()[0] or 0)
    paths = e.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = loops if selfloops else loops.limit(0)
    back = e.select(F.col("src").alias("at"), F.col("dst").alias("first"))
    for n in range(2, longest + 1):
        closed = paths.join(back, "at").filter(F.col("first") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = found.unionByName(closed)
        if n < longest:
            step = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
            grown = paths.join(step, "at").filter((F.col("to") > F.col("path")[0]) & ~F.array_contains("path", F.col("to")))
            paths = settle(grown.select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at")))
    return found.select("cycle", F.size("cycle").alias("length"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that point at one another, smaller node first."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.filter("src < dst").join(back, ["src", "dst"], "left_semi")


def forbidden(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges between layers that are not allowed. layers: id, layer; allowed: source_layer, target_layer."""
    a = layers.select(F.col("id").alias("src"), F.col("layer").alias("source_layer"))
    b = layers.select(F.col("id").alias("dst"), F.col("layer").alias("target_layer"))
    crossing = edges.join(a, "src").join(b, "dst").filter("source_layer <> target_layer")
    return crossing.join(allowed, ["source_layer", "target_layer"], "left_anti")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id and distance of all nodes within `depth` steps of start(id)."""
    seen = start.select("id", F.lit(0).alias("distance")).distinct()
    edge, step = seen, settle(edges.select("src", "dst").distinct())
    for d in range(1, depth + 1):
        edge = edge.join(step, edge["id"] == step["src"]).select(F.col("dst").alias("id"), F.lit(d).alias("distance")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(edge)
    return seen
