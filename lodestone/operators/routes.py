"""Which route patterns fit a path, without comparing paths with routes of the same length.

A route's mask tells which of its segments hold a {parameter}. A path is written once for every mask that routes of its length have,
with those segments replaced; written so, it equals the routes that can fit it, which an equi-join finds. What it finds is
verified segment by segment, as `{id}.json` is a parameter with more around it. A project has few masks: they are broadcast
up to MASKS rows and joined by length beyond that. Equal paths are asked for once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = 10_000


def pattern_of(path: Column) -> Column:
    """A path with every {x} as {}: two patterns fit one another if these are equal."""
    return F.regexp_replace(path, r"\{[^}]*\}", "{}")


def fits(path: Column, route: Column) -> Column:
    quoted = F.regexp_replace(route, r"([.+*?^$()\[\]|\\])", r"\\$1")
    return (pattern_of(path) == pattern_of(route)) | F.rlike(path, F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^}]*\}", "[^/]+"), F.lit("$")))


def _masked(path: Column, mask: Column) -> Column:
    """The path with `{}` for each segment that stands at a 1 of the mask."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", F.lit("{}")).otherwise(s)), "/")


def fitting(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """method, path and route of all that fit. paths: method, path; routes: method, route; null paths and routes fit nothing."""
    known = routes.select("method", "route").filter("route is not null").distinct()
    mask = F.array_join(F.transform(F.split("route", "/"), lambda s: F.when(s.contains("{"), F.lit("1")).otherwise(F.lit("0"))), "")
    known = known.withColumn("mask", mask).withColumn("kept", _masked(F.col("route"), F.col("mask")))
    masks = known.select(F.length("mask").alias("depth"), "mask").distinct()
    if masks.count() <= MASKS:
        masks = F.broadcast(masks)
    asked = paths.select("method", "path").filter("path is not null").distinct().withColumn("depth", F.size(F.split("path", "/")))
    asked = asked.join(masks, "depth").withColumn("kept", _masked(F.col("path"), F.col("mask"))).drop("depth")
    return asked.join(known, ["method", "mask", "kept"]).filter(fits(F.col("path"), F.col("route"))).select("method", "path", "route")


def first_fitting(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """method, path and the route that answers it: the path itself, else the first in the order of routes."""
    order = F.struct(F.col("path") != F.col("route"), F.col("route"))
    return fitting(paths, routes).groupBy("method", "path").agg(F.min_by("route", order).alias("route"))
