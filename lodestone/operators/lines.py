"""Operators over ordered rows of a key: contexts, latches, floored counters, quiet intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """files without content, with line_no (from 1) and line."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("_p", "line")).select(*keep, (F.col("_p") + 1).alias("line_no"), "line")


def around(key: list[str], order: list[str], before: int, after: int, line: str = "line") -> Column:
    """The lines from -before to +after, joined."""
    return F.concat_ws("\n", F.collect_list(line).over(W.partitionBy(*key).orderBy(*order).rowsBetween(-before, after)))


def latch(setter: Column, reset: Column, key: list[str], order: list[str]) -> Column:
    """1 after a row that sets, 0 after one that resets (a row of both resets), as of the row before."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(reset, 0).when(setter, 1), ignorenulls=True).over(w), F.lit(0))


def floored(delta: Column, key: list[str], order: list[str]) -> tuple[Column, Column]:
    """Expressions of (running sum, smallest running sum): the counter that never falls under 0 is s - least(0, min)."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.sum(delta).over(w), w


def floored_counter(df: DataFrame, delta: Column, key: list[str], order: list[str], name: str = "depth") -> DataFrame:
    running, w = floored(delta, key, order)
    df = df.withColumn("_s", running)
    return df.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def quiet(events: DataFrame, key: list[str], ts: str, gap_s: float, order: list[str]) -> DataFrame:
    """The last event of each run of events of a key that are less than gap_s apart, with the run's size."""
    by = W.partitionBy(*key).orderBy(ts, *order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(by)
    runs = events.withColumn("_new", F.coalesce((gap >= int(gap_s * 1e6)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    rest = [c for c in events.columns if c not in key]
    out = runs.groupBy(*key, "_run").agg(F.max_by(F.struct(*rest), F.struct(ts, *order)).alias("r"), F.count("*").alias("merged"))
    return out.select(*key, "r.*", "merged")
