"""A watched folder as a stream of file changes, and findings that follow them.

Spark's file sources see new files only, so each poll lists the folder anew (paths, times and sizes, no contents) and joins the
list with the one before it. Lists and changes are Parquet versions of one folder; a poll that is run again writes the same one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.rules import validate
from lodestone.streaming.changes import replace_findings

#: Rule groups whose findings of a file follow from this file alone.
LOCAL = (
    "lines", "n-plus-one", "nesting", "inconsistent-casing", "log-only-catch", "unnecessary-async", "ddd-boundaries", "distributed-transactions", "resilience-files",
    "leaks", "mixed-async", "react/missing-dependency-array", "react/inconsistent-component-naming", "react/stale-closure-patterns", "data-classes",
)
LIST, CHANGES = "path string, modified timestamp, size long", "path string, type string, ts timestamp, seq long"


def listing(spark: SparkSession, root: str, settle_ms: int = 0) -> DataFrame:
    """path (below root), modified and size of the files that nobody has written to for settle_ms."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = F.lit(root.rstrip("/").removeprefix("file:") + "/")
    below = F.expr("substring(p, locate(s, p) + length(s))")
    rows = raw.select(F.col("path").alias("p"), start.alias("s"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    old = F.unix_millis("modified") <= F.unix_millis(F.current_timestamp()) - settle_ms
    return rows.filter(old).select(below.alias("path"), "modified", "size")


def difference(before: DataFrame, after: DataFrame, seq: int) -> DataFrame:
    """path, type (add, change, unlink), ts and seq of what differs between two lists."""
    both = before.alias("b").join(after.alias("a"), "path", "full_outer")
    kind = (
        F.when(F.col("b.size").isNull(), "add").when(F.col("a.size").isNull(), "unlink")
        .when((F.col("a.modified") != F.col("b.modified")) | (F.col("a.size") != F.col("b.size")), "change")
    )
    return both.select("path", kind.alias("type"), F.coalesce("a.modified", F.current_timestamp()).alias("ts"), F.lit(seq).cast("long").alias("seq")).filter("type is not null")


def poll(spark: SparkSession, root: str, state: str, number: int, settle_ms: int = 0) -> DataFrame:
    """Changes since poll number - 1. The first poll only takes the list: what is there already is no change.

    With settle_ms, a file that is still being written is left as it was listed before."""
    after = listing(spark, root, settle_ms)
    if number:
        before = spark.read.schema(LIST).parquet(f"{state}/list/v={number - 1}").select("path", "modified", "size")
        if settle_ms:
            busy = listing(spark, root).join(after.select("path"), "path", "left_anti").select("path")
            after = after.unionByName(before.join(busy, "path", "left_semi"))
    after.write.mode("overwrite").parquet(f"{state}/list/v={number}")
    after = spark.read.schema(LIST).parquet(f"{state}/list/v={number}").select("path", "modified", "size")
    found = difference(before if number else after, after, number)
    found.write.mode("overwrite").parquet(f"{state}/changes/v={number}")
    return spark.read.schema(CHANGES).parquet(f"{state}/changes/v={number}").select("path", "type", "ts", "seq")


def watch(spark: SparkSession, root: str, state: str, checkpoint: str, every: str = "500 milliseconds", settle_ms: int = 500) -> StreamingQuery:
    """Polls the folder until the query is stopped."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, number: poll(spark, root, state, number, settle_ms).count()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def findings_after(old: DataFrame, files: DataFrame, changed: DataFrame, groups: tuple[str, ...] = LOCAL) -> DataFrame:
    """Findings of local rule groups after changes: only the changed files among files are read by the rules.

    old: the findings of these groups before; equal to validate(files, groups) without what has not changed."""
    now = files.join(changed.select(F.col("path").alias("relative_path")).distinct(), "relative_path", "left_semi")
    return replace_findings(old, validate(now, list(groups)), changed)


def summary_of(state: str, spark: SparkSession) -> DataFrame:
    """type and number of all changes that the polls saw."""
    return spark.read.schema(CHANGES).parquet(f"{state}/changes").groupBy("type").agg(F.count("*").alias("changes"), F.countDistinct("path").alias("paths"))
