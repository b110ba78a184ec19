"""File changes as rows: path, type (add, change, unlink), ts, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(changes: DataFrame) -> DataFrame:
    """path, type and seq of the files that are there after all changes."""
    last = F.max_by(F.struct("type", "seq"), F.struct("ts", "seq"))
    return changes.groupBy("path").agg(last.alias("r")).select("path", "r.type", "r.seq").filter("type <> 'unlink'")


def debounced(changes: DataFrame, quiet: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Of a stream: the last change of each burst of a path."""
    windowed = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("burst"))
    return windowed.agg(F.max_by(F.struct("type", "seq"), F.struct("ts", "seq")).alias("r")).select("path", "r.type", "r.seq", F.col("burst.end").alias("ts"))


def keep_state(changes: DataFrame, state_dir: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folds a stream of changes into Parquet versions `state_dir/v=N`: each batch rewrites the table of the latest row a path."""
    spark = changes.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "type", "ts", "seq")
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{state_dir}/v={number - 1}").select("path", "type", "ts", "seq"))
        last = rows.groupBy("path").agg(F.max_by(F.struct("type", "ts", "seq"), F.struct("ts", "seq")).alias("r")).select("path", "r.*")
        last.write.mode("overwrite").parquet(f"{state_dir}/v={number}")

    writer = changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths whose findings may differ: the changed ones and what points at them."""
    to = edges.join(changed.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("path"))
    return changed.select("path").unionByName(to).distinct()


def replace_findings(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The finding set with the rows of changed files replaced."""
    return old.join(changed.select(F.col("path").alias("file")).distinct(), "file", "left_anti").unionByName(new)


def summary(changes: DataFrame) -> DataFrame:
    """type, changes, paths, and of how many paths a change of this type was the last."""
    last = changes.groupBy("path").agg(F.max_by("type", F.struct("ts", "seq")).alias("type")).groupBy("type").agg(F.count("*").alias("last_of_path"))
    seen = changes.groupBy("type").agg(F.count("*").alias("changes"), F.countDistinct("path").alias("paths"))
    return seen.join(last, "type", "left").fillna(0, ["last_of_path"])
