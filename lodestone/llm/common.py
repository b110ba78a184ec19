"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words of lower-cased text without ASCII punctuation, and what stands between them.
WORD, NO_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words of ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parted(text: Column, between: str) -> Column:
    """The text's pieces: only the first and the last one can be empty. Several times faster than to extract them all."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def words(text: Column) -> Column:
    """Array of the WORD matches of the lower-cased text; null: empty."""
    return parted(lower_az(text), NO_WORD)


def tokens(text: Column) -> Column:
    """Array of the runs without BLANK of the text; null: empty."""
    return parted(text, BLANK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(docs: DataFrame, *results: str) -> DataFrame:
    """docs without the columns that are named like a result (case does not count): results take their places."""
    taken = {r.lower() for r in results}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def label_sample(labels: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Of labels(k, y), about sizes[y] rows of each class by a hash of k, each once, and how many each class has. As equal rows
    are one and null keys are none, no key can bring more rows than classes into the sample, so it may be broadcast."""
    once = labels.filter(F.col("y").isin(*sizes) & F.col("k").isNotNull()).select("k", F.col("y").cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    share = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (share < min(1.0, sizes[y] / n)))
    return once.filter(keep), counts


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder is used, which spark.checkpoint.dir names; only a local session (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once into the shared checkpoint folder, without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, of: str = "true") -> tuple[DataFrame, int]:
    """As cut(), but as Parquet, and how many rows fulfil `of`, without a job of their own. For small frames: files are read many to a
    task and their size is known when joins are planned, where a checkpoint has a task a partition and no size."""
    ensure_checkpoint_dir(df.sparkSession)
    path, seen = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count_if(F.expr(of)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, as after cut()."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
