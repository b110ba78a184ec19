"""Cutting lineage of frames that are read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which spark.checkpoint.dir names; only a local session (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
            folder = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The rows of df, computed once into the shared folder; a frame that is there already is given back."""
    if getattr(df, "_lodestone_kept", False):
        return df
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._lodestone_kept = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """As settle(), but as Parquet: for rows with long or repeated texts, which take a fraction of a checkpoint's room there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_kept = True
    return out
