"""A training-corpus pipeline: five stages, each of one operator, over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs, whose rows have a fixed order therefore. All but the last return the columns of documents.

1. toxicity: documents that the grammar rejects go. Null texts have no evidence and stay.
2. near duplicates: of each component of the Jaccard join one row stays, the first by doc_id, hash of the text and place in
   the table, so repeated rows and repeated ids lose no text; empty texts stay.
3. substring dedup: repeated passages are cut from the texts, and n_chars follows. A text without any stays as it is.
4. decontamination: contaminated documents go.
5. mixing: the rows of the mix, taken being the words that each document gives.

Rows with a null doc_id stay in stages 1 to 4. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op3_toxicity, op6_decontam, op8_mix, op9_substrings, op10_jaccard
from lodestone.llm.common import ensure_checkpoint_dir, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = op3_toxicity.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(~held))
    return op3_toxicity.scored(docs, model, keep_text=True).filter(F.col("score") < op3_toxicity.PREDICT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by where they are read, as ids and texts may repeat
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    known = rows.filter("doc_id is not null")
    found = op10_jaccard.near_duplicates(known, key="_row")
    order = known.select("_row", F.struct("doc_id", F.xxhash64("text").alias("h"), "_row").alias("o"))
    first = found.join(order, "_row").groupBy("component_id").agg(F.min("o")["_row"].alias("_row"))
    # what goes: every row of a component but its first
    gone = found.select("_row").join(first, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op9_substrings.repeated_passages(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_decontam.cleaned(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_mix.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: The first stage scores with a learned model, which SQL can't express; tests hold a whole run against SQL and brute force by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
