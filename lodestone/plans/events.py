"""Ordered rules and change streams on the events table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.lines import floored_counter, latch, quiet
from lodestone.sources.tables import table

KEY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark, d):
    return table(spark, d, "events")


def latch_calls(spark, d):
    """Errors of a user between a signup and the next purchase."""
    e = events(spark, d)
    e = e.withColumn("open", latch(F.col("event_type") == "signup", F.col("event_type") == "purchase", KEY, ORDER))
    return e.filter("event_type = 'error' and open = 1").select("event_id", "user_id")


def floored_depth(spark, d):
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return floored_counter(events(spark, d), delta, KEY, ORDER).filter("depth > 3").select("event_id", "user_id", F.col("depth").cast("long").alias("depth"))


def latest_def(spark, d):
    last = F.max_by(F.struct("event_id", "value", "props"), F.struct("ts", "event_id"))
    return events(spark, d).groupBy("user_id", "event_type").agg(last.alias("r")).select("user_id", "event_type", "r.event_id", "r.value", "r.props")


def float_calls(spark, d):
    """Clicks that no purchase of the user follows before the next click."""
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    e = events(spark, d).filter(F.col("event_type").isin("click", "purchase")).withColumn("next", F.lead("event_type").over(w))
    return e.filter("event_type = 'click' and next is distinct from 'purchase'").select("event_id", "user_id")


def props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).withColumn("k", k).filter("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def debounce(spark, d):
    """The last event of each burst of a user: events under two hours apart."""
    q = quiet(events(spark, d).select("user_id", "event_id", "ts", "event_type"), KEY, "ts", 7200, ["event_id"])
    return q.select("user_id", "event_id", "event_type", "merged")


def type_counts(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.max("value"), 2).alias("top"))


def stream_replay(spark, d):
    """State of a file table after the events as changes: signup adds, error unlinks, others change."""
    from lodestone.streaming.changes import replay

    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    e = events(spark, d).select(F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"), kind.alias("type"), "ts", F.col("event_id").alias("seq"))
    return replay(e)


def stream_state(spark, d):
    """The same state as stream_replay's, folded by Structured Streaming from the table as a stream of four files."""
    import uuid

    from lodestone.operators.materialize import shared_folder
    from lodestone.streaming.changes import keep_state

    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    events(spark, d).repartition(4, "event_id").write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(events(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    e = stream.select(F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"), kind.alias("type"), "ts", F.col("event_id").alias("seq"))
    query = keep_state(e, f"{folder}/table", f"{folder}/checkpoint")
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.parquet(f"{folder}/table/v={last}").filter("type <> 'unlink'").select("path", "type", "seq")


def session_summary(spark, d):
    """What a session of changes has seen by kind: changes, paths, and the paths that are gone at its end."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    e = events(spark, d).select(F.col("user_id").alias("path"), kind.alias("type"), "ts", F.col("event_id").alias("seq"))
    from lodestone.streaming.changes import summary

    return summary(e)


QUERIES = {f.__name__: f for f in (latch_calls, floored_depth, latest_def, float_calls, props_json, debounce, type_counts, stream_replay, stream_state, session_summary)}
_W = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLES = {
    "latch_calls": f"""SELECT event_id, user_id FROM (SELECT *, last_value(CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 END IGNORE NULLS)
  OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM events) WHERE event_type = 'error' AND open = 1""",
    "floored_depth": f"""WITH s AS (SELECT *, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM events),
m AS (SELECT *, s - least(0, min(s) OVER ({_W} ROWS UNBOUNDED PRECEDING)) AS depth FROM s) SELECT event_id, user_id, CAST(depth AS BIGINT) AS depth FROM m WHERE depth > 3""",
    "latest_def": """SELECT user_id, event_type, event_id, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "float_calls": f"""SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER ({_W}) AS next FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'click' AND next IS DISTINCT FROM 'purchase'""",
    "props_json": """WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM k WHERE k >= 50 GROUP BY event_type""",
    "debounce": f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({_W}) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS merged, row_number() OVER (PARTITION BY user_id, run ORDER BY ts DESC, event_id DESC) AS k FROM r)
SELECT user_id, event_id, event_type, merged FROM n WHERE k = 1""",
    "type_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(max(value), 2) AS top FROM events GROUP BY event_type",
    "stream_replay": """SELECT path, type, seq FROM (SELECT 'src/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS type, event_id AS seq,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND type <> 'unlink'""",
}
ORACLES["stream_state"] = ORACLES["stream_replay"]
ORACLES["session_summary"] = """WITH c AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT type, count(*) AS changes, count(DISTINCT user_id) AS paths, count(*) FILTER (k = 1) AS last_of_path FROM c GROUP BY type"""
