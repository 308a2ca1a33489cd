"""Queries of state that expires: the same over the table and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import online as O
from spindrift.operators.asof import asof_join
from spindrift.operators.shared import shared_path
from spindrift.plans.base import query, table
from spindrift.streaming import expiring as X

EVENTS = """e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS kind, 'c' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS VARCHAR) AS category, value, json_extract_string(props, '$.k') AS item FROM events)"""


def counters_sql(steps: str, lifetime: str) -> str:
    """Counters as of an hour before the last event that counts; steps: their +1 and -1."""
    return f"""WITH {EVENTS}, a AS (SELECT user_id, category, ts, event_id, {steps} AS step FROM e WHERE step IS NOT NULL), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS until FROM a),
c AS (SELECT a.* FROM a, w WHERE ts <= until),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o > INTERVAL {lifetime} THEN 1 ELSE 0 END AS fresh FROM c WINDOW o AS (PARTITION BY user_id, category ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, category ORDER BY ts, event_id) AS stretch FROM g),
l AS (SELECT *, sum(step) OVER (PARTITION BY user_id, category, stretch ORDER BY ts, event_id) AS walked FROM s QUALIFY stretch = max(stretch) OVER (PARTITION BY user_id, category)),
n AS (SELECT user_id, category, sum(step) - least(0, min(walked)) AS n, max(ts) AS last FROM l GROUP BY ALL)
SELECT user_id, category, CAST(n AS BIGINT) AS n FROM n, w WHERE n > 0 AND until - last <= INTERVAL {lifetime}"""


def streamed(spark, sf_dir):
    """The clickstream table as a stream in a session of its own."""
    own = X.session(spark)
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream of one plain path must have a folder there
    return O.events_of(own.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))


def counted(spark, sf_dir, step, seconds):
    """What counters hold at the end of the stream."""
    path, checkpoint = shared_path(spark, "counters"), shared_path(spark, "counter-state")
    X.run_to_end(X.user_counters(streamed(spark, sf_dir), step, seconds), path, checkpoint, "update")
    schema = "user_id long, category string, n long, batch long"
    return X.last_of_each(spark.read.schema(schema).parquet(path), "user_id", "category").where("n > 0")


@query(counters_sql("CASE kind WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 END", "7 DAYS"))
def streamed_cart_counts(spark, sf_dir):
    """Cart counters of seven days' life by user and category, by a stream: as of its watermark, an hour before the last event that counts."""
    return counted(spark, sf_dir, F.when(F.col("kind") == "click", 1).when(F.col("kind") == "purchase", -1), O.CART_DAYS * 86400)


@query(counters_sql("CASE WHEN kind = 'view' AND coalesce(value * 100, 0) < 2000 THEN 1 END", "4 HOURS"))
def streamed_skip_counts(spark, sf_dir):
    """Skip counters of four hours' life by a stream, as of its watermark."""
    return counted(spark, sf_dir, F.when((F.col("kind") == "view") & (F.coalesce("duration_ms", F.lit(0.0)) < O.SKIP_MS), 1), O.SKIP_HOURS * 3600)


def operations(events):
    """Events as operations on a cache: clicks put, errors delete, views get; the key is the user, the lifetime an hour times the category's number."""
    op = F.when(F.col("kind") == "click", "put").when(F.col("kind") == "error", "delete").when(F.col("kind") == "view", "get")
    rows = events.select("event_id", "ts", F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("item").alias("value"), ((F.substring("category", 2, 9).cast("long") + 1) * 3600).alias("seconds"))
    return rows.where("op IS NOT NULL")


CACHE_SQL = f"""WITH {EVENTS}, o AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS key, kind, coalesce(item, '') AS value, CAST(substring(category, 2) AS BIGINT) + 1 AS hours FROM e WHERE kind IN ('click', 'error', 'view')),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS until FROM o),
g AS (SELECT * FROM o, w WHERE kind = 'view' AND ({{0}})), p AS (SELECT * FROM o WHERE kind IN ('click', 'error'))
SELECT g.key, g.event_id, CASE WHEN p.kind = 'click' AND g.ts <= p.ts + to_hours(p.hours) THEN p.value END AS value FROM g ASOF LEFT JOIN p ON g.key = p.key AND g.ts >= p.ts"""


@query(CACHE_SQL.format("true"))
def cache_reads(spark, sf_dir):
    """What each get of a cache with lifetimes finds, over the table: the last put or delete before it, if that still lives."""
    rows = operations(O.events_of(table(spark, sf_dir, "events")))
    written = rows.where("op <> 'get'").groupBy("key", "ts").agg(F.max_by(F.struct("op", "value", "seconds"), "event_id").alias("held"))
    found = asof_join(rows.where("op = 'get'").select("key", "event_id", "ts"), written.select("key", F.col("ts").alias("since"), "held", F.col("ts").alias("put_at")), ["key"], "ts", "since")
    lives = (F.col("held.op") == "put") & (F.unix_micros("ts") - F.unix_micros("put_at") <= F.col("held.seconds") * 1_000_000)
    return found.select("key", "event_id", F.when(lives, F.col("held.value")).alias("value"))


@query(CACHE_SQL.format("ts <= until"))
def streamed_cache_reads(spark, sf_dir):
    """The same by a stream, for the gets that its watermark has passed."""
    path, checkpoint = shared_path(spark, "reads"), shared_path(spark, "cache-state")
    X.run_to_end(X.cache_reads(operations(streamed(spark, sf_dir))), path, checkpoint, "append")
    return spark.read.schema("key string, event_id long, value string, batch long").parquet(path).drop("batch")
