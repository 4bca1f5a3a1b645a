"""Queries whose answers come from streams over a table, run to its end, and schedules over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from venuelake.operators import politeness
from venuelake.plans.catalog import register
from venuelake.sources.shared import shared_folder
from venuelake.sources.tables import table
from venuelake.streaming import leases, state

LEASES = {"view": "WORK", "click": "RUN", "signup": "ALERT", "error": "BATCH", "purchase": leases.COMPLETE}


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def finished(query: StreamingQuery) -> None:
    """Wait for a stream's end; what stopped it is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register(
    "lease_outcomes",
    f"""WITH RECURSIVE w AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS upto FROM events),
      e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type {" ".join(f"WHEN '{k}' THEN {leases.MINUTES[v]}" for k, v in LEASES.items() if v in leases.MINUTES)} END AS minutes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events, w WHERE epoch_us(ts) <= upto),
      f AS (SELECT user_id, n, event_id, t, CASE WHEN minutes IS NULL THEN 'LATE' ELSE 'GRANTED' END AS outcome, t + minutes * CAST(60000000 AS BIGINT) AS ends, CASE WHEN minutes IS NOT NULL THEN event_id END AS held, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS BIGINT) AS gone_at FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN minutes IS NULL AND f.ends > e.t THEN 'COMPLETED' WHEN minutes IS NULL THEN 'LATE' WHEN f.ends > e.t THEN 'HELD' ELSE 'GRANTED' END,
          CASE WHEN minutes IS NULL THEN NULL WHEN f.ends > e.t THEN f.ends ELSE e.t + minutes * CAST(60000000 AS BIGINT) END, CASE WHEN minutes IS NULL THEN NULL WHEN f.ends > e.t THEN f.held ELSE e.event_id END,
          CASE WHEN f.ends <= e.t THEN f.held END, CASE WHEN f.ends <= e.t THEN f.ends END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
      SELECT user_id, event_id, make_timestamp(t) AS moment, outcome FROM f UNION ALL SELECT user_id, gone, make_timestamp(gone_at), 'EXPIRED' FROM f WHERE gone IS NOT NULL
      UNION ALL SELECT user_id, held, make_timestamp(ends), 'EXPIRED' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS last FROM f), w WHERE last = 1 AND ends <= upto""",
)
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.create_map(*[F.lit(x) for pair in LEASES.items() for x in pair])[F.col("event_type")]
    out, path = leases.lease_outcomes(events, "user_id", "ts", "event_id", kind, "1 hour"), shared_folder(spark, "leases")
    with state.rocksdb(spark):
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_folder(spark, "leases-state")).trigger(availableNow=True).start()
    finished(query)
    return spark.read.schema(out.schema).parquet(path).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("at").cast("timestamp_ntz").alias("moment"), "outcome")


GAP, RETRY = 300, 3600


@register(
    "polite_schedule",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 15 AS origin, epoch(date_trunc('day', ts)) :: BIGINT AS t, CAST(60 + floor(6 * value) AS BIGINT) AS duration, CASE WHEN event_type = 'error' THEN {RETRY} ELSE 0 END AS retry,
        CAST(1 + 3 * (list_position(['view', 'click', 'signup', 'error', 'purchase'], event_type) - 1) + event_id % 3 AS INT) AS k FROM events),
      n AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY t, event_id) AS n FROM e),
      f AS (SELECT origin, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS free, list_transform(range(15), lambda x: CAST(0 AS BIGINT)) AS ids, list_transform(range(15), lambda x: CAST(0 AS BIGINT)) AS starts, list_transform(range(15), lambda x: CAST(0 AS BIGINT)) AS ends, 0 AS k FROM (SELECT DISTINCT origin FROM e)
        UNION ALL SELECT origin, n, event_id, outcome, CASE WHEN shared THEN free ELSE start + greatest({GAP}, duration + retry) END, CASE WHEN shared THEN ids ELSE list_transform(ids, lambda x, i: CASE WHEN i = k THEN event_id ELSE x END) END,
          CASE WHEN shared THEN starts ELSE list_transform(starts, lambda x, i: CASE WHEN i = k THEN start ELSE x END) END, CASE WHEN shared THEN ends ELSE list_transform(ends, lambda x, i: CASE WHEN i = k THEN start + duration ELSE x END) END, k
        FROM (SELECT f.origin, n.n, n.event_id, n.t < f.ends[n.k] AS shared, CASE WHEN n.t < f.ends[n.k] THEN 'SHARED' ELSE 'ASKED' END AS outcome, greatest(n.t, f.free) AS start, n.duration, n.retry, f.free, f.ids, f.starts, f.ends, n.k FROM f JOIN n ON n.origin = f.origin AND n.n = f.n + 1))
      SELECT event_id, origin, outcome, ids[k] AS asked_by, starts[k] AS start_at, ends[k] AS end_at FROM f WHERE n > 0""",
)
def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 15).alias("origin"), "event_type", F.unix_seconds(F.date_trunc("day", "ts").cast("timestamp")).alias("at"), F.col("value"))
    local = F.unix_seconds(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))  # wall clocks have no zone
    asked = e.withColumn("at", F.col("at") - local).withColumn("key", F.concat_ws("/", "origin", "event_type", F.col("event_id") % 3))
    retry = F.when(F.col("event_type") == "error", RETRY)
    found = politeness.schedule(asked, "origin", "key", "at", "event_id", 60 + F.floor(6 * F.col("value")), F.lit(GAP), retry)
    return found.select(F.col("id").alias("event_id"), "origin", "outcome", "asked_by", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
