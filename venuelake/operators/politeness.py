"""Polite schedules of requests: one at a time for an origin, spaced, after cool-downs, identical ones in flight shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.sources.shared import checkpointed

#: Pairs of key and arrival that are sent to every task; where there are more, the requests are dealt by them.
MOST_SENT = 100_000


def _split(rows: DataFrame, group: str, part: str) -> DataFrame:
    """`rows` with the number of the range of (group, at, id) that each lies in. Ranges follow the order, so a scan over a
    group is a scan over each of its ranges, all tasks at once, and one over the ranges' totals."""
    keys = [group, "at", "id"]
    return checkpointed(rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))


def _within(part: str, group: str) -> Window:
    return Window.partitionBy(part, group).orderBy("at", "id")


def _started(rows: DataFrame) -> DataFrame:
    """`rows` with `start` of those that are `asked`: start = max(arrival, the start before + its weight) along an origin, a
    prefix scan in (max, +). With the weights summed up to a row, W, it is W + the greatest arrival - W so far."""
    weight, arrival = F.when(F.col("asked"), F.col("weight")).otherwise(F.lit(0)), F.when(F.col("asked"), F.col("at"))
    order = _within("origin_part", "origin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("summed", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    local = local.withColumn("lead", arrival - F.col("summed"))
    totals = local.groupBy("origin_part", "origin").agg(F.sum(weight).alias("weights"), F.max("lead").alias("most"))
    earlier = Window.partitionBy("origin").orderBy("origin_part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = totals.withColumn("shift", F.coalesce(F.sum("weights").over(earlier), F.lit(0)))
    carried = shifted.withColumn("carried", F.max(F.col("most") - F.col("shift")).over(earlier)).select("origin_part", "origin", "shift", "carried")
    joined = local.withColumn("lead", F.max("lead").over(order)).join(carried, ["origin_part", "origin"])
    start = F.col("shift") + F.col("summed") + F.greatest(F.col("carried"), F.col("lead") - F.col("shift"))
    return joined.withColumn("start", F.when(F.col("asked"), start)).drop("summed", "lead", "shift", "carried")


def _in_flight(rows: DataFrame) -> DataFrame:
    """`rows` with `first`, the newest request before each that was asked with the same key: (id, start, end)."""
    asked = F.when(F.col("asked"), F.struct("id", "start", (F.col("start") + F.col("duration")).alias("end")))
    order = _within("key_part", "key").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("first", F.last(asked, ignorenulls=True).over(order))
    totals = rows.groupBy("key_part", "key").agg(F.max_by(asked, F.when(F.col("asked"), F.struct("at", "id"))).alias("newest"))
    earlier = Window.partitionBy("key").orderBy("key_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("key_part", "key", F.last("newest", ignorenulls=True).over(earlier).alias("carried"))
    return local.join(carried, ["key_part", "key"]).withColumn("first", F.coalesce("first", "carried")).drop("carried")


def schedule(requests: DataFrame, origin: str, key: str, at: str, request_id: str, duration: Column, spacing: Column, retry_after: Column | None = None) -> DataFrame:
    """(id, origin, outcome, asked_by, start, end) of each request, times in the unit of `at`, a whole number.

    Requests of an origin go by arrival and id, one at a time: each starts at its arrival, at the end of the one before, `spacing`
    after that one's start, and when the cool-down that it told (`retry_after`, null: none) is over, whichever is last. A request
    whose `key` is that of one asked and not ended at its arrival is SHARED: it takes no turn and has that one's times;
    `asked_by` is that one's id. Others are ASKED. Requests without origin, key, time or id are left out; a null duration or
    spacing is 0.

    Who shares depends on ends, and ends on who shares; both only on earlier requests. So rounds from "all are asked" to
    the point where none changes settle more of the earliest each time, which ends; a backlog over days takes some tens of
    rounds, requests that are answered within theirs a few. Neither an origin's nor a key's rows meet in one task.

    Of the requests of one key and arrival, those behind the first that lasts are SHARED whatever the rounds find: if that one is
    asked, it ends after this arrival; if not, the one it shares does. So only the others go through the rounds, and at the end
    those behind take what the first that lasts was given.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    busy = zero(duration) + zero(F.lit(None).cast("long") if retry_after is None else retry_after)
    every = requests.select(F.col(request_id).alias("id"), F.col(origin).alias("origin"), F.col(key).alias("key"), F.col(at).cast("long").alias("at"), zero(duration).alias("duration"), F.greatest(zero(spacing), busy).alias("weight"))
    every = every.dropna(subset=["id", "origin", "key", "at"])
    heads = checkpointed(every.filter("duration > 0").groupBy("key", "at").agg(F.min("id").alias("head")))
    sent = F.broadcast if heads.count() <= MOST_SENT else lambda d: d
    rows = _split(every.join(sent(heads), ["key", "at"], "left").filter("head is null or id <= head").drop("head"), "key", "key_part")
    rows = _split(rows, "origin", "origin_part").withColumn("asked", F.lit(True))
    while True:
        judged = checkpointed(_in_flight(_started(rows)).withColumn("now", F.coalesce(F.col("at") >= F.col("first.end"), F.lit(True))))
        if not judged.filter("now <> asked").limit(1).count():
            break
        rows = judged.select("id", "origin", "key", "at", "duration", "weight", "key_part", "origin_part", F.col("now").alias("asked"))
    own = F.struct("id", "start", (F.col("start") + F.col("duration")).alias("end"))
    settled = judged.withColumn("by", F.when(F.col("asked"), own).otherwise(F.col("first"))).withColumn("outcome", F.when(F.col("asked"), "ASKED").otherwise("SHARED"))
    given = settled.filter("duration > 0").select("key", "at", F.col("id").alias("head"), "by").dropDuplicates(["key", "at"])
    behind = every.select("id", "origin", "key", "at").join(sent(given), ["key", "at"]).filter("id > head").withColumn("outcome", F.lit("SHARED"))
    columns = ["id", "origin", "outcome", F.col("by.id").alias("asked_by"), "by.start", "by.end"]
    return settled.select(*columns).unionByName(behind.select(*columns))
