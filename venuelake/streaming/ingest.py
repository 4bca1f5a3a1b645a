"""Structured Streaming over the submission ledger: exactly once by key, a folded projection, windows and expiry.

Streams of `first_arrivals` and `folded` keep keyed state and must be started inside `state.rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from venuelake.operators import leads


def once_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Replays within the delay are dropped; state older than the watermark goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def append_ledger(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to a ledger of Parquet files by UTC day."""
    return stream.withColumn("day", F.to_date("received_at")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


SOURCE = ("source_system", "source_record_id")
#: Parts of a batch that are searched for its first arrivals one by one, so that a task holds a small share of the keys.
_PARTS = 1024


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows with one key the least by time of receipt and id. No more is held than twice the keys and a batch."""
    held, fresh = [], 0

    def reduced() -> pa.Table:
        rows = pa.Table.from_batches(held).sort_by([("__received", "ascending"), ("id", "ascending")])
        placed = pa.table([*(rows[c] for c in SOURCE), pa.array(range(len(rows)), pa.int64())], names=[*SOURCE, "place"])
        return rows.take(placed.group_by(list(SOURCE), use_threads=False).aggregate([("place", "min")])["place_min"])

    kept = 0
    for batch in batches:
        held.append(batch)
        fresh += len(batch)
        if fresh > max(kept, 10_000):
            held = reduced().combine_chunks().to_batches()
            kept, fresh = sum(map(len, held)), 0
    if held:
        yield from reduced().to_batches()


def first_arrivals(stream: DataFrame) -> DataFrame:
    """Of the submissions with one (source_system, source_record_id) only the first, in whichever batches they come; of those
    that come together, the least by time of receipt and id. A batch's own rows are reduced without state, in parts by a hash of
    the key; then the state of a key is that it was seen, looked up by key: no batch reads what earlier ones have brought."""
    marked = stream.withColumn("__received", F.coalesce(F.unix_micros("received_at"), F.lit(-(1 << 62))))
    parts = marked.groupBy(F.pmod(F.xxhash64(*SOURCE), F.lit(_PARTS)))
    return parts.applyInArrow(_least, marked.schema).drop("__received").dropDuplicates(list(SOURCE))


#: The fold of a key: what `leads.partials` keeps, times as microseconds.
_STATE = "first_received bigint, first_id bigint, first_category string, last_received bigint, last_id bigint, latest_category string, activity_count bigint, highest_rank int, high bigint, first_activity bigint, last_activity bigint"
_NAMES = tuple(f.split()[0] for f in _STATE.split(", "))


def _ahead(a: Any, b: Any, best: Any) -> Any:
    return b if a is None else a if b is None else best(a, b)


class _Fold(StatefulProcessor):
    """Puts the rows of a batch into the state of their key and gives the new state out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        s = dict(zip(_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(_NAMES) | {"activity_count": 0, "high": 0}
        for r in rows:
            order = (r["received"], r["id"])
            if not s["activity_count"] or order < (s["first_received"], s["first_id"]):
                s |= {"first_received": order[0], "first_id": order[1], "first_category": r["category"]}
            if not s["activity_count"] or order > (s["last_received"], s["last_id"]):
                s |= {"last_received": order[0], "last_id": order[1], "latest_category": r["category"]}
            s["activity_count"] += 1
            s["highest_rank"] = _ahead(s["highest_rank"], r["rank"], max)
            s["high"] += (r["rank"] or 0) >= 4
            s["first_activity"] = _ahead(s["first_activity"], r["occurred"], min)
            s["last_activity"] = _ahead(s["last_activity"], r["occurred"], max)
        self.state.update(tuple(s[n] for n in _NAMES))
        return iter([Row(canonical_key=key[0], **s)])

    def close(self) -> None:
        pass


def folded(submissions: DataFrame) -> DataFrame:
    """The state of each key after each batch that has rows of it. A batch costs its own rows and keys, whatever came before:
    the state of a key is one row, which the store loads by key."""
    rows = submissions.select(
        "canonical_key", F.unix_micros("received_at").alias("received"), "id", "category",
        leads.lookup(F.col("category"), leads.RANKS).cast("int").alias("rank"), F.unix_micros("occurred_at").alias("occurred"),
    )
    return rows.groupBy("canonical_key").transformWithState(_Fold(), f"canonical_key string, {_STATE}", "Append", "None")


def project_batches(stream: DataFrame, projection: str, checkpoint: str) -> DataStreamWriter:
    """First arrivals folded by key; the states that a batch changed are written under its number, so a repeated batch replaces
    itself. `read_projection` takes the newest state of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{projection}/batch={number}")

    return folded(first_arrivals(stream)).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)


def read_projection(spark: SparkSession, projection: str) -> DataFrame:
    """The projected leads. A key's newest state is the one with the most activities."""
    states = spark.read.parquet(f"{projection}/batch=*")
    newest = states.groupBy("canonical_key").agg(F.max_by(F.struct(*_NAMES), "activity_count").alias("s")).select("canonical_key", "s.*")
    moment = lambda c: F.timestamp_micros(c).alias(c)
    return leads.finished(newest.select("canonical_key", "first_category", "latest_category", "activity_count", "highest_rank", "high", moment("first_activity"), moment("last_activity")))


def windowed_counts(stream: DataFrame, at: str, size: str, delay: str, key: str) -> DataFrame:
    """Counts by event-time window and key, late events within the delay included."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
