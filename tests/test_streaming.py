"""Streams give what their batch twins give, in any order of arrival, across batches and restarts."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from venuelake.operators import leads
from venuelake.streaming import ingest, leases, state

SUBMISSIONS = "source_system string, source_record_id string, id long, canonical_key string, category string, received_at timestamp, occurred_at timestamp"
CATEGORIES = ["RESOURCE_DOWNLOAD", "TALK_TO_SALES", "NEWSLETTER", "TRIAL_STARTED", None]


def files(spark, folder, batches, schema):
    """One file a batch, taken in order of their age."""
    os.makedirs(folder)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{k}")
        (part,) = [f for f in os.listdir(f"{folder}-{k}") if f.endswith(".parquet")]
        target = f"{folder}/{k:03}.parquet"
        os.rename(f"{folder}-{k}/{part}", target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, writer):
    with state.rocksdb(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


def submission(n):
    return ("s", str(n), n, f"k{n % 3}|p", CATEGORIES[n * 7 % 5], datetime(2024, 1, 1, n % 24, n % 60), datetime(2024, 1, 1, n % 24))


def test_projection_of_replays_and_a_restart_in_mid_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    batches = [[submission(n) for n in range(4)] * 2, [submission(n) for n in (2, 5, 7)], *[[submission(rng.randint(0, 40)) for _ in range(6)] for _ in range(3)], [submission(1)]]
    stream = files(spark, str(tmp_path / "in"), batches, SUBMISSIONS)
    projection, checkpoint = str(tmp_path / "projection"), str(tmp_path / "c")
    written = []

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{projection}/batch={number}")
        written.append(number)
        if number == 2:
            raise RuntimeError("lost after writing, before the batch was committed")

    writer = ingest.folded(ingest.first_arrivals(stream)).writeStream.foreachBatch(failing).option("checkpointLocation", checkpoint)
    with pytest.raises(Exception, match="lost after writing"):
        run(spark, writer)
    query = run(spark, ingest.project_batches(stream, projection, checkpoint))
    assert query.exception() is None and written == [0, 1, 2]
    assert [p["batchId"] for p in query.recentProgress if p["numInputRows"]] == [2, 3, 4, 5]
    want = leads.project(spark.createDataFrame(sorted({r for rows in batches for r in rows}, key=str), SUBMISSIONS))
    got = ingest.read_projection(spark, projection).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_batch_reads_its_own_rows_and_gives_its_own_keys(spark, tmp_path):
    batches = [[submission(n) for n in range(k * 5, k * 5 + 5)] for k in range(8)]
    stream = files(spark, str(tmp_path / "in"), batches, SUBMISSIONS)
    query = run(spark, ingest.project_batches(stream, str(tmp_path / "p"), str(tmp_path / "c")))
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [5] * 8
    given = spark.read.option("basePath", str(tmp_path / "p")).parquet(str(tmp_path / "p") + "/batch=*").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in given} == {k: 3 for k in range(8)}


EVENTS = "scope string, at timestamp, id long, kind string"
START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def walked(events, upto, minutes):
    """The fold of all events up to an instant, in order."""
    out = []
    for scope in {e[0] for e in events} - {None}:
        lease = None
        rows = sorted((at, i, kind) for s, at, i, kind in events if s == scope and at is not None and kind in {*minutes, "COMPLETE"} and at <= upto)
        for at, i, kind in [*rows, (upto, None, None)]:
            if lease and lease[0] <= at:
                out.append((scope, lease[1], lease[0], "EXPIRED"))
                lease = None
            if kind == "COMPLETE":
                out.append((scope, i, at, "COMPLETED" if lease else "LATE"))
                lease = None
            elif kind and lease:
                out.append((scope, i, at, "HELD"))
            elif kind:
                out.append((scope, i, at, "GRANTED"))
                lease = (at + timedelta(minutes=minutes[kind]), i)
    return sorted(out)


@pytest.mark.parametrize("n_batches", [1, 5])
def test_leases_in_any_order_of_arrival(spark, tmp_path, n_batches):
    rng = random.Random(12)
    events = []
    for i in range(260):
        at = START + timedelta(minutes=rng.randint(0, 900), microseconds=rng.choice([0, 0, 1, 999]))
        events.append((rng.choice(["hot", "hot", "b", "c", None]), at, i, rng.choice([*leases.MINUTES, "WORK", "COMPLETE", "OTHER"])))
    events += [("edge", START, 300, "WORK"), ("edge", START + timedelta(minutes=10), 301, "COMPLETE"), ("edge", START + timedelta(minutes=10), 302, "WORK"), ("edge", START + timedelta(minutes=19), 303, "WORK")]
    # out of order within a batch and across batches, by less than the delay of two hours
    arrival = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randint(0, 100)))
    size = -(-len(arrival) // n_batches)
    batches = [arrival[k : k + size] for k in range(0, len(arrival), size)]
    stream = files(spark, str(tmp_path / "in"), batches, EVENTS)
    out = leases.lease_outcomes(stream, "scope", "at", "id", F.col("kind"), "2 hours")
    query = run(spark, out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    assert query.exception() is None
    newest = max(e[1] for e in events)
    upto = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - timedelta(hours=2)
    got = sorted((r.key, r.id, r.at.replace(tzinfo=timezone.utc), r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = walked(events, upto, leases.MINUTES)
    assert got == want and {w[3] for w in want} == {"GRANTED", "HELD", "COMPLETED", "LATE", "EXPIRED"}
