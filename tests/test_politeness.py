import random

import pytest
from pyspark.sql import functions as F

from venuelake.operators import politeness


def walked(requests, gap):
    """Each origin's requests one after another."""
    free, newest, out = {}, {}, []
    for origin, at, i, key, duration, retry in sorted(r for r in requests if None not in r[:4]):
        lead = newest.get(key)
        if lead and at < lead[2]:
            out.append((i, origin, "SHARED", *lead))
            continue
        start = max(at, free.get(origin, at))
        free[origin] = start + max(gap, (duration or 0) + (retry or 0))
        newest[key] = (i, start, start + (duration or 0))
        out.append((i, origin, "ASKED", *newest[key]))
    return sorted(out)


@pytest.mark.parametrize(("n", "span", "hot"), [(400, 3000, 0.5), (60, 20, 0.9), (1, 5, 1.0)])
def test_schedule_equals_a_walk(spark, n, span, hot):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        origin = "hot" if rng.random() < hot else rng.choice("abc")
        rows.append((origin, rng.randint(0, span), i, f"{origin}/{rng.randint(0, 6)}", rng.choice([None, 0, 5, 40]), rng.choice([None, None, 90])))
    rows += [(None, 1, 9000, "x", 1, None), ("hot", None, 9001, "x", 1, None), ("hot", 1, 9002, None, 1, None)]
    frame = spark.createDataFrame(rows, "origin string, at long, id long, key string, d long, r long").repartition(3)
    got = politeness.schedule(frame, "origin", "key", "at", "id", F.col("d"), F.lit(10), F.col("r"))
    assert got.columns == ["id", "origin", "outcome", "asked_by", "start", "end"]
    want = walked(rows, 10)
    assert sorted(map(tuple, got.collect())) == want
    if n > 50:
        assert {w[2] for w in want} == {"ASKED", "SHARED"}


def test_no_requests(spark):
    empty = spark.createDataFrame([], "origin string, at long, id long, key string")
    assert politeness.schedule(empty, "origin", "key", "at", "id", F.lit(1), F.lit(1)).collect() == []


@pytest.mark.parametrize("most_sent", [0, 1000])
def test_requests_of_one_arrival_share_without_rounds(spark, monkeypatch, most_sent):
    """Of 3,000 requests of four keys at five instants, those behind the first that lasts enter no round; those without a duration may."""
    rng = random.Random(3)
    rows = [(o, rng.choice([0, 50, 51, 300, 301]), i, f"{o}/{rng.randint(0, 1)}", rng.choice([None, 0, 30, 70]), None) for i, o in enumerate(rng.choices("ab", k=3000))]
    rows += [("b", 9000 + i % 2, 4000 + i, "b/z", 0, 5) for i in range(6)]
    sizes, started = [], politeness._started
    monkeypatch.setattr(politeness, "MOST_SENT", most_sent)
    monkeypatch.setattr(politeness, "_started", lambda d: sizes.append(d.count()) or started(d))
    frame = spark.createDataFrame(rows, "origin string, at long, id long, key string, d long, r long").repartition(3)
    got = politeness.schedule(frame, "origin", "key", "at", "id", F.col("d"), F.lit(10), F.col("r"))
    assert sorted(map(tuple, got.collect())) == walked(rows, 10)
    assert max(sizes) < 200
