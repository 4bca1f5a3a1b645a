"""Read models over append-only appearances: one canonical row a key, facets, run history, keyset pages, attention lanes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.operators.latest import latest_per_key

INVENTORY_ORDER = ("last_seen_at", "created_at", "id")


def inventory_state(status: Column, deduped: Column) -> Column:
    """First match: duplicates, blocked, rejected, qualified, review, active."""
    return (
        F.when((status == "DUPLICATE") | deduped, "DUPLICATES").when(status == "BLOCKED", "BLOCKED").when(status == "REJECTED", "REJECTED")
        .when(status == "QUALIFIED", "QUALIFIED").when(status == "REVIEW_REQUIRED", "NEEDS_REVIEW").otherwise("ACTIVE")
    )


def inventory_quality(sources: Column, facts: Column, unknowns: Column, resolution: Column) -> Column:
    """Counts of list entries (null: not a list) and the organisation's resolution to a quality label."""
    return (
        F.when(F.coalesce(sources, F.lit(0)) == 0, "MISSING_SOURCE").when(F.coalesce(facts, F.lit(0)) == 0, "NEEDS_EVIDENCE")
        .when((F.coalesce(unknowns, F.lit(0)) > 0) | (resolution == "UNRESOLVED"), "UNRESOLVED").otherwise("READY")
    )


def canonical(appearances: DataFrame) -> DataFrame:
    """The winning appearance of each canonical key, with the key's appearance count.

    Counts are combined before their shuffle, and the winner before its own, so a key with very many appearances costs a
    few rows a task.
    """
    counts = appearances.groupBy("canonical_key").agg(F.count("*").alias("appearance_count"))
    winner = latest_per_key(appearances, "canonical_key", [F.desc_nulls_last(c) for c in INVENTORY_ORDER])
    return (
        winner.join(counts, "canonical_key")
        .withColumn("inventory_state", inventory_state(F.col("status"), F.col("deduped")))
        .withColumn("inventory_quality", inventory_quality(F.col("sources"), F.col("facts"), F.col("unknowns"), F.col("resolution")))
    )


def optional_filters(df: DataFrame, equal: Mapping[str, str | None]) -> DataFrame:
    """Equality filters; None and ALL add no predicate at all, so nothing stands in the way of pushdown."""
    for column, value in equal.items():
        if value is not None and value != "ALL":
            df = df.filter(F.col(column) == value)
    return df


def in_run(canonical_rows: DataFrame, appearances: DataFrame, run: str) -> DataFrame:
    """Keys with any appearance in a run: a semi-join."""
    return canonical_rows.join(appearances.filter(F.col("run_id") == run).select("canonical_key"), "canonical_key", "left_semi")


def search(df: DataFrame, columns: Sequence[str], text: str | None) -> DataFrame:
    """Case-insensitive literal search over several columns."""
    if not text:
        return df
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def clamp_page(page: int, size: int, least: int = 10, most: int = 100) -> tuple[int, int]:
    return max(page, 1), min(max(size, least), most)


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    page, size = clamp_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def facets(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row: total, and a counter a value."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


def histogram(df: DataFrame, key: str, column: str, values: Iterable[str]) -> DataFrame:
    """A row a key with a counter for each of the values."""
    return df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"{v}_count") for v in values])


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence | None, size: int, forward: bool = True) -> DataFrame:
    """Rows strictly after (or before) a cursor in a total order of (column, ascending), one more than `size` to tell whether
    more follow. Sort columns must not be null."""
    steps = [(c, up == forward) for c, up in order]
    if after is not None:
        beyond = F.lit(False)
        for k, (column, up) in enumerate(steps):
            level = F.col(column) > F.lit(after[k]) if up else F.col(column) < F.lit(after[k])
            for (earlier, _), value in zip(steps[:k], after, strict=False):
                level = level & (F.col(earlier) == F.lit(value))
            beyond = beyond | level
        df = df.filter(beyond)
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in steps]).limit(size + 1)


def run_history(appearances: DataFrame, runs: DataFrame, states: Sequence[str]) -> DataFrame:
    """Each run with its appearances, the keys it introduced, and the present state of its keys, each counted once.

    A key's first run is the minimum of (created_at, id), its present row the winner by last seen, updated, created, id:
    both are grouped aggregates. Runs without appearances are kept with zeros; durations are whole seconds.
    """
    order = [F.desc_nulls_last(c) for c in ("last_seen_at", "updated_at", "created_at", "id")]
    current = latest_per_key(appearances, "canonical_key", order).select("canonical_key", F.upper("status").alias("now"))
    first = appearances.groupBy("canonical_key").agg(F.min_by("run_id", F.struct("created_at", "id")).alias("run_id"))
    introduced = first.groupBy("run_id").agg(F.count("*").alias("introduction_count"))
    rows = appearances.groupBy("run_id").agg(F.count("*").alias("appearance_count"))
    members = appearances.select("run_id", "canonical_key").distinct().join(current, "canonical_key")
    counts = members.groupBy("run_id").agg(*[F.count_if(F.col("now") == s).alias(f"{s.lower()}_count") for s in states])
    joined = runs.join(rows, "run_id", "left").join(introduced, "run_id", "left").join(counts, "run_id", "left")
    numbers = ["appearance_count", "introduction_count", *[f"{s.lower()}_count" for s in states]]
    duration = F.floor(F.unix_micros(F.col("completed_at").cast("timestamp")) / 1_000_000) - F.floor(F.unix_micros(F.col("started_at").cast("timestamp")) / 1_000_000)
    return joined.select("run_id", duration.cast("long").alias("duration_seconds"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers])


def attention(rows: DataFrame, lanes: Sequence[tuple[str, Column, Column, int]], at: str, key: str) -> DataFrame:
    """(lane, lane_order, key, at): the first few rows of each lane (name, test, sign, limit), by `at` times the sign, then key.

    One pass: each row goes to the lanes whose test it passes, and all lanes are ranked together, cut to the largest limit
    before the shuffle.
    """
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    mine = [F.when(test, F.struct(F.lit(name).alias("lane"), F.lit(i).alias("lane_order"), (moment * sign).alias("by"), F.lit(limit).alias("most"))) for i, (name, test, sign, limit) in enumerate(lanes)]
    each = rows.select(key, at, F.inline(F.array_compact(F.array(*mine))))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("lane_order").orderBy("by", key)))
    return ranked.filter(F.col("n") <= max(limit for *_, limit in lanes)).filter("n <= most").select("lane", "lane_order", key, at)


def unseen(candidates: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Set difference on a key."""
    return candidates.join(seen.select(*key), list(key), "left_anti")


def first_wins(frames: Sequence[DataFrame], key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Union in which the row of the earliest frame wins a key."""
    out = None
    for number, frame in enumerate(frames):
        part = frame.withColumn("__frame", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return latest_per_key(out, list(key), [F.asc("__frame"), *map(F.asc, tie)]).drop("__frame")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children; none gives an empty array."""
    fields = [*order, *[c for c in children.columns if c not in order and c != key]]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))
