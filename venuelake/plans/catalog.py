"""Where queries and their oracle SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def pick(values: Sequence[str | None], index: Column) -> Column:
    """The value at index modulo their number: how a table's keys stand for varied texts."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: Sequence[str | None], index: str) -> str:
    """The same in DuckDB."""
    return f"([{', '.join(map(quoted, values))}])[CAST(1 + ({index}) % {len(values)} AS INT)]"
