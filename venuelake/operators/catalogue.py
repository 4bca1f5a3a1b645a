"""The filterable catalogue: optional predicates, a whitelisted order and a page from one filtered frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelake.functions.text import escaped_ilike


def filtered(rows: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, list] | None = None, contains: Mapping[str, str] | None = None, flags: Mapping[str, bool | None] | None = None, search: tuple[list[str], str] | None = None) -> DataFrame:
    """All given predicates together. A flag of False filters, one of None does not; search is over any of its columns."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    for column, values in (among or {}).items():
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    for column, text in (contains or {}).items():
        if text:
            rows = rows.filter(escaped_ilike(F.col(column), text))
    for column, value in (flags or {}).items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if search and search[1]:
        found = F.lit(False)
        for column in search[0]:
            found = found | F.coalesce(escaped_ilike(F.col(column), search[1]), F.lit(False))
        rows = rows.filter(found)
    return rows


def page(rows: DataFrame, sortable: list[str], sort: str, tie: str, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    if sort not in sortable:
        raise ValueError(f"cannot sort by {sort}")
    key = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(key, F.asc(tie)).offset(max(offset, 0)).limit(min(max(limit, 1), 1000))
