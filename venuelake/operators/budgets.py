"""Monthly call budgets of providers by tier: limits, reservations, reconciliation, claims and the kill switch, folded in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the events of a budget are.
SET_LIMIT, RESERVE, RECONCILE, ENQUEUE, CLAIM = "SET_LIMIT", "RESERVE", "RECONCILE", "ENQUEUE", "CLAIM"
_OUT = "event_id bigint, outcome string, month date, limit bigint, consumed bigint, reserved bigint, remaining bigint, job bigint"


class _Budget:
    """One provider's tier. A month starts with the limit that was set last; a change of limit is for its own month and those
    that have not begun."""

    def __init__(self, default: int) -> None:
        self.default = default
        self.months: dict = {}  # month: [limit, enabled, consumed, reserved]
        self.reservations: dict = {}  # id: [month, count, state]
        self.jobs: deque = deque()

    def month(self, month) -> list:
        return self.months.setdefault(month, [self.default, True, 0, 0])

    def left(self, month) -> int:
        limit, _, consumed, reserved = self.month(month)
        return max(0, limit - consumed - reserved)

    def refusal(self, month, count: int) -> str | None:
        limit, enabled, *_ = self.month(month)
        if not enabled:
            return "BUDGET_DISABLED"
        if self.left(month) < count:
            return "ZERO_BUDGET_LIMIT" if limit == 0 else "MONTHLY_LIMIT_EXCEEDED"
        return None

    def reserve(self, number: int, month, count: int) -> str:
        if count is None or count <= 0:
            return "INVALID_COUNT"
        refused = self.refusal(month, count)
        if refused is None:
            self.month(month)[3] += count
            self.reservations[number] = [month, count, "RESERVED"]
        return refused or "RESERVED"

    def reconcile(self, number: int | None, actual: int) -> tuple[str, object]:
        held = self.reservations.get(number)
        if held is None:
            return "RESERVATION_NOT_FOUND", None
        month, count, state = held
        if state != "RESERVED":
            return "ALREADY_RECONCILED", month
        if actual < 0:
            return "NEGATIVE_ACTUAL", month
        if actual > count:
            return "ACTUAL_EXCEEDS_RESERVED", month
        budget = self.month(month)
        if budget[2] + actual > budget[0]:
            return "EXCEEDS_MONTHLY_LIMIT", month
        budget[2] += actual
        budget[3] = max(0, budget[3] - count)
        held[2] = "CONSUMED" if actual > 0 else "RELEASED"
        return held[2], month


def ledger(events: DataFrame, provider: str, tier: str, at: str, event_id: str, default_limit: int = 0) -> DataFrame:
    """(event_id, outcome, month, limit, consumed, reserved, remaining, job) of each event, with the budget as it stands after it.

    Events have `kind`, `amount`, `enabled` and `target`. SET_LIMIT sets the month's limit, and whether the budget is open at
    all; RESERVE asks for `amount` calls; RECONCILE settles the reservation of the event `target` with the `amount` really
    used, which gives the rest back, once; ENQUEUE adds a job; CLAIM reserves one call for the job that waits longest. Months
    are the calendar's in UTC; a reservation is settled in its own month. A refused event changes nothing. After each event
    limit = consumed + reserved + remaining, or remaining is 0 where a limit was set below what is taken. Names of providers
    and tiers are taken without regard to case; events without provider, tier, time or id are left out; unknown kinds and
    negative limits are INVALID. A budget's events are one sequence: they are sorted and streamed in one task, which holds its
    months, reservations and waiting jobs.
    """
    key = [F.lower(F.col(provider)).alias("p"), F.upper(F.col(tier)).alias("t")]
    asked = events.select(*key, F.col(at).alias("at"), F.col(event_id).cast("long").alias("event_id"), "kind", F.col("amount").cast("long"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.col("target").cast("long"), F.trunc(F.col(at), "month").alias("month"))
    ordered = asked.dropna(subset=["p", "t", "at", "event_id"]).repartition("p", "t").sortWithinPartitions("p", "t", "at", "event_id").drop("at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, budget = None, _Budget(default_limit)
        for batch in batches:
            out = []
            for p, t, number, kind, amount, enabled, target, month in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, t) != now:
                    now, budget = (p, t), _Budget(default_limit)
                job, of = None, month
                if kind == SET_LIMIT and amount is not None and amount >= 0:
                    budget.default = amount
                    budget.month(month)[:2] = [amount, enabled]
                    outcome = "LIMIT_SET" if enabled else "KILLED"
                elif kind == RESERVE:
                    outcome = budget.reserve(number, month, amount)
                elif kind == RECONCILE and amount is not None:
                    outcome, settled = budget.reconcile(target, amount)
                    of = settled or month
                elif kind == ENQUEUE:
                    budget.jobs.append(number)
                    outcome = "QUEUED"
                elif kind == CLAIM:
                    outcome = budget.refusal(month, 1) or (None if budget.jobs else "NO_ELIGIBLE_JOBS")
                    if outcome is None:
                        outcome, job = budget.reserve(number, month, 1).replace("RESERVED", "CLAIMED"), budget.jobs.popleft()
                else:
                    outcome = "INVALID"
                limit, _, consumed, reserved = budget.month(of)
                out.append((number, outcome, of, limit, consumed, reserved, budget.left(of), job))
            kinds = (pa.int64(), pa.string(), pa.date32(), *[pa.int64()] * 5)
            names = ("event_id", "outcome", "month", "limit", "consumed", "reserved", "remaining", "job")
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=list(names))

    return ordered.mapInArrow(fold, _OUT)
