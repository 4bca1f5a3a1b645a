"""Budgets, leases and reservations as aggregates and ordered admissions over ledgers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from venuelake.sources.shared import checkpointed


def budget_state(receipts: DataFrame, allowances: DataFrame, as_of: Column) -> DataFrame:
    """Each allowance's state at an instant, from its receipts (allowance_id, amount, at) and the provider's last snapshot.

    Allowances are (allowance_id, monthly, allocated, reserved, requests, max_requests, price, enabled, verified_at,
    expires_at) with the snapshot's (available, month_consumed, month, ledger_month, ledger_reserved, grant_left,
    grant_expires, basis) and the limits (ceiling, reserve). Unspent grant is lost at its expiry: only receipts between the
    snapshot and the expiry have drawn on it. Month to date and the last 24 hours, both ends closed, are conditional sums of
    one grouped pass; allowances without receipts have zeros. The stage goes by the lesser of the provider's and the internal
    part that is left: blocked below one request, 10_percent, 25_percent, healthy.
    """
    at, amount = F.col("at"), F.col("amount")
    joined = receipts.join(allowances.select("allowance_id", "verified_at", "grant_expires"), "allowance_id")
    before_expiry = (at > F.col("verified_at")) & (at < F.col("grant_expires")) & (at <= as_of)
    spent = joined.groupBy("allowance_id").agg(
        F.sum(F.when((at >= F.date_trunc("month", as_of)) & (at <= as_of), amount)).alias("month_ledger"),
        F.sum(F.when((at >= as_of - F.expr("interval 24 hours")) & (at <= as_of), amount)).alias("burn"),
        F.sum(F.when(before_expiry, amount)).alias("pre_expiry"),
    )
    zero = F.lit(0).cast("long")
    full = allowances.join(spent, "allowance_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("month_ledger", "burn", "pre_expiry")})
    told = F.coalesce("month_consumed", zero) + F.greatest(zero, F.col("month_ledger") - F.coalesce("ledger_month", zero))
    used = F.when(F.col("month") == F.date_format(as_of, "yyyy-MM"), F.greatest("month_ledger", told)).otherwise(F.col("month_ledger"))
    full = full.withColumn("month_used", used).withColumn("debt", F.greatest(zero, F.col("reserved") - F.coalesce("ledger_reserved", zero)))
    lost = F.greatest(zero, F.coalesce("grant_left", zero) - F.least("debt", "pre_expiry"))
    full = full.withColumn("expired_grant", F.when(as_of >= F.col("grant_expires"), lost).otherwise(zero))
    full = full.withColumn("projected", F.greatest(zero, F.coalesce("available", zero) - F.col("debt") - F.col("expired_grant")))
    full = full.withColumn("denominator", F.least("allocated", "ceiling", F.col("max_requests") * F.col("price")))
    by_month = F.greatest(zero, F.col("denominator") - F.col("month_used"))
    by_life = F.least(F.greatest(zero, F.col("denominator") - F.col("reserved")), F.greatest(zero, (F.col("max_requests") - F.col("requests")) * F.col("price")))
    full = full.withColumn("allowance_left", F.when(F.col("monthly"), by_month).otherwise(by_life))
    kept = F.when(F.col("monthly"), F.greatest(zero, F.col("projected") - F.col("reserve"))).otherwise(F.col("projected"))
    reason = (
        F.when(F.col("available").isNull(), "PROVIDER_BALANCE_UNVERIFIED")
        .when(~F.col("enabled") | (F.col("verified_at") > as_of) | (F.col("expires_at") <= as_of), "ALLOWANCE_INACTIVE")
        .when(F.col("monthly") & (F.col("projected") < F.col("reserve") + F.col("price")), "PROVIDER_ACCOUNT_RESERVE")
        .when(F.least("allowance_left", kept) < F.col("price"), "ALLOCATION_EXHAUSTED")
    )
    full = full.withColumn("reason", reason).withColumn("remaining", F.when(F.col("reason").isNull(), F.least("allowance_left", kept)).otherwise(zero))
    basis = F.coalesce("basis", F.coalesce("available", zero) + F.coalesce("month_consumed", zero))
    part = lambda left, whole: F.when(whole > 0, F.least(F.lit(1.0), left / whole)).otherwise(0.0)
    fraction = F.least(part(F.col("projected"), basis), part(F.col("allowance_left"), F.col("denominator")))
    stage = F.when(F.col("remaining") < F.col("price"), "blocked").when(fraction <= 0.10, "10_percent").when(fraction <= 0.25, "25_percent").otherwise("healthy")
    return full.select("allowance_id", "month_used", "burn", "debt", "expired_grant", "projected", "allowance_left", "remaining", "reason", stage.alias("stage"), F.expr("remaining div price").alias("remaining_requests"))


def admit(requests: DataFrame, scope: Sequence[str], order: Sequence[Column], caps: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """Requests with `decision`: the first cap (name, amount, limit) that the request would pass on top of those of its
    scope admitted before it, in order, else ADMITTED. A refused request counts towards no cap; a null amount is 0.

    What a request finds depends on each decision before it, so rows are folded in order with running totals: a scope lies
    in one partition, sorted and streamed, never gathered.
    """
    names, limits = [name for name, *_ in caps], [limit for *_, limit in caps]
    keys, amounts = [f"__scope{i}" for i in range(len(scope))], [f"__amount{i}" for i in range(len(caps))]
    marked = requests.select("*", *[F.col(c).alias(k) for c, k in zip(scope, keys, strict=True)], *[F.coalesce(c, F.lit(0)).alias(a) for (_, c, _), a in zip(caps, amounts, strict=True)])
    dealt = (marked.repartition(*keys) if keys else marked.repartition(1)).sortWithinPartitions(*keys, *order)
    kept = [f for f in requests.schema.fields if f.name != "decision"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            decisions = []
            for row, asked in enumerate(zip(*(batch.column(a).to_pylist() for a in amounts), strict=True)):
                key = tuple("NaN" if c[row] != c[row] else c[row] for c in columns)
                if key != now:
                    now, totals = key, [0] * len(limits)
                sums = [t + a for t, a in zip(totals, asked, strict=True)]
                refused = next((name for name, total, limit in zip(names, sums, limits, strict=True) if total > limit), None)
                if refused is None:
                    totals = sums
                decisions.append(refused or "ADMITTED")
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(decisions, pa.string())], names=[*(f.name for f in kept), "decision"])

    return dealt.mapInArrow(fold, StructType([*kept]).add("decision", StringType()))


def first_failing(guards: Sequence[tuple[str, Column]], otherwise: str = "ADMITTED") -> Column:
    """The name of the first guard that does not hold."""
    out = F.lit(otherwise)
    for name, holds in reversed(guards):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def spaced(requests: DataFrame, scope: Sequence[str], at: str, least_ms: int) -> DataFrame:
    """Requests with `too_soon`: less than `least_ms` after the scope's one before."""
    before = F.lag(at).over(Window.partitionBy(*scope).orderBy(at))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return requests.withColumn("too_soon", F.coalesce(gap < least_ms * 1000, F.lit(False)))


#: A batch of no more items than this is sent to every task.
SMALL_BATCH = 10_000


def select_batch(items: DataFrame, order: str, host: str, identity: str, cap: int) -> DataFrame:
    """The batch: items in order, each unless its host or identity is that of one selected before it, `cap` at most.

    In rounds: what is first of both its host and its identity among the items left is selected, and items of a selected
    host or identity go. Each round settles one more of the batch at least, and nothing after its `cap`-th item is kept.
    """
    key = F.struct(F.col(order).alias("at"), F.col("__row").alias("row"))
    left = checkpointed(items.withColumn("__row", F.monotonically_increasing_id()))
    taken = left.limit(0)
    while left.limit(1).count():
        by_host = left.groupBy(host).agg(F.min(key).alias("k")).select("k.row")
        by_identity = left.groupBy(identity).agg(F.min(key).alias("k")).select("k.row")
        first = by_host.join(by_identity, "row").withColumnRenamed("row", "__row")
        taken = checkpointed(taken.unionByName(left.join(first, "__row", "left_semi")).orderBy(order, "__row").limit(cap))
        last = taken.agg(F.count("*").alias("__n"), F.max(key).alias("__last"))
        sent = F.broadcast if cap <= SMALL_BATCH else lambda d: d  # a batch has `cap` rows at most
        t, i = sent(taken.select(F.col(host).alias("__h"))), sent(taken.select(F.col(identity).alias("__i")))
        rest = left.join(t, F.col(host).eqNullSafe(F.col("__h")), "left_anti").join(i, F.col(identity).eqNullSafe(F.col("__i")), "left_anti")
        rest = rest.join(F.broadcast(last), (F.col("__n") < cap) | (key < F.col("__last")), "left_semi")
        left = checkpointed(rest)
    return taken.orderBy(order).drop("__row")


def reconcile(declared: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Declared totals (key, declared) against a recount of the entries; the counter is raised to the larger."""
    counted = entries.groupBy(key).agg(F.count("*").alias("recounted"))
    out = declared.join(counted, key, "left").withColumn("recounted", F.coalesce("recounted", F.lit(0)))
    return out.withColumn("effective", F.greatest("declared", "recounted")).withColumn("agrees", F.col("declared") == F.col("recounted"))


def due(messages: DataFrame, state: str, states: Sequence[str], at: str, key: str, as_of: Column, most: int = 25) -> DataFrame:
    """The messages in one of the states whose time has come, the longest due first, `most` at a time."""
    return messages.filter(F.col(state).isin(*states) & (F.col(at) <= as_of)).orderBy(at, key).limit(most)


def expire(cache: DataFrame, payloads: Sequence[str], expires: str, as_of: Column) -> DataFrame:
    """Expired rows lose their payloads and keep the rest."""
    for c in payloads:
        cache = cache.withColumn(c, F.when(F.col(expires).isNull() | (F.col(expires) > as_of), F.col(c)))
    return cache


def backoff_hours(attempts: Column, base: int, server_hint: Column) -> Column:
    return F.greatest(F.lit(base) * F.pow(F.lit(2), attempts), F.coalesce(server_hint, F.lit(0))).cast("long")


def merge_fields(observations: DataFrame, key: str) -> DataFrame:
    """(key, field, value, observed_at) to the newest observation of each field; ties to the larger value."""
    return observations.groupBy(key, "field").agg(F.max_by("value", F.struct("observed_at", "value")).alias("value"), F.max("observed_at").alias("observed_at"))


def illegal_edits(before: DataFrame, after: DataFrame, key: str, frozen: Sequence[str]) -> DataFrame:
    """(key, change) for rows of an immutable ledger that a later snapshot lost or altered."""
    a, b = before.alias("a"), after.alias("b")
    same = F.lit(True)
    for c in frozen:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    change = F.when(F.col(f"b.{key}").isNull(), "DELETED").when(~same, "EDITED")
    return joined.select(F.col(f"a.{key}").alias(key), change.alias("change")).filter("change is not null")


def charge(state: Column, cost: Column, reserved: Column, actual: Column) -> Column:
    """What a receipt counts for: its actual requests once completed at no cost, else the larger of reserved and actual."""
    return F.when((state == "COMPLETED") & (F.coalesce(cost, F.lit(0)) == 0) & actual.isNotNull(), actual).otherwise(F.greatest(reserved, F.coalesce(actual, F.lit(0))))


def at_most_once(requests: DataFrame, scope: str, key: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Requests with `decision` for reservations of one unit: a repeated key within its scope is REPLAYED, and of the others
    the first `cap` of a scope are RESERVED, the rest CAP_REACHED. Both are ranks, so a scope is sorted, not folded."""
    first = F.row_number().over(Window.partitionBy(scope, key).orderBy(*order)) == 1
    marked = requests.withColumn("__first", first)
    taken = F.sum(F.when(F.col("__first"), 1).otherwise(0)).over(Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    decision = F.when(~F.col("__first"), "REPLAYED").when(taken <= cap, "RESERVED").otherwise("CAP_REACHED")
    return marked.withColumn("decision", decision).drop("__first")


def scope_totals(reservations: DataFrame, receipts: DataFrame, scope: str, key: str, most_requests: int) -> DataFrame:
    """(scope, reserved, completed, requests, bytes, over_budget): what the reservations of a scope came to. A receipt without
    a reservation counts for nothing; over_budget counts receipts of more requests than `most_requests`."""
    joined = reservations.select(scope, key).dropDuplicates([scope, key]).join(receipts, [scope, key], "left")
    return joined.groupBy(scope).agg(
        F.count("*").alias("reserved"), F.count("requests").alias("completed"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("requests") > most_requests).alias("over_budget"),
    )


def accepted_balances(observations: DataFrame, scope: str, at: str, balance: str, ceiling: str, as_of: Column) -> DataFrame:
    """Observations with `reason`, null if accepted: not of the future, not older than one before it in arrival order
    (`seq`), within 0 and the ceiling."""
    newest = F.max(at).over(Window.partitionBy(scope).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    b = F.col(balance)
    reason = F.when(F.col(at).isNull() | b.isNull(), "INCOMPLETE").when(F.col(at) > as_of, "FUTURE").when(F.col(at) <= newest, "STALE").when((b < 0) | (b > F.col(ceiling)), "OUT_OF_RANGE")
    return observations.withColumn("reason", reason)


def alert_claims(attempts: DataFrame, keys: Sequence[str], at: str, done: str, lease_minutes: int = 5) -> DataFrame:
    """Attempts to send an alert with `claimed`: the first of its keys, and one whose last claim is past its lease; none
    after the alert is done (`done` is when, or null). Claims depend on claims before, so an alert's attempts, a handful,
    are folded in order of time."""
    whole = attempts.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("__at"), F.min(done).alias("__done"))
    fold = (
        f"aggregate(__at, struct(CAST(NULL AS TIMESTAMP_NTZ) AS held, CAST(array() AS ARRAY<STRUCT<at: TIMESTAMP_NTZ, claimed: BOOLEAN>>) AS o), (s, x) -> "
        f"if((s.held IS NULL OR x >= s.held + INTERVAL {lease_minutes} MINUTE) AND (__done IS NULL OR x < __done), struct(x AS held, array_append(s.o, struct(x AS at, true AS claimed)) AS o), "
        "struct(s.held AS held, array_append(s.o, struct(x AS at, false AS claimed)) AS o)), s -> s.o)"
    )
    return whole.select(*keys, F.expr(f"inline({fold})")).withColumnRenamed("at", at)


def stored_results(versions: DataFrame, key: str, order: str, retryable: Sequence[str]) -> DataFrame:
    """The result that a store ends with for each key when a version is only replaced while its state may be retried: the
    first terminal version, or the last of all where none is terminal."""
    terminal = ~F.col("state").isin(*retryable)
    ended = F.min(F.when(terminal, F.col(order))).over(Window.partitionBy(key))
    latest = F.max(order).over(Window.partitionBy(key))
    return versions.withColumn("__keep", F.coalesce(ended, latest)).filter(F.col(order) == F.col("__keep")).drop("__keep")


def closed_runs(runs: DataFrame, receipts: DataFrame, run: str) -> DataFrame:
    """Runs (run, declared_venues, declared_requests, lease_until, now) with their recounted totals and `state`: EXPIRED past
    the lease, MISMATCH where the declared totals are below the recount, else CLOSED."""
    counted = receipts.groupBy(run).agg(F.count("*").alias("venues"), F.sum("requests").alias("requests"))
    joined = runs.join(counted, run, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("venues", "requests")})
    state = F.when(F.col("lease_until") < F.col("now"), "EXPIRED").when((F.col("declared_venues") < F.col("venues")) | (F.col("declared_requests") < F.col("requests")), "MISMATCH").otherwise("CLOSED")
    return joined.withColumn("state", state)


def phase(completed: Column, inventory: Column) -> Column:
    """A programme is in its initial phase until it has completed its whole inventory once."""
    return F.when(F.coalesce(completed, F.lit(0)) < inventory, "INITIAL_INVENTORY").otherwise("ONGOING")


def policy_active(policy: Column, as_of: Column) -> Column:
    """Whether a policy document is enabled, has its keys, and is within its dates; a null end is open only if standing."""
    get = lambda path: F.get_json_object(policy, f"$.{path}")
    start, end = get("validFrom").try_cast("timestamp_ntz"), get("validUntil").try_cast("timestamp_ntz")
    keys = F.size(F.array_intersect(F.json_object_keys(policy), F.array(*map(F.lit, ("enabled", "validFrom", "countries"))))) == 3
    ends = F.when(get("validUntil").isNull(), F.coalesce(get("standing") == "true", F.lit(False))).otherwise(as_of < end)
    return F.coalesce(keys & (get("enabled") == "true") & (as_of >= start) & ends & (F.json_array_length(get("countries")) > 0), F.lit(False))


def search_reuse(requests: DataFrame, receipts: DataFrame, query: str, as_of: Column) -> DataFrame:
    """Requests (query, allowance) with what a receipt of the same query makes of them: CACHE_PROVIDER_MISMATCH, CACHED while a
    completed one has not expired, else IN_FLIGHT_OR_UNKNOWN, expired ones included; NEW without a receipt."""
    held = receipts.select(query, F.col("allowance").alias("held_by"), "state", "expires_at")
    decision = (
        F.when(F.col("held_by").isNull(), "NEW").when(F.col("held_by") != F.col("allowance"), "CACHE_PROVIDER_MISMATCH")
        .when((F.col("state") == "COMPLETED") & (F.col("expires_at") > as_of), "CACHED").otherwise("IN_FLIGHT_OR_UNKNOWN")
    )
    return requests.join(held, query, "left").withColumn("decision", decision)


def held_replay(requests: DataFrame, receipts: DataFrame, query: str, as_of: Column, most_hours: int = 720) -> DataFrame:
    """Requests (query, fingerprint) with the one receipt that may be replayed for them: exactly one of the query, of the same
    fingerprint, at most `most_hours` old."""
    counted = receipts.groupBy(query).agg(F.count("*").alias("n"), F.min(F.struct("receipt_id", "fingerprint", "observed_at")).alias("r"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("r.observed_at").cast("timestamp"))) / 3.6e9
    found = requests.withColumnRenamed("fingerprint", "asked").join(counted, query, "left")
    state = (
        F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("r.fingerprint") != F.col("asked"), "FINGERPRINT")
        .when((age > most_hours) | (age < 0), "AGE").otherwise("REPLAYED")
    )
    return found.withColumn("state", state).withColumn("receipt_id", F.when(F.col("state") == "REPLAYED", F.col("r.receipt_id"))).drop("n", "r", "asked")


def admit_searches(requests: DataFrame, scope: str, at: str, key: str, guard: str, daily: int, spacing_ms: int) -> DataFrame:
    """Requests with `decision`: what their `guard` says unless it is OPEN, then PROVIDER_DAILY_BUDGET once `daily` of a UTC day are
    reserved, PROVIDER_RATE_LIMIT less than the spacing after the last reserved one, else RESERVED. Only reserved requests
    count, so a scope is folded in order of time, in one partition, streamed."""
    marked = requests.withColumn("__scope", F.col(scope)).withColumn("__us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__guard", F.col(guard))
    dealt = marked.repartition("__scope").sortWithinPartitions("__scope", "__us", key)
    kept = [f for f in requests.schema.fields if f.name != "decision"]
    day_us = 86_400_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, day, used, last = None, None, 0, None
        for batch in batches:
            decisions = []
            for s, us, state in zip(*(batch.column(c).to_pylist() for c in ("__scope", "__us", "__guard")), strict=True):
                if s != now:
                    now, day, used, last = s, None, 0, None
                if us // day_us != day:
                    day, used = us // day_us, 0
                if state != "OPEN":
                    decisions.append(state)
                elif used >= daily:
                    decisions.append("PROVIDER_DAILY_BUDGET")
                elif last is not None and us < last + spacing_ms * 1000:
                    decisions.append("PROVIDER_RATE_LIMIT")
                else:
                    decisions.append("RESERVED")
                    used, last = used + 1, us
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(decisions, pa.string())], names=[*(f.name for f in kept), "decision"])

    return dealt.mapInArrow(fold, StructType([*kept]).add("decision", StringType()))


def completed_work(receipts: DataFrame, policy: str, at: str, key: str, most_failures: int) -> DataFrame:
    """Receipts with `outcome`, the policy's failure `streak` after them, and whether it is still `enabled`.

    More requests than reserved, or any cost, quarantine a receipt and disable the policy for good, as does a streak of
    `most_failures`; a receipt within its reservation ends the streak. Streaks are runs between good receipts.
    """
    good = F.coalesce((F.col("actual") <= F.col("reserved")) & (F.col("cost") == 0), F.lit(False))
    outcome = F.when(F.coalesce(F.col("actual") > F.col("reserved"), F.lit(False)) | (F.col("cost") > 0), "QUARANTINED").otherwise(F.col("state"))
    order = Window.partitionBy(policy).orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    marked = receipts.withColumn("__good", good).withColumn("outcome", outcome).withColumn("__run", F.sum(F.when(good, 1).otherwise(0)).over(order))
    in_run = Window.partitionBy(policy, "__run").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.when(F.col("__good"), 0).otherwise(F.sum(F.when(F.col("__good"), 0).otherwise(1)).over(in_run))
    out = marked.withColumn("streak", streak.cast("long"))
    return out.withColumn("enabled", F.bool_and((F.col("outcome") != "QUARANTINED") & (F.col("streak") < most_failures)).over(order)).drop("__good", "__run")
