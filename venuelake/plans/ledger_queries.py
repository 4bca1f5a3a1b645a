"""Registered queries of the ledgers: spend, reservations, runs and held results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuelake.operators import budgets, ledgers
from venuelake.plans.catalog import AS_OF, as_of, register
from venuelake.sources.tables import table

#: Allowances made of users: amounts in cents, snapshots taken on different days of the month.
ALLOWANCES = """SELECT DISTINCT user_id AS allowance_id, user_id % 2 = 0 AS monthly, CAST(100000 + user_id % 7 * 40000 AS BIGINT) AS allocated, CAST(20000 + user_id % 11 * 9000 AS BIGINT) AS reserved,
  CAST(user_id % 50 AS BIGINT) AS requests, CAST(1000 AS BIGINT) AS max_requests, CAST(150 + user_id % 3 * 100 AS BIGINT) AS price, user_id % 13 <> 0 AS enabled, TIMESTAMP '2024-01-05 00:00:00' + to_days(CAST(user_id % 17 AS INT)) AS verified_at,
  TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(6 + user_id % 40 AS INT)) AS expires_at, CASE WHEN user_id % 17 <> 0 THEN CAST(60000 + user_id % 8 * 25000 AS BIGINT) END AS available, CAST(user_id % 5 * 10000 AS BIGINT) AS month_consumed,
  CASE WHEN user_id % 3 = 0 THEN '2023-12' ELSE '2024-01' END AS month, CAST(user_id % 4 * 5000 AS BIGINT) AS ledger_month, CAST(user_id % 6 * 8000 AS BIGINT) AS ledger_reserved, CAST(user_id % 3 * 15000 AS BIGINT) AS grant_left,
  CASE WHEN user_id % 4 > 0 THEN TIMESTAMP '2024-01-12 00:00:00' + to_days(CAST(user_id % 15 AS INT)) END AS grant_expires, CASE WHEN user_id % 5 > 0 THEN CAST(250000 AS BIGINT) END AS basis, CAST(180000 AS BIGINT) AS ceiling, CAST(4000 AS BIGINT) AS reserve FROM events"""


def _allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    long = lambda c: c.cast("long")
    day = lambda text, days: F.lit(text).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        u.alias("allowance_id"), (u % 2 == 0).alias("monthly"), long(100000 + u % 7 * 40000).alias("allocated"), long(20000 + u % 11 * 9000).alias("reserved"), long(u % 50).alias("requests"), F.lit(1000).cast("long").alias("max_requests"),
        long(150 + u % 3 * 100).alias("price"), (u % 13 != 0).alias("enabled"), day("2024-01-05 00:00:00", u % 17).alias("verified_at"), day("2024-01-10 00:00:00", 6 + u % 40).alias("expires_at"),
        F.when(u % 17 != 0, long(60000 + u % 8 * 25000)).alias("available"), long(u % 5 * 10000).alias("month_consumed"), F.when(u % 3 == 0, "2023-12").otherwise("2024-01").alias("month"), long(u % 4 * 5000).alias("ledger_month"),
        long(u % 6 * 8000).alias("ledger_reserved"), long(u % 3 * 15000).alias("grant_left"), F.when(u % 4 > 0, day("2024-01-12 00:00:00", u % 15)).alias("grant_expires"), F.when(u % 5 > 0, F.lit(250000).cast("long")).alias("basis"),
        F.lit(180000).cast("long").alias("ceiling"), F.lit(4000).cast("long").alias("reserve"),
    )


@register(
    "budget_state",
    f"""WITH a AS ({ALLOWANCES}), t AS (SELECT TIMESTAMP '{AS_OF}' AS now),
      r AS (SELECT e.user_id AS allowance_id, CAST(round(e.value * 100) AS BIGINT) AS amount, e.ts FROM events e),
      s AS (SELECT a.allowance_id, CAST(sum(amount) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND now) AS BIGINT) AS m, CAST(sum(amount) FILTER (WHERE ts BETWEEN now - INTERVAL 24 HOUR AND now) AS BIGINT) AS d,
        CAST(sum(amount) FILTER (WHERE ts > verified_at AND ts < grant_expires AND ts <= now) AS BIGINT) AS p FROM a JOIN r USING (allowance_id), t GROUP BY 1),
      b AS (SELECT a.*, coalesce(m, 0) AS month_ledger, coalesce(d, 0) AS burn, coalesce(p, 0) AS pre, greatest(0, reserved - ledger_reserved) AS debt FROM a LEFT JOIN s USING (allowance_id)),
      c AS (SELECT *, CASE WHEN month = '2024-01' THEN greatest(month_ledger, month_consumed + greatest(0, month_ledger - ledger_month)) ELSE month_ledger END AS month_used,
        CASE WHEN grant_expires <= TIMESTAMP '{AS_OF}' THEN greatest(0, grant_left - least(debt, pre)) ELSE 0 END AS expired_grant, least(allocated, 180000, 1000 * price) AS denominator FROM b),
      e AS (SELECT *, greatest(0, coalesce(available, 0) - debt - expired_grant) AS projected, CASE WHEN monthly THEN greatest(0, denominator - month_used) ELSE least(greatest(0, denominator - reserved), (1000 - requests) * price) END AS allowance_left FROM c),
      f AS (SELECT *, CASE WHEN monthly THEN least(allowance_left, greatest(0, projected - 4000)) ELSE least(allowance_left, projected) END AS usable FROM e),
      g AS (SELECT *, CASE WHEN available IS NULL THEN 'PROVIDER_BALANCE_UNVERIFIED' WHEN NOT enabled OR verified_at > TIMESTAMP '{AS_OF}' OR expires_at <= TIMESTAMP '{AS_OF}' THEN 'ALLOWANCE_INACTIVE'
        WHEN monthly AND projected < 4000 + price THEN 'PROVIDER_ACCOUNT_RESERVE' WHEN usable < price THEN 'ALLOCATION_EXHAUSTED' END AS reason FROM f),
      h AS (SELECT *, CASE WHEN reason IS NULL THEN usable ELSE 0 END AS remaining, coalesce(basis, coalesce(available, 0) + month_consumed) AS whole FROM g),
      i AS (SELECT *, least(CASE WHEN whole > 0 THEN least(1.0, projected / whole) ELSE 0 END, CASE WHEN denominator > 0 THEN least(1.0, allowance_left / denominator) ELSE 0 END) AS fraction FROM h)
      SELECT allowance_id, month_used, burn, debt, expired_grant, projected, allowance_left, remaining, reason,
        CASE WHEN remaining < price THEN 'blocked' WHEN fraction <= 0.10 THEN '10_percent' WHEN fraction <= 0.25 THEN '25_percent' ELSE 'healthy' END AS stage, remaining // price AS remaining_requests FROM i""",
)
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "events").select(F.col("user_id").alias("allowance_id"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.col("ts").alias("at"))
    return ledgers.budget_state(receipts, _allowances(spark, sf_dir), as_of())


@register(
    "work_admission",
    """WITH RECURSIVE o AS (SELECT o_orderkey, o_orderdate, 1 + o_orderkey % 4 AS asked, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS n FROM orders),
      f AS (SELECT o_orderkey, o_orderdate, n, CASE WHEN asked > 12 THEN 'DAILY_REQUEST_CAP' ELSE 'ADMITTED' END AS decision, CASE WHEN asked > 12 THEN 0 ELSE 1 END AS venues, CASE WHEN asked > 12 THEN 0 ELSE asked END AS requests FROM o WHERE n = 1
        UNION ALL SELECT o.o_orderkey, o.o_orderdate, o.n, CASE WHEN f.venues + 1 > 5 THEN 'DAILY_VENUE_CAP' WHEN f.requests + asked > 12 THEN 'DAILY_REQUEST_CAP' ELSE 'ADMITTED' END,
          CASE WHEN f.venues + 1 > 5 OR f.requests + asked > 12 THEN f.venues ELSE f.venues + 1 END, CASE WHEN f.venues + 1 > 5 OR f.requests + asked > 12 THEN f.requests ELSE f.requests + asked END
        FROM f JOIN o ON o.o_orderdate = f.o_orderdate AND o.n = f.n + 1)
      SELECT o_orderkey, decision FROM f""",
)
def work_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = [("DAILY_VENUE_CAP", F.lit(1), 5), ("DAILY_REQUEST_CAP", 1 + F.col("o_orderkey") % 4, 12)]
    return ledgers.admit(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"], [F.asc("o_orderkey")], caps).select("o_orderkey", "decision")


#: The events table spread over four months: what each event asks of the budget of one of five tiers.
_BUDGET_EVENTS = """SELECT event_id, user_id % 5 AS tier, TIMESTAMP '2024-01-01' + 4 * (ts - TIMESTAMP '2024-01-01') AS ts, CAST(date_part('month', TIMESTAMP '2024-01-01' + 4 * (ts - TIMESTAMP '2024-01-01')) AS INT) AS m,
  CASE event_type WHEN 'view' THEN 'RESERVE' WHEN 'click' THEN 'RECONCILE' WHEN 'signup' THEN 'ENQUEUE' WHEN 'purchase' THEN 'CLAIM' ELSE CASE WHEN event_id % 7 = 0 THEN 'SET_LIMIT' ELSE 'RESERVE' END END AS kind, event_id % 13 > 0 AS enabled FROM events"""


@register(
    "monthly_tier_budget",
    f"""WITH RECURSIVE b AS ({_BUDGET_EVENTS}), e AS (SELECT *, CASE kind WHEN 'SET_LIMIT' THEN event_id % 100 WHEN 'RESERVE' THEN event_id % 5 - 1 WHEN 'RECONCILE' THEN event_id % 6 - 1 END AS amount, max(CASE WHEN kind = 'RESERVE' THEN ts END) OVER w AS last_at, row_number() OVER (PARTITION BY tier ORDER BY ts, event_id) AS n FROM b WINDOW w AS (PARTITION BY tier ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT tier, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, 1 AS of, CAST(40 AS BIGINT) AS def, list_transform(range(5), lambda x: CAST(NULL AS BIGINT)) AS lim, list_transform(range(5), lambda x: true) AS ena, list_transform(range(5), lambda x: CAST(0 AS BIGINT)) AS con, list_transform(range(5), lambda x: CAST(0 AS BIGINT)) AS res, CAST([] AS BIGINT[]) AS jobs, 0 AS rm, CAST(0 AS BIGINT) AS rc, 'NONE' AS rs, CAST(NULL AS BIGINT) AS job FROM (SELECT DISTINCT tier FROM e)
        UNION ALL SELECT tier, n, event_id, outcome, of, CASE WHEN outcome IN ('LIMIT_SET', 'KILLED') THEN amount ELSE def END, CASE WHEN outcome IN ('LIMIT_SET', 'KILLED') THEN list_transform(lim, lambda x, i: CASE WHEN i = m THEN amount ELSE x END) ELSE lim END, CASE WHEN outcome IN ('LIMIT_SET', 'KILLED') THEN list_transform(ena, lambda x, i: CASE WHEN i = m THEN enabled ELSE x END) ELSE ena END,
          CASE WHEN outcome IN ('CONSUMED', 'RELEASED') THEN list_transform(con, lambda x, i: CASE WHEN i = rm THEN x + amount ELSE x END) ELSE con END,
          CASE WHEN outcome IN ('CONSUMED', 'RELEASED') THEN list_transform(res, lambda x, i: CASE WHEN i = rm THEN x - rc ELSE x END) WHEN outcome IN ('RESERVED', 'CLAIMED') THEN list_transform(res, lambda x, i: CASE WHEN i = m THEN x + CASE WHEN outcome = 'CLAIMED' THEN 1 ELSE amount END ELSE x END) ELSE res END,
          CASE outcome WHEN 'QUEUED' THEN list_append(jobs, event_id) WHEN 'CLAIMED' THEN jobs[2:] ELSE jobs END, CASE WHEN kind = 'RESERVE' THEN m ELSE rm END, CASE WHEN kind = 'RESERVE' THEN amount ELSE rc END,
          CASE WHEN kind = 'RESERVE' THEN CASE WHEN outcome = 'RESERVED' THEN 'OPEN' ELSE 'NONE' END WHEN outcome IN ('CONSUMED', 'RELEASED') THEN 'DONE' ELSE rs END, CASE WHEN outcome = 'CLAIMED' THEN jobs[1] END
        FROM (SELECT *, CASE kind WHEN 'SET_LIMIT' THEN CASE WHEN enabled THEN 'LIMIT_SET' ELSE 'KILLED' END WHEN 'ENQUEUE' THEN 'QUEUED'
            WHEN 'RECONCILE' THEN CASE WHEN rs = 'NONE' THEN 'RESERVATION_NOT_FOUND' WHEN rs = 'DONE' THEN 'ALREADY_RECONCILED' WHEN amount < 0 THEN 'NEGATIVE_ACTUAL' WHEN amount > rc THEN 'ACTUAL_EXCEEDS_RESERVED' WHEN con[rm] + amount > lim[rm] THEN 'EXCEEDS_MONTHLY_LIMIT' WHEN amount > 0 THEN 'CONSUMED' ELSE 'RELEASED' END
            ELSE CASE WHEN kind = 'RESERVE' AND amount <= 0 THEN 'INVALID_COUNT' WHEN NOT ena[m] THEN 'BUDGET_DISABLED' WHEN greatest(0, lim[m] - con[m] - res[m]) < CASE WHEN kind = 'CLAIM' THEN 1 ELSE amount END THEN CASE WHEN lim[m] = 0 THEN 'ZERO_BUDGET_LIMIT' ELSE 'MONTHLY_LIMIT_EXCEEDED' END
              WHEN kind = 'CLAIM' AND len(jobs) = 0 THEN 'NO_ELIGIBLE_JOBS' WHEN kind = 'CLAIM' THEN 'CLAIMED' ELSE 'RESERVED' END END AS outcome, CASE WHEN kind = 'RECONCILE' AND rs <> 'NONE' THEN rm ELSE m END AS of
          FROM (SELECT e.tier, e.n, e.event_id, e.kind, e.m, e.enabled, e.amount, z.def, list_transform(z.lim, lambda x, i: CASE WHEN i = e.m THEN coalesce(x, z.def) ELSE x END) AS lim, z.ena, z.con, z.res, z.jobs, z.rm, z.rc, z.rs FROM z JOIN e ON e.tier = z.tier AND e.n = z.n + 1)))
      SELECT event_id, outcome, CAST(of AS INT) AS month, lim[of] AS monthly_limit, con[of] AS consumed, res[of] AS reserved, greatest(0, lim[of] - con[of] - res[of]) AS remaining, job FROM z WHERE n > 0""",
)
def monthly_tier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, e = F.lit("2024-01-01").cast("timestamp_ntz"), F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "RESERVE").when(F.col("event_type") == "click", "RECONCILE").when(F.col("event_type") == "signup", "ENQUEUE").when(F.col("event_type") == "purchase", "CLAIM").when(e % 7 == 0, "SET_LIMIT").otherwise("RESERVE")
    rows = table(spark, sf_dir, "events").select(e, (F.col("user_id") % 5).cast("string").alias("tier"), (begin + (F.col("ts") - begin) * 4).alias("ts"), kind.alias("kind"), (e % 13 > 0).alias("enabled"))
    amount = F.when(F.col("kind") == "SET_LIMIT", e % 100).when(F.col("kind") == "RESERVE", e % 5 - 1).when(F.col("kind") == "RECONCILE", e % 6 - 1)
    before = Window.partitionBy("tier").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = rows.withColumn("amount", amount).withColumn("target", F.last(F.when(F.col("kind") == "RESERVE", e), ignorenulls=True).over(before)).withColumn("provider", F.lit("Places"))
    found = budgets.ledger(asked, "provider", "tier", "ts", "event_id", default_limit=40)
    return found.select("event_id", "outcome", F.month("month").alias("month"), F.col("limit").alias("monthly_limit"), "consumed", "reserved", "remaining", "job")


@register(
    "daily_charges",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 AND k IS NOT NULL THEN k ELSE greatest(5, coalesce(k, 0)) END) AS BIGINT) AS charged FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN event_id % 8 END AS k FROM events) GROUP BY 1""",
)
def daily_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("actual", F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 8))
    state = F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("RESERVED")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum(ledgers.charge(state, F.col("user_id") % 3, F.lit(5), F.col("actual"))).alias("charged"))


@register(
    "seed_reservations",
    """WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS f, ts FROM events)
      SELECT event_id, CASE WHEN NOT f THEN 'REPLAYED' WHEN count(*) FILTER (WHERE f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 3 THEN 'RESERVED' ELSE 'CAP_REACHED' END AS decision FROM a""",
)
def seed_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.at_most_once(table(spark, sf_dir, "events"), "user_id", "event_type", [F.asc("ts"), F.asc("event_id")], 3).select("event_id", "decision")


@register(
    "batch_scopes",
    """WITH r AS (SELECT DISTINCT l_orderkey AS scope, l_linenumber AS listing FROM lineitem), c AS (SELECT DISTINCT o.o_orderkey AS scope, x.n AS listing, CAST(1 + (o.o_orderkey + x.n) % 9 AS BIGINT) AS requests, CAST(floor(o.o_totalprice) AS BIGINT) AS bytes FROM orders o, (SELECT unnest([1, 2, 3]) AS n) x)
      SELECT scope, count(*) AS reserved, count(requests) AS completed, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE requests > 7) AS over_budget FROM r LEFT JOIN c USING (scope, listing) GROUP BY 1""",
)
def batch_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reserved = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("listing"))
    done = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("listing"), F.floor("o_totalprice").alias("bytes"))
    return ledgers.scope_totals(reserved, done.withColumn("requests", (1 + (F.col("scope") + F.col("listing")) % 9).cast("long")), "scope", "listing", 7)


@register(
    "balance_observations",
    f"""SELECT event_id, CASE WHEN seen IS NULL OR b IS NULL THEN 'INCOMPLETE' WHEN seen > TIMESTAMP '{AS_OF}' THEN 'FUTURE' WHEN seen <= max(seen) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'STALE'
      WHEN b < 0 OR b > 150 THEN 'OUT_OF_RANGE' END AS reason FROM (SELECT event_id, user_id, CASE WHEN event_id % 19 > 0 THEN ts - INTERVAL 1 DAY * (event_id % 3) END AS seen, CASE WHEN event_id % 23 > 0 THEN value - 20 END AS b FROM events)""",
)
def balance_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e, "user_id", e.alias("seq"), F.when(e % 19 > 0, F.col("ts") - F.make_dt_interval((e % 3).cast("int"))).alias("at"), F.when(e % 23 > 0, F.col("value") - 20).alias("balance"), F.lit(150).alias("ceiling")
    )
    return ledgers.accepted_balances(rows, "user_id", "at", "balance", "ceiling", as_of()).select("event_id", "reason")


@register(
    "alert_claims",
    """WITH RECURSIVE d AS (SELECT user_id, event_type, min(ts) FILTER (WHERE value > 190) AS done FROM events GROUP BY 1, 2), a AS (SELECT e.user_id, e.event_type, e.ts, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts) AS n, done FROM events e JOIN d USING (user_id, event_type)),
      f AS (SELECT user_id, event_type, ts, n, (done IS NULL OR ts < done) AS claimed, CASE WHEN done IS NULL OR ts < done THEN ts END AS held FROM a WHERE n = 1
        UNION ALL SELECT a.user_id, a.event_type, a.ts, a.n, (f.held IS NULL OR a.ts >= f.held + INTERVAL 2880 MINUTE) AND (a.done IS NULL OR a.ts < a.done), CASE WHEN (f.held IS NULL OR a.ts >= f.held + INTERVAL 2880 MINUTE) AND (a.done IS NULL OR a.ts < a.done) THEN a.ts ELSE f.held END
        FROM f JOIN a ON a.user_id = f.user_id AND a.event_type = f.event_type AND a.n = f.n + 1)
      SELECT user_id, event_type, ts, claimed FROM f""",
)
def alert_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.when(F.col("value") > 190, F.col("ts")).alias("done"))
    return ledgers.alert_claims(attempts, ["user_id", "event_type"], "ts", "done", lease_minutes=2880)


@register(
    "result_store",
    """WITH v AS (SELECT user_id, event_id, event_type, min(event_id) FILTER (WHERE event_type IN ('purchase', 'signup')) OVER (PARTITION BY user_id) AS ended, max(event_id) OVER (PARTITION BY user_id) AS latest FROM events)
      SELECT user_id, event_id, event_type AS state FROM v WHERE event_id = coalesce(ended, latest)""",
)
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return ledgers.stored_results(rows, "user_id", "event_id", ["error", "click", "view"])


@register(
    "run_closing",
    f"""SELECT o_orderkey, coalesce(v, 0) AS venues, coalesce(q, 0) AS requests, CASE WHEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 2000) < TIMESTAMP '1998-01-01' THEN 'EXPIRED' WHEN 3 < coalesce(v, 0) OR 90 < coalesce(q, 0) THEN 'MISMATCH' ELSE 'CLOSED' END AS state
      FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS v, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1) USING (o_orderkey)""",
)
def run_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lease = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 2000).cast("int"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(3).alias("declared_venues"), F.lit(90).alias("declared_requests"), lease.alias("lease_until"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("now"))
    receipts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("requests"))
    return ledgers.closed_runs(runs, receipts, "o_orderkey").select("o_orderkey", "venues", "requests", "state")


@register(
    "programme_phase",
    """SELECT c_custkey, CASE WHEN coalesce(n, 0) < 4 THEN 'INITIAL_INVENTORY' ELSE 'ONGOING' END AS phase FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (c_custkey)""",
)
def programme_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left").select("c_custkey", ledgers.phase(F.col("n"), F.lit(4)).alias("phase"))


@register(
    "active_policies",
    f"""SELECT c_custkey, c_custkey % 7 > 0 AND c_custkey % 11 > 0 AND c_nationkey > 2 AND TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 30) <= TIMESTAMP '{AS_OF}'
      AND CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * (c_custkey % 30) > TIMESTAMP '{AS_OF}' ELSE c_custkey % 2 = 0 END AS active FROM customer""",
)
def active_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    day = lambda text: F.date_format(F.lit(text).cast("timestamp_ntz") + F.make_dt_interval((key % 30).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    policy = F.to_json(F.struct(
        (key % 7 > 0).alias("enabled"), F.when(key % 11 > 0, day("2024-01-01 00:00:00")).alias("validFrom"), F.when(key % 5 > 0, day("2024-01-10 00:00:00")).alias("validUntil"),
        (key % 2 == 0).alias("standing"), F.when(F.col("c_nationkey") > 2, F.array(F.lit("ZA"))).otherwise(F.array().cast("array<string>")).alias("countries"),
    ))
    return table(spark, sf_dir, "customer").select(key, ledgers.policy_active(policy, as_of()).alias("active"))


SEARCHES = f"""r AS (SELECT user_id AS query, arg_min(event_type, event_id) AS allowance, arg_min(CASE WHEN value > 30 THEN 'COMPLETED' ELSE 'RESERVED' END, event_id) AS state, min(ts) + INTERVAL 10 DAY AS expires_at FROM events GROUP BY 1)"""


@register(
    "search_reuse",
    f"""WITH {SEARCHES} SELECT event_id, CASE WHEN r.query IS NULL THEN 'NEW' WHEN r.allowance <> e.event_type THEN 'CACHE_PROVIDER_MISMATCH' WHEN state = 'COMPLETED' AND expires_at > TIMESTAMP '2024-01-11' THEN 'CACHED' ELSE 'IN_FLIGHT_OR_UNKNOWN' END AS decision
      FROM (SELECT *, user_id + event_id % 2 * 40 AS query FROM events) e LEFT JOIN r USING (query)""",
)
def search_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    receipts = e.groupBy(F.col("user_id").alias("query")).agg(
        F.min_by("event_type", "event_id").alias("allowance"), F.min_by(F.when(F.col("value") > 30, "COMPLETED").otherwise("RESERVED"), "event_id").alias("state"), (F.min("ts") + F.expr("interval 10 days")).alias("expires_at")
    )
    asked = e.select("event_id", (F.col("user_id") + F.col("event_id") % 2 * 40).alias("query"), F.col("event_type").alias("allowance"))
    return ledgers.search_reuse(asked, receipts, "query", F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")).select("event_id", "decision")


@register(
    "held_search_replay",
    """WITH r AS (SELECT o_custkey * 7 + o_orderkey % 7 AS query, count(*) AS n, min(o_orderkey) AS receipt_id, arg_min(o_orderstatus, o_orderkey) AS f, arg_min(o_orderdate, o_orderkey) AS seen FROM orders GROUP BY 1),
      s AS (SELECT q.query, receipt_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' WHEN f <> 'F' THEN 'FINGERPRINT' WHEN epoch(TIMESTAMP '1998-01-01') - epoch(seen) > 26280 * 3600 OR seen > TIMESTAMP '1998-01-01' THEN 'AGE' ELSE 'REPLAYED' END AS state FROM (SELECT c_custkey * 7 + unnest(range(7)) AS query FROM customer) q LEFT JOIN r USING (query))
      SELECT query, state, CASE WHEN state = 'REPLAYED' THEN receipt_id END AS receipt_id FROM s""",
)
def held_search_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7 + F.col("o_orderkey") % 7).alias("query"), F.col("o_orderkey").alias("receipt_id"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderdate").alias("observed_at"))
    asked = table(spark, sf_dir, "customer").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.col("c_custkey") * 7 + i)).alias("query"), F.lit("F").alias("fingerprint"))
    return ledgers.held_replay(asked, receipts, "query", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 26280)
