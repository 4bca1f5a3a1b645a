"""Registered queries of sites' identity, of commerce tables, and of search and work admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.operators import commerce, identity, ledgers
from venuelake.plans.catalog import pick, register, sql_pick
from venuelake.sources.tables import table

LOCALITIES = ("Leeds", "Cape Town / Kaapstad", "Karoo region", None, "York or Jorvik")
PLACES = ("1 High St (rear), Leeds LS1 4AB", "Long Street, Cape Town, 8001", None, "12, Mill Lane", "")
_TERMS = ("1 high st rear,leeds", "cape town,cape town kaapstad,kaapstad,long street", "karoo,karoo region", "mill lane", "jorvik,york,york or jorvik")
_TERMS = ("1 high st,leeds", *_TERMS[1:])


@register("location_terms", f"SELECT event_id, {sql_pick(_TERMS, 'event_id')} AS terms FROM events")
def location_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, F.array_join(identity.location_terms(pick(LOCALITIES, e), pick(PLACES, e)), ",").alias("terms"))


PAIRS = (
    ("The Lakeside Barn", "Lakeside Barn - The", "", True), ("Lakeside Barn", "lakesidebarn weddings", "", True), ("Leeds Lakeside Hall", "Lakeside Theatre", "leeds", True), ("Leeds Lakeside Hall", "Lakeside Theatre", "", False),
    ("Grand Hall", "Grand", "", False), ("Hall", "Town Hall", "", True), ("Lakeside Hall", "Riverside Hall", "", False), ("", "Anything", "", False),
)


@register("name_matches", f"SELECT event_id, CAST({sql_pick([str(p[3]).lower() for p in PAIRS], 'event_id')} AS BOOLEAN) AS same FROM events")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    near = F.array_remove(F.array(pick([p[2] for p in PAIRS], e)), "")
    return table(spark, sf_dir, "events").select(e, identity.name_matches(pick([p[0] for p in PAIRS], e), pick([p[1] for p in PAIRS], e), near).alias("same"))


SITES = (("The Lakeside Barn", "www.lakesidebarn.co.uk", "NAME_IN_DOMAIN"), ("Old Mill and Farm Shop", "oldmi.org", "DOMAIN_IN_NAME"), ("National Portrait Rooms", "npr.org", "ACRONYM"), ("Grand Hall", "listing.com", None), ("Riverside Inn", "riverside.wixsite.com", "NAME_IN_DOMAIN"))


@register(
    "website_states",
    f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN coalesce({sql_pick([s[2] for s in SITES], "event_id")}, 'HOMEPAGE') ELSE {sql_pick([s[2] for s in SITES], "event_id")} END AS signal, event_id % 29 = 0 AS bad, event_id % 23 = 0 AS post, event_id % 4 > 0 AS ver, event_id % 8 > 3 AS nam, event_id % 19 > 0 AS sco, event_id % 13 = 0 AS gen FROM events)
      SELECT event_id, signal, CASE WHEN bad OR post THEN 'REJECTED' WHEN NOT ver THEN CASE WHEN nam THEN 'UNVERIFIED' ELSE 'REJECTED' END WHEN NOT sco OR gen OR signal IS NULL THEN 'UNVERIFIED' ELSE 'SELECTED' END AS state,
        CASE WHEN bad THEN 'REDIRECTED_TO_NON_FIRST_PARTY_HOST' WHEN post THEN 'ADDRESS_POSTCODE_CONFLICT' WHEN NOT ver AND nam THEN 'NAME_ALIGNED_WITHOUT_LOCATION_OR_IDENTITY_PROOF' WHEN NOT ver THEN 'NO_SAME_ENTITY_IDENTITY_EVIDENCE' WHEN NOT sco THEN 'OUTSIDE_ACCEPTED_SITE_SCOPE'
          WHEN gen THEN 'GENERIC_NAME_REQUIRES_ADDRESS_CORROBORATION' WHEN signal IS NULL THEN 'THIRD_PARTY_PAGE_NOT_VENUE_OPERATED' ELSE 'VERIFIED_DIRECT' END AS reason FROM s""",
)
def website_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, identity.operated(pick([s[0] for s in SITES], e), pick([s[1] for s in SITES], e), e % 7 == 3).alias("signal"))
    state = identity.website_state(e % 29 == 0, e % 23 == 0, e % 4 > 0, e % 8 > 3, e % 19 > 0, e % 13 == 0, F.col("signal"))
    return rows.select(e, "signal", state.alias("s")).select(e, "signal", "s.*")


@register(
    "site_candidates",
    """WITH f AS (SELECT l_orderkey AS search, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS rank, 'o' || l_partkey % 4 AS origin, l_partkey % 4 = 0 AS dom, l_suppkey % 2 = 0 AS tit, l_quantity < 10 AS ev, l_quantity > 20 AS home FROM lineitem),
      s AS (SELECT *, 2 * CAST(dom AS INT) + CAST(tit AS INT) - 2 * CAST(ev AS INT) AS score, bool_or(dom) OVER (PARTITION BY search) AS any_dom FROM f WHERE (dom OR tit) AND (dom OR NOT ev)),
      g AS (SELECT search, origin, arg_min(score, rank) AS score, min(rank) AS rank FROM (SELECT * FROM s WHERE CASE WHEN any_dom THEN dom ELSE home END) GROUP BY 1, 2)
      SELECT search, origin, score, position FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY rank, origin) AS position FROM g) WHERE position <= 5""",
)
def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("search"), (F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("rank"), F.concat(F.lit("o"), (F.col("l_partkey") % 4).cast("string")).alias("origin"), (F.col("l_partkey") % 4 == 0).alias("domain_aligned"),
        (F.col("l_suppkey") % 2 == 0).alias("title_aligned"), (F.col("l_quantity") < 10).alias("event_path"), (F.col("l_quantity") > 20).alias("homepage"),
    )
    return identity.ranked_sites(found, "search")


@register(
    "provider_fallback",
    """WITH f AS (SELECT o_custkey AS search, CASE WHEN o_custkey % 4 > 0 THEN 'f' || o_orderkey END AS url, CASE WHEN o_custkey % 8 = 0 THEN 'ALLOCATION_EXHAUSTED' WHEN o_custkey % 12 = 4 THEN 'POLICY' END AS denied FROM orders), g AS (SELECT search, count(url) AS n, max(denied) AS d FROM f GROUP BY 1),
      u AS (SELECT search FROM g WHERE n = 0 AND d IS NULL OR d = 'ALLOCATION_EXHAUSTED')
      SELECT search, url, 'first' AS provider FROM f WHERE url IS NOT NULL AND search NOT IN (SELECT search FROM u) UNION ALL SELECT o_custkey, 's' || o_orderkey, 'second' FROM orders WHERE o_custkey IN (SELECT search FROM u)""",
)
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders")
    first = rows.select(c.alias("search"), F.when(c % 4 > 0, F.concat(F.lit("f"), o)).alias("url"), F.when(c % 8 == 0, "ALLOCATION_EXHAUSTED").when(c % 12 == 4, "POLICY").alias("denied"))
    return identity.fallback(first, rows.select(c.alias("search"), F.concat(F.lit("s"), o).alias("url")), "search", ["ALLOCATION_EXHAUSTED"])


@register(
    "price_cards",
    """WITH p AS (SELECT p_partkey, p_brand, p_retailprice FROM part), t AS (SELECT unnest([1, 4, 8, 12]) AS events), f AS (SELECT unnest([0, 1, 2, 3]) AS k, unnest([1, 4, 8, 12]) AS events)
      SELECT p_partkey, events, round(p_retailprice * (1 - 0.1 * k), 2) AS price FROM p, f""",
)
def price_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "part").select("p_partkey", F.array(*[F.struct(F.lit(n).alias("events"), F.round(F.col("p_retailprice") * (1 - F.lit(k) * 0.1), 2).alias("price")) for k, n in enumerate((1, 4, 8, 12))]).alias("tiers"))
    return commerce.price_tiers(cards, "p_partkey", "tiers")


@register(
    "playbooks",
    """WITH b AS (SELECT * FROM (VALUES ('suite', 'ZA', 'direct', 'pb-za'), ('suite', 'GB', 'direct', 'pb-gb'), ('suite', 'GB', 'local', 'pb-gb-local')) v(product, territory, motion, playbook)), l AS (SELECT c_custkey, 'suite' AS product, ['ZA', 'GB', 'FR'][1 + c_custkey % 3] AS territory, ['direct', 'local'][1 + c_custkey % 2] AS motion FROM customer)
      SELECT c_custkey, playbook, CASE WHEN playbook IS NULL THEN 'PLAYBOOK_MISSING' END AS error FROM l LEFT JOIN b USING (product, territory, motion)""",
)
def playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = spark.createDataFrame([("suite", "ZA", "direct", "pb-za"), ("suite", "GB", "direct", "pb-gb"), ("suite", "GB", "local", "pb-gb-local")], "product string, territory string, motion string, playbook string")
    key = F.col("c_custkey")
    leads = table(spark, sf_dir, "customer").select(key, F.lit("suite").alias("product"), pick(("ZA", "GB", "FR"), key).alias("territory"), pick(("direct", "local"), key).alias("motion"))
    return commerce.with_playbook(leads, books).select("c_custkey", "playbook", "error")


@register(
    "claim_eligibility",
    "SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_returnflag = 'R' AND l_linestatus = 'F' AS usable FROM lineitem",
)
def claim_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.when(F.col("l_partkey") % 2 == 0, "DEFENSIBLE").otherwise("COMMODITY")
    category = F.when(F.col("l_suppkey") % 2 == 0, "DEFENSIBLE_DIFFERENTIATOR").otherwise("FEATURE")
    comparison, confidence = F.when(F.col("l_returnflag") == "R", "EVIDENCE_BACKED").otherwise("NONE"), F.when(F.col("l_linestatus") == "F", "HIGH").otherwise("LOW")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", commerce.usable_claim(strength, category, comparison, confidence).alias("usable"))


@register("commodity_claims", "SELECT DISTINCT 'commodity-' || replace(p_name, ' ', '-') AS id, p_name AS claim FROM part")
def commodity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.commodity_claims(table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct())


@register(
    "search_admission",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, event_id % 9 > 0 AS active, event_id % 11 > 0 AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT event_id, user_id, n, CASE WHEN NOT active THEN 'ALLOWANCE_INACTIVE' WHEN NOT running THEN 'RUN_INACTIVE' ELSE 'RESERVED' END AS decision, CASE WHEN active AND running THEN 1 ELSE 0 END AS day_n, CASE WHEN active AND running THEN ts END AS last, CAST(ts AS DATE) AS day FROM r WHERE n = 1
        UNION ALL SELECT x.event_id, x.user_id, x.n, x.d, CASE WHEN x.d = 'RESERVED' THEN x.used + 1 ELSE x.used END, CASE WHEN x.d = 'RESERVED' THEN x.ts ELSE x.last END, x.today FROM (
          SELECT y.*, CASE WHEN NOT active THEN 'ALLOWANCE_INACTIVE' WHEN NOT running THEN 'RUN_INACTIVE' WHEN used >= 2 THEN 'PROVIDER_DAILY_BUDGET' WHEN last IS NOT NULL AND ts < last + INTERVAL 3 HOUR THEN 'PROVIDER_RATE_LIMIT' ELSE 'RESERVED' END AS d FROM (
            SELECT r.event_id, r.user_id, r.n, r.ts, r.active, r.running, CASE WHEN CAST(r.ts AS DATE) = f.day THEN f.day_n ELSE 0 END AS used, f.last, CAST(r.ts AS DATE) AS today FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) y) x)
      SELECT event_id, decision FROM f""",
)
def search_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.col("user_id").alias("provider"), F.col("ts").alias("at"), ledgers.first_failing([("ALLOWANCE_INACTIVE", e % 9 > 0), ("RUN_INACTIVE", e % 11 > 0)], "OPEN").alias("guard"))
    return ledgers.admit_searches(rows, "provider", "at", "event_id", "guard", daily=2, spacing_ms=3 * 3_600_000).select("event_id", "decision")


@register(
    "work_completion",
    """WITH r AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 10 > 0 THEN event_id % 6 END AS actual, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS cost, 4 AS reserved, event_type FROM events), o AS (SELECT *, actual IS NOT NULL AND cost = 0 AND actual <= reserved AS good, CASE WHEN actual > reserved OR cost > 0 THEN 'QUARANTINED' WHEN event_type = 'error' THEN 'RETRYABLE' ELSE 'COMPLETED' END AS outcome FROM r),
      g AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM o), s AS (SELECT *, CASE WHEN good THEN 0 ELSE sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS streak FROM g)
      SELECT event_id, outcome, CAST(streak AS BIGINT) AS streak, bool_and(outcome <> 'QUARANTINED' AND streak < 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS enabled FROM s""",
)
def work_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    receipts = table(spark, sf_dir, "events").select(
        e, F.col("user_id").alias("policy"), F.col("ts").alias("at"), F.when(e % 10 > 0, e % 6).alias("actual"), F.when(e % 13 == 0, 1).otherwise(0).alias("cost"), F.lit(4).alias("reserved"), F.when(F.col("event_type") == "error", "RETRYABLE").otherwise("COMPLETED").alias("state")
    )
    return ledgers.completed_work(receipts, "policy", "at", "event_id", most_failures=3).select("event_id", "outcome", "streak", "enabled")


@register(
    "workspace_overview",
    """WITH l AS (SELECT c_custkey, c_custkey % 9 = 0 AS test, ['NEEDS_REVIEW', 'GENUINE_PROSPECT', 'EXISTING_CUSTOMER', 'SPAM'][1 + c_custkey % 4] AS class, ['HIGH', 'LOW', 'VERY_HIGH'][1 + c_custkey % 3] AS intent, ['NEW', 'CONVERTED', 'REVIEWING'][1 + c_custkey // 3 % 3] AS stage, CASE WHEN c_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * c_nationkey END AS due FROM customer),
      m AS (SELECT count(*) FILTER (WHERE NOT test AND class = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE NOT test AND class = 'GENUINE_PROSPECT') AS active_genuine, count(*) FILTER (WHERE NOT test AND class IN ('NEEDS_REVIEW', 'GENUINE_PROSPECT') AND intent <> 'LOW' AND stage <> 'CONVERTED') AS high_intent,
        count(*) FILTER (WHERE NOT test AND due <= TIMESTAMP '2024-01-20' AND stage <> 'CONVERTED') AS follow_up_due, count(*) FILTER (WHERE NOT test AND class = 'EXISTING_CUSTOMER') AS existing_customers, count(*) FILTER (WHERE NOT test) AS leads FROM l),
      r AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_runs, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_runs, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest_run FROM orders)
      SELECT * FROM m, r""",
)
def workspace_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    leads = table(spark, sf_dir, "customer").select(
        (key % 9 == 0).alias("is_test"), pick(("NEEDS_REVIEW", "GENUINE_PROSPECT", "EXISTING_CUSTOMER", "SPAM"), key).alias("classification"), pick(("HIGH", "LOW", "VERY_HIGH"), key).alias("intent"), pick(("NEW", "CONVERTED", "REVIEWING"), F.floor(key / 3)).alias("stage"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("c_nationkey"))).alias("follow_up_at"),
    )
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING").alias("status"), F.col("o_orderdate").alias("created_at"))
    return commerce.overview(leads, runs, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
