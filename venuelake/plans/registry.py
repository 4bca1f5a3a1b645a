"""Every query of the engine, with the SQL it is checked against.

The driver's tables stand in for the engine's: events are appearances of users in daily runs, submissions of leads, and
receipts of spend; part and supplier are the catalogue; orders are requests; pages and conversations are what they say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import text
from venuelake.operators import actions, catalogue, crawling, inventory, leads, ledgers, resolution
from venuelake.operators.latest import latest_per_key
from venuelake.plans import address_queries, contact_queries, crawl_queries, document_queries, extraction_queries, identity_queries, ledger_queries, page_queries, reader_queries, rule_queries, scoring_queries, stream_queries  # noqa: F401
from venuelake.plans.catalog import AS_OF, ORACLES, QUERIES, as_of, pick, quoted, register, sql_pick  # noqa: F401
from venuelake.sources.shared import shared_folder
from venuelake.sources.tables import table
from venuelake.streaming import ingest, state

STATES = ("QUALIFIED", "REVIEW_REQUIRED", "REJECTED", "DUPLICATE", "RESEARCHED")
STATUS = {"error": "REJECTED", "purchase": "QUALIFIED", "signup": "REVIEW_REQUIRED", "click": "RESEARCHED", "view": "DUPLICATE"}
CATEGORY = {"error": "NEWSLETTER", "purchase": "TALK_TO_SALES", "signup": "TRIAL_STARTED", "click": "RESOURCE_DOWNLOAD", "view": "TEMPLATE_DOWNLOAD"}


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


APPEARANCES = f"""SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id AS canonical_key,
  {_case("event_type", STATUS)} AS status, CASE WHEN user_id % 2 = 0 THEN 'ZA' ELSE 'GB' END AS territory,
  event_id % 17 = 0 AS deduped, k % 4 AS sources, k % 5 AS facts, k % 3 AS unknowns, CASE WHEN k % 7 = 0 THEN 'UNRESOLVED' END AS resolution,
  ts AS created_at, ts AS last_seen_at, ts AS updated_at
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""
CANONICAL = f"""WITH app AS ({APPEARANCES}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY last_seen_at DESC, created_at DESC, id DESC) AS rn,
             count(*) OVER (PARTITION BY canonical_key) AS appearance_count FROM app),
  canonical AS (SELECT *, CASE WHEN status = 'DUPLICATE' OR deduped THEN 'DUPLICATES' WHEN status = 'BLOCKED' THEN 'BLOCKED'
    WHEN status = 'REJECTED' THEN 'REJECTED' WHEN status = 'QUALIFIED' THEN 'QUALIFIED' WHEN status = 'REVIEW_REQUIRED' THEN 'NEEDS_REVIEW' ELSE 'ACTIVE' END AS inventory_state,
    CASE WHEN sources = 0 THEN 'MISSING_SOURCE' WHEN facts = 0 THEN 'NEEDS_EVIDENCE' WHEN unknowns > 0 OR resolution = 'UNRESOLVED' THEN 'UNRESOLVED' ELSE 'READY' END AS inventory_quality
    FROM ranked WHERE rn = 1)"""
PAGE = ("id", "canonical_key", "status", "territory", "inventory_state", "inventory_quality", "appearance_count", "last_seen_at")


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").cast("string").alias("run_id"), F.col("user_id").alias("canonical_key"),
        leads.lookup(F.col("event_type"), STATUS).alias("status"), F.when(F.col("user_id") % 2 == 0, "ZA").otherwise("GB").alias("territory"),
        (F.col("event_id") % 17 == 0).alias("deduped"), (k % 4).alias("sources"), (k % 5).alias("facts"), (k % 3).alias("unknowns"),
        F.when(k % 7 == 0, "UNRESOLVED").alias("resolution"), F.col("ts").alias("created_at"), F.col("ts").alias("last_seen_at"), F.col("ts").alias("updated_at"),
    )


@register(
    "latest_per_user",
    """SELECT event_id, user_id, event_type, ts FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
       ) WHERE rn = 1""",
)
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return latest_per_key(events, "user_id", [F.desc("ts"), F.desc("event_id")])


@register("inventory_page", f"{CANONICAL} SELECT {', '.join(PAGE)} FROM canonical WHERE territory = 'ZA' AND inventory_quality <> 'READY' ORDER BY last_seen_at DESC, created_at DESC, id DESC LIMIT 25 OFFSET 25")
def inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.optional_filters(inventory.canonical(appearances(spark, sf_dir)), {"territory": "ZA", "status": "ALL"}).filter("inventory_quality <> 'READY'")
    return inventory.offset_page(rows, [F.desc(c) for c in inventory.INVENTORY_ORDER], 2, 25).select(*PAGE)


@register("inventory_rows", f"{CANONICAL} SELECT {', '.join(PAGE)} FROM canonical")
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.canonical(appearances(spark, sf_dir)).select(*PAGE)


@register("inventory_in_run", f"{CANONICAL} SELECT {', '.join(PAGE)} FROM canonical c WHERE EXISTS (SELECT 1 FROM app a WHERE a.canonical_key = c.canonical_key AND a.run_id = '2024-01-05')")
def inventory_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = appearances(spark, sf_dir)
    return inventory.in_run(inventory.canonical(app), app, "2024-01-05").select(*PAGE)


@register(
    "inventory_facets",
    f"""{CANONICAL} SELECT count(*) AS total, {", ".join(f"count(*) FILTER (WHERE inventory_state = '{s}') AS {s.lower()}" for s in ("ACTIVE", "NEEDS_REVIEW", "QUALIFIED", "REJECTED", "DUPLICATES", "BLOCKED"))} FROM canonical""",
)
def inventory_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.canonical(appearances(spark, sf_dir))
    return inventory.facets(rows, "inventory_state", ("ACTIVE", "NEEDS_REVIEW", "QUALIFIED", "REJECTED", "DUPLICATES", "BLOCKED"))


@register(
    "run_history",
    f"""WITH app AS ({APPEARANCES}),
      runs AS (SELECT run_id, min(created_at) AS s, max(created_at) AS e, count(*) AS appearance_count FROM app GROUP BY 1),
      cur AS (SELECT canonical_key, status FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY last_seen_at DESC, updated_at DESC, created_at DESC, id DESC) AS rn FROM app) WHERE rn = 1),
      ini AS (SELECT run_id, count(*) AS n FROM (SELECT run_id, row_number() OVER (PARTITION BY canonical_key ORDER BY created_at, id) AS rn FROM app) WHERE rn = 1 GROUP BY 1),
      dis AS (SELECT p.run_id, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_count" for s in STATES)} FROM (SELECT DISTINCT run_id, canonical_key FROM app) p JOIN cur USING (canonical_key) GROUP BY 1)
      SELECT run_id, CAST(floor(epoch(e)) - floor(epoch(s)) AS BIGINT) AS duration_seconds, appearance_count, coalesce(n, 0) AS introduction_count, {", ".join(f"{s.lower()}_count" for s in STATES)}
      FROM runs LEFT JOIN ini USING (run_id) JOIN dis USING (run_id)""",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = appearances(spark, sf_dir)
    runs = app.groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"))
    return inventory.run_history(app, runs, STATES)


QUEUE = f"{CANONICAL} SELECT {', '.join(PAGE)} FROM canonical WHERE inventory_state <> 'REJECTED'"


def _queue(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    rows = inventory.canonical(appearances(spark, sf_dir)).filter("inventory_state <> 'REJECTED'")
    return inventory.keyset_page(rows, [("territory", True), ("last_seen_at", False), ("id", True)], ["GB", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 100], 4, forward).select(*PAGE)


@register("prospect_queue_page", f"{QUEUE} AND (territory > 'GB' OR territory = 'GB' AND (last_seen_at < TIMESTAMP '2024-01-30 12:00:00' OR last_seen_at = TIMESTAMP '2024-01-30 12:00:00' AND id > 100)) ORDER BY territory, last_seen_at DESC, id LIMIT 5")
def prospect_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir, True)


@register("prospect_queue_back", f"{QUEUE} AND (territory < 'GB' OR territory = 'GB' AND (last_seen_at > TIMESTAMP '2024-01-30 12:00:00' OR last_seen_at = TIMESTAMP '2024-01-30 12:00:00' AND id < 100)) ORDER BY territory DESC, last_seen_at, id DESC LIMIT 5")
def prospect_queue_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir, False)


@register(
    "attention_lanes",
    f"""{CANONICAL} SELECT * FROM (
      (SELECT 'review' AS lane, 0 AS lane_order, id, last_seen_at FROM canonical WHERE inventory_state = 'NEEDS_REVIEW' ORDER BY last_seen_at, id LIMIT 3) UNION ALL
      (SELECT 'missing' AS lane, 1 AS lane_order, id, last_seen_at FROM canonical WHERE inventory_quality = 'MISSING_SOURCE' ORDER BY last_seen_at DESC, id LIMIT 2) UNION ALL
      (SELECT 'qualified' AS lane, 2 AS lane_order, id, last_seen_at FROM canonical WHERE inventory_state = 'QUALIFIED' ORDER BY last_seen_at DESC, id LIMIT 3))""",
)
def attention_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, quality = F.col("inventory_state"), F.col("inventory_quality")
    lanes = [("review", state == "NEEDS_REVIEW", F.lit(1), 3), ("missing", quality == "MISSING_SOURCE", F.lit(-1), 2), ("qualified", state == "QUALIFIED", F.lit(-1), 3)]
    return inventory.attention(inventory.canonical(appearances(spark, sf_dir)), lanes, "last_seen_at", "id")


SUBMISSIONS = f"""SELECT event_id AS id, CAST(user_id AS VARCHAR) || '|suite' AS canonical_key, {_case("event_type", CATEGORY)} AS category, ts AS received_at, ts AS occurred_at FROM events"""
_RANK = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in leads.RANKS.items()) + " END"
_LADDER = "CASE WHEN rank >= 5 THEN 'VERY_HIGH' WHEN rank = 4 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' END"
PROJECTION = f"""WITH s AS ({SUBMISSIONS}), r AS (SELECT *, {_RANK} AS rank, row_number() OVER (PARTITION BY canonical_key ORDER BY received_at, id) AS n FROM s),
  e AS (SELECT *, coalesce({_LADDER}, CASE WHEN rank = 0 THEN 'NURTURE' END, CASE WHEN n = 1 THEN 'LOW' END) AS intent, coalesce({_LADDER}, CASE WHEN n = 1 THEN 'LOW' END) AS prio FROM r),
  leads AS (SELECT canonical_key, arg_max(intent, n) FILTER (WHERE intent IS NOT NULL) AS current_intent, arg_max(prio, n) FILTER (WHERE prio IS NOT NULL) AS priority,
    arg_max(category, n) AS latest_category, arg_min(category, n) AS first_category, max(rank) AS highest_rank,
    CASE WHEN arg_min(category, n) = 'TRIAL_STARTED' THEN 'TRIAL_ACTIVE' WHEN bool_or(n > 1 AND rank >= 4) THEN 'REVIEWING' ELSE 'NEW' END AS stage,
    min(occurred_at) AS first_activity, max(occurred_at) AS last_activity, count(*) AS activity_count FROM e GROUP BY 1)"""


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.project(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("|suite")).alias("canonical_key"),
            leads.lookup(F.col("event_type"), CATEGORY).alias("category"), F.col("ts").alias("received_at"), F.col("ts").alias("occurred_at"),
        )
    )


@register("lead_projection", f"{PROJECTION} SELECT * FROM leads")
def lead_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leads(spark, sf_dir)


@register("streamed_projection", f"{PROJECTION} SELECT * FROM leads")
def streamed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    events = stream_queries.stream(spark, sf_dir, "events").select(
        F.lit("events").alias("source_system"), F.col("event_id").cast("string").alias("source_record_id"), F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("|suite")).alias("canonical_key"),
        leads.lookup(F.col("event_type"), CATEGORY).alias("category"), moment.alias("received_at"), moment.alias("occurred_at"),
    )
    path = shared_folder(spark, "projection")
    with state.rocksdb(spark):
        query = ingest.project_batches(events, path, shared_folder(spark, "projection-state")).trigger(availableNow=True).start()
    stream_queries.finished(query)
    wall = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    found = ingest.read_projection(spark, path)
    return found.select(*[wall(c) if c in ("first_activity", "last_activity") else c for c in found.columns])


@register(
    "lead_queue",
    f"""{PROJECTION}, q AS (SELECT *, {"CASE priority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in leads.PRIORITY_RANKS.items()) + " END"} AS priority_rank FROM leads WHERE (first_category = 'TRIAL_STARTED' OR latest_category = 'TRIAL_STARTED'))
      SELECT *, (SELECT count(*) FROM q) AS total_count FROM q ORDER BY priority_rank DESC NULLS LAST, last_activity DESC, canonical_key DESC LIMIT 20 OFFSET 5""",
)
def lead_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.queue(_leads(spark, sf_dir), category="TRIAL_STARTED", stage="ALL", size=20, offset=5)


@register(
    "lead_metrics",
    f"""{PROJECTION} SELECT count(*) AS leads, count(*) FILTER (WHERE current_intent IN ('VERY_HIGH', 'HIGH')) AS high_intent, count(*) FILTER (WHERE stage = 'REVIEWING') AS reviewing,
      count(*) FILTER (WHERE stage = 'TRIAL_ACTIVE') AS trials, count(*) FILTER (WHERE last_activity < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS stale, CAST(sum(activity_count) AS BIGINT) AS activities FROM leads""",
)
def lead_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.metrics(_leads(spark, sf_dir), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@register(
    "reservation_guards",
    """SELECT o_orderkey, CASE WHEN NOT coalesce(o_orderstatus <> 'F', false) THEN 'POLICY_INACTIVE' WHEN NOT coalesce(o_totalprice < 400000, false) THEN 'RESERVATION_SCOPE'
      WHEN NOT coalesce(o_orderpriority <> '5-LOW', false) THEN 'IDENTITY_QUARANTINED' ELSE 'ADMITTED' END AS decision FROM orders""",
)
def reservation_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    guards = [("POLICY_INACTIVE", F.col("o_orderstatus") != "F"), ("RESERVATION_SCOPE", F.col("o_totalprice") < 400000), ("IDENTITY_QUARANTINED", F.col("o_orderpriority") != "5-LOW")]
    return table(spark, sf_dir, "orders").select("o_orderkey", ledgers.first_failing(guards).alias("decision"))


@register(
    "request_spacing",
    "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000, false) AS too_soon FROM events",
)
def request_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.spaced(table(spark, sf_dir, "events"), ["user_id"], "ts", 1_800_000).select("event_id", "too_soon")


@register(
    "batch_selection",
    """WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
      f AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS hosts, CAST([] AS TIMESTAMP[]) AS days, CAST(NULL AS BIGINT) AS picked
        UNION ALL SELECT o.n, CASE WHEN list_contains(hosts, o_custkey) OR list_contains(days, o_orderdate) THEN hosts ELSE list_append(hosts, o_custkey) END, CASE WHEN list_contains(hosts, o_custkey) OR list_contains(days, o_orderdate) THEN days ELSE list_append(days, o_orderdate) END,
          CASE WHEN list_contains(hosts, o_custkey) OR list_contains(days, o_orderdate) THEN NULL ELSE o_orderkey END FROM f JOIN o ON o.n = f.n + 1 WHERE len(hosts) < 50)
      SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT picked FROM f)""",
)
def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.select_batch(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", "o_custkey", "o_orderdate", 50)


@register(
    "ledger_reconciliation",
    """SELECT o_orderkey, 1 + o_orderkey % 7 AS declared, coalesce(n, 0) AS recounted, greatest(1 + o_orderkey % 7, coalesce(n, 0)) AS effective, 1 + o_orderkey % 7 = coalesce(n, 0) AS agrees
      FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)""",
)
def ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("declared"))
    return ledgers.reconcile(declared, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@register(
    "field_freshness",
    """WITH o AS (SELECT user_id, event_type AS field, CAST(value AS VARCHAR) AS v, value, ts FROM events)
      SELECT user_id, field, arg_max(value, struct_pack(a := ts, b := value)) AS value, max(ts) AS observed_at FROM o GROUP BY 1, 2""",
)
def field_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.merge_fields(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "value", F.col("ts").alias("observed_at")), "user_id")


@register(
    "cache_expiry",
    f"SELECT event_id, CASE WHEN ts + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}' THEN props END AS props, ts + INTERVAL 24 HOUR AS expires_at FROM events",
)
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").select("event_id", "props", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    return ledgers.expire(cache, ["props"], "expires_at", as_of())


CATALOGUE = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND lower(p_name) LIKE '%ring%' AND (p_size > 10) = false"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("large", F.col("p_size") > 10)
    return catalogue.filtered(rows, equal={"p_brand": None}, among={"p_type": ["ECONOMY", "SMALL"]}, flags={"large": False}, search=(["p_name"], "RING")).drop("large")


@register("catalogue_page", f"{CATALOGUE} ORDER BY p_name ASC NULLS LAST, p_partkey LIMIT 50 OFFSET 5")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.page(_catalogue(spark, sf_dir), ["p_name", "p_retailprice"], "p_name", "p_partkey", offset=5).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("catalogue_count", f"SELECT count(*) AS total FROM ({CATALOGUE})")
def catalogue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).agg(F.count("*").alias("total"))


@register(
    "account_match",
    """WITH a AS (SELECT c_custkey, lower(trim('Account ' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % 20 END)) AS name FROM customer), n AS (SELECT name, count(*) AS n, min(c_custkey) AS i FROM a GROUP BY 1),
      l AS (SELECT p_partkey, '  ACCOUNT   ' || p_partkey AS organisation FROM part)
      SELECT p_partkey, organisation, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS identity_state, CASE WHEN n = 1 THEN i END AS account_id FROM l LEFT JOIN n ON name = regexp_replace(lower(trim(organisation)), '\\s+', ' ', 'g')""",
)
def account_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.lit("Account "), F.when(key % 3 == 0, key).otherwise(key % 20).cast("string"))
    accounts = table(spark, sf_dir, "customer").select(key.alias("account_id"), name.alias("account_name"))
    return leads.account_match(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  ACCOUNT   "), F.col("p_partkey").cast("string")).alias("organisation")), accounts)


ORGANISATIONS = ("Café Royal Hall", "The Grand Hall", "hall", "City Art Museum", "Art", "Museum of the City", "Grand-Hall!", "Lakeside Barn & Farm", "Barn", "Ça", "Unrelated Place", "Farm Lakeside Events")
SUPPLIERS = ("cafe royal", "GRAND HALL", "Smart Party", "city museum", "Lakeside farm", "ca", "...", "Old Unrelated Place Hotel", "Hallmark")
_CANONICAL = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@register(
    "fuzzy_names",
    f"""WITH l AS (SELECT c_custkey, {_CANONICAL.format(sql_pick(ORGANISATIONS, "c_custkey") + " || ' ' || c_custkey // 12")} AS n FROM customer), r AS (SELECT s_suppkey, {_CANONICAL.format(sql_pick(SUPPLIERS, "s_suppkey") + " || ' ' || s_suppkey // 9")} AS m FROM supplier),
      p AS (SELECT c_custkey, s_suppkey, n, m, list_distinct(string_split(n, ' ')) AS a, list_distinct(string_split(m, ' ')) AS b FROM l, r WHERE n <> '' AND m <> ''), o AS (SELECT *, len(list_intersect(a, b)) AS overlap, greatest(len(a), len(b)) AS most FROM p)
      SELECT c_custkey AS left_c_custkey, s_suppkey AS right_s_suppkey, CAST(overlap AS INT) AS overlap, overlap / most AS score FROM o WHERE contains(n, m) OR contains(m, n) OR overlap >= 2 AND overlap * 2 >= most""",
)
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", pick(ORGANISATIONS, F.col("c_custkey")), F.floor(F.col("c_custkey") / 12).cast("string")).alias("name"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", pick(SUPPLIERS, F.col("s_suppkey")), F.floor(F.col("s_suppkey") / 9).cast("string")).alias("name"))
    return resolution.fuzzy_pairs(left, right, "c_custkey", "s_suppkey", "name", "name")


@register(
    "agreed_site",
    """SELECT l_orderkey, arg_min(l_suppkey, struct_pack(a := l_linenumber, b := l_suppkey)) AS host, count(DISTINCT l_suppkey) = 1 AS agreed FROM lineitem GROUP BY 1""",
)
def agreed_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.agreed_site(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("host"), F.col("l_linenumber").alias("priority")), "l_orderkey")


@register("value_conflicts", "SELECT l_partkey, l_returnflag, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1")
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.conflicts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus")


@register("unseen_evidence", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'A' AND s.l_partkey = l.l_partkey AND s.l_suppkey = l.l_suppkey)")
def unseen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return inventory.unseen(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey").distinct()


@register(
    "first_wins_union",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS n FROM events WHERE event_type IN ('purchase', 'signup')) WHERE n = 1""",
)
def first_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return inventory.first_wins([events.filter("event_type = 'purchase'"), events.filter("event_type = 'signup'")], ["user_id"], ["event_id"])


@register(
    "parents_with_children",
    """SELECT c.c_custkey, c.c_name, coalesce(string_agg(o.o_orderkey || o.o_orderstatus, ',' ORDER BY o.o_orderkey), '') AS children, count(o.o_orderkey) AS n_orders, min(o.o_orderkey) AS first_order FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
)
def parents_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    rows = inventory.with_children(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderkey"], "orders")
    return rows.select("c_custkey", "c_name", F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), o["o_orderstatus"])), ",").alias("children"), F.size("orders").cast("long").alias("n_orders"), F.try_element_at("orders", F.lit(1))["o_orderkey"].alias("first_order"))


@register(
    "state_histogram",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_count" for t in STATUS)} FROM events GROUP BY 1""",
)
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.histogram(table(spark, sf_dir, "events").withColumn("run_id", F.to_date("ts").cast("string")), "run_id", "event_type", STATUS)


@register(
    "due_messages",
    f"SELECT event_id, ts FROM events WHERE event_type IN ('click', 'signup') AND ts <= TIMESTAMP '{AS_OF}' ORDER BY ts, event_id LIMIT 25",
)
def due_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.due(table(spark, sf_dir, "events"), "event_type", ["click", "signup"], "ts", "event_id", as_of()).select("event_id", "ts")


@register(
    "page_links",
    r"""SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(html, ''), '<a\b[^>]*?href="([^"]*)"', 1, 'i')) AS href FROM pages) GROUP BY 1""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(text.hrefs(F.col("html"))).alias("href")).groupBy("href").agg(F.count("*").alias("n"))


@register(
    "turn_timeline",
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1",
)
def turn_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.char_length("text")).alias("n_chars")
    )


@register(
    "stable_ids",
    "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stable_id FROM (SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS h FROM customer)",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("stable_id"))


@register(
    "successor_chains",
    """WITH RECURSIVE m AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 3 WHEN p_partkey % 13 = 0 THEN p_partkey WHEN p_partkey % 7 = 0 THEN -1 - p_partkey ELSE p_partkey // 2 END AS successor FROM part),
      c AS (SELECT place AS start, [place, successor] AS ids FROM m UNION ALL SELECT start, list_append(ids, successor) FROM c JOIN m ON place = ids[-1] WHERE len(ids) <= 5 AND NOT list_contains(ids[:-2], ids[-1])),
      l AS (SELECT start, arg_max(ids, len(ids)) AS ids FROM c GROUP BY 1)
      SELECT start, ids[-1] AS last, CAST(len(ids) - 1 AS INT) AS hops, CASE WHEN list_contains(ids[:-2], ids[-1]) THEN 'CYCLE' WHEN len(ids) > 5 THEN 'LIMIT' ELSE 'ENDED' END AS state FROM l""",
)
def successor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    successor = F.when(key % 11 == 0, key + 3).when(key % 13 == 0, key).when(key % 7 == 0, -1 - key).otherwise(F.floor(key / 2).cast("long"))
    return resolution.successors(table(spark, sf_dir, "part").select(key.alias("place"), successor.alias("successor")))


_BODY = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _decoded_sql(html: str) -> str:
    out = f"regexp_replace(regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, char in text.ENTITIES:
        out = f"replace({out}, '&{name};', {quoted(char)})"
    return _BODY.format(out)


ENCODED = ("&lt;b&gt; &amp;amp; &pound;5&ndash;6", "caf&eacute; &#233;&#x41;", "&copy; Hall &hellip; &#0; &#128512;", "<p>a</p><script>x</script>&nbsp;b", "&unknown; &quot;q&quot;", "plain")
DECODED = ("<b> &amp; £5–6", "café éA", "© Hall … &#0; 😀", "a b", '&unknown; "q"', "plain")


@register("page_text", f"SELECT page_id, {_decoded_sql('html')} AS text FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) UNION ALL SELECT 1000000000 + event_id, {sql_pick(DECODED, 'event_id')} FROM events")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = table(spark, sf_dir, "events").select((F.lit(1000000000) + F.col("event_id")).alias("page_id"), pick(ENCODED, F.col("event_id")).alias("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(encoded)
    return pages.select("page_id", text.visible_text(F.col("html")).alias("text"))


SHELLS = (
    '<body><div id="root"></div><p>Hi</p></body>', "<body><p>Hi</p></body>", "<script id='__NEXT_DATA__'>{}</script><body>x</body>", "<body>window.__NUXT__={}</body>", "<body><noscript>Please enable JavaScript</noscript></body>",
    '<meta name="description" content="A hall for all sorts of events in the middle of town"><body>x</body>', "<body>" + "<script></script>" * 8 + "x</body>", '<body><div id="app"> <noscript>x</noscript></div>' + "word " * 100 + "</body>",
)
_SIGNALS = ("EMPTY_FRAMEWORK_MOUNT", "", "NEXT_DATA", "NUXT_STATE", "NOSCRIPT_JS_REQUIRED", "METADATA_WITHOUT_BODY", "SCRIPT_HEAVY_THIN_BODY", "EMPTY_FRAMEWORK_MOUNT")


@register("shell_pages", f"SELECT event_id, {sql_pick(_SIGNALS, 'event_id')} AS signals, event_id % 8 NOT IN (1, 7) AS shell FROM events")
def shell_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", pick(SHELLS, F.col("event_id")).alias("html"))
    return rows.select("event_id", F.array_join(text.shell_signals(F.col("html")), ",").alias("signals"), text.shell_page(F.col("html")).alias("shell"))


@register(
    "crawl_plan",
    """WITH c AS (SELECT *, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS found FROM lineitem),
      m AS (SELECT l_orderkey AS site, l_partkey % 5 AS page, max(CAST(l_quantity AS BIGINT)) AS strength, min(found) AS found, arg_min(1 + l_suppkey % 4, found) AS tier, arg_min(l_linenumber, found) AS depth,
        arg_min(l_suppkey % 2 = 0, found) AS is_link, arg_min(l_partkey % 3 = 0, found) AS is_article, CAST(bool_or(l_returnflag = 'R') AS INT) + CAST(bool_or(l_linestatus = 'O') AS INT) AS served FROM c GROUP BY 1, 2),
      s AS (SELECT *, (4 - tier) * 1000 + strength * 10 + served * 4 - least(depth, 6) + CASE WHEN is_link THEN 2 ELSE 0 END - CASE WHEN is_article THEN 30 ELSE 0 END AS score FROM m WHERE served > 0)
      SELECT site, page, served, score, row_number() OVER (PARTITION BY site ORDER BY tier, score DESC, found) AS position FROM s""",
)
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("site"), (F.col("l_partkey") % 5).alias("page"), F.array("l_returnflag", "l_linestatus").alias("dims"), F.col("l_quantity").cast("long").alias("strength"),
        (F.col("l_linenumber") * F.lit(10000000000) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("order"), (1 + F.col("l_suppkey") % 4).alias("tier"), F.col("l_linenumber").alias("depth"),
        (F.col("l_suppkey") % 2 == 0).alias("is_link"), (F.col("l_partkey") % 3 == 0).alias("is_article"),
    )
    plan = crawling.merged_plan(candidates, "site", "page", ["tier", "depth", "is_link", "is_article"])
    return crawling.ranked_plan(plan, "site", ["R", "O"]).select("site", "page", "served", "score", "position")


FAILURE = {"error": "DNS_NXDOMAIN", "purchase": "", "signup": "ETIMEDOUT", "click": "", "view": ""}


@register(
    "crawl_dispositions",
    f"""WITH c AS (SELECT event_id, {_case("event_type", FAILURE)} AS failure, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 200 + 3 * (event_id % 101) END AS status, event_id % 29 = 0 AS excluded, user_id % 11 = 0 AS robots,
        event_id % 3 > 0 AS verified, event_id % 5 AS redirects FROM events),
      d AS (SELECT *, CASE WHEN excluded THEN 'HUMAN_CONFIRMED_EXCLUSION' WHEN robots THEN 'ROBOTS_EXCLUDED' WHEN failure = 'DNS_NXDOMAIN' THEN failure WHEN failure = 'ETIMEDOUT' THEN 'CONNECTION_TIMEOUT'
        WHEN status = 401 THEN 'HTTP_401_AUTH_REQUIRED' WHEN status >= 400 THEN 'HTTP_' || status WHEN NOT verified THEN 'NO_VENUE_IDENTITY_EVIDENCE' WHEN redirects > 0 THEN 'OFFICIAL_URL_REDIRECT_VERIFIED' ELSE 'WEBSITE_EVIDENCE_FETCHED' END AS code FROM c)
      SELECT event_id, code, CASE WHEN code IN ('DNS_NXDOMAIN', 'HTTP_404', 'HTTP_410') THEN 'TERMINAL' WHEN code IN ('CONNECTION_TIMEOUT', 'HTTP_500', 'HTTP_503') THEN 'RETRYABLE'
        WHEN code IN ('OFFICIAL_URL_REDIRECT_VERIFIED', 'WEBSITE_EVIDENCE_FETCHED') THEN 'SUCCESS' ELSE 'EVIDENCE_HELD' END AS category FROM d""",
)
def crawl_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    crawls = table(spark, sf_dir, "events").select(
        e, (e % 29 == 0).alias("excluded"), F.lit(None).cast("string").alias("conflict"), F.when(F.col("user_id") % 11 == 0, F.array(F.lit("ROBOTS_DISALLOW"))).alias("blocked"),
        leads.lookup(F.col("event_type"), FAILURE).alias("failure"), F.lit("").alias("message"), F.when(e % 13 != 0, (200 + 3 * (e % 101)).cast("int")).alias("status"), F.lit(True).alias("entry_is_site"),
        F.lit(False).alias("site_reachable"), F.lit(1).alias("documents"), (e % 3 > 0).alias("identity_verified"), F.lit(True).alias("contact_accepted"), (e % 5).alias("redirects"), F.lit(None).cast("string").alias("failure_class"),
    )
    return crawling.with_disposition(crawls).select("event_id", "code", "category")


@register(
    "capacity_conflicts",
    """SELECT l_partkey AS venue, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS space, lower(l_linestatus) AS layout, count(DISTINCT l_quantity) AS n_counts FROM lineitem GROUP BY 1, 2, 3
      HAVING count(DISTINCT l_quantity) > 1 AND (count(DISTINCT l_suppkey) > 1 OR CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END IS NOT NULL)""",
)
def capacity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("venue"), space.alias("space"), F.col("l_linestatus").alias("layout"), F.col("l_quantity").alias("capacity"), F.col("l_suppkey").alias("url"))
    return crawling.capacity_conflicts(facts, "venue")


ACTIONS = ("CHANGE_STAGE", "HOLD", "RELEASE_HOLD", "SET_WORK_PLAN", "QUALIFY", "MARK_CONVERTED", "ASSIGN_OWNER")


@register(
    "lead_actions",
    f"""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'why' END AS hold, nullif(c_nationkey, 0) AS owner, [{", ".join(f"'{a}'" for a in ACTIONS)}][1 + c_custkey % 7] AS action, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS reason,
        c_custkey % 3 = 0 AS opp FROM customer),
      g AS (SELECT *, action IN ('CHANGE_STAGE', 'QUALIFY', 'MARK_CONVERTED') AS moves FROM l),
      e AS (SELECT *, CASE WHEN hold IS NOT NULL AND moves THEN 'INCOMING_LEAD_HOLD_ACTIVE' WHEN action = 'QUALIFY' AND owner IS NULL THEN 'INCOMING_LEAD_OPPORTUNITY_INELIGIBLE'
        WHEN action = 'MARK_CONVERTED' OR opp AND moves THEN 'INCOMING_LEAD_USE_OPPORTUNITY_PROGRESSION' WHEN action = 'HOLD' AND reason IS NULL THEN 'INCOMING_LEAD_HOLD_REASON_REQUIRED'
        WHEN action = 'RELEASE_HOLD' AND reason IS NULL THEN 'INCOMING_LEAD_REASON_REQUIRED' END AS error FROM g)
      SELECT c_custkey, action, error, CASE WHEN error IS NULL AND action IN ('SET_WORK_PLAN', 'ASSIGN_OWNER') THEN 7 ELSE owner END AS owner_id,
        CASE WHEN error IS NULL AND action = 'HOLD' THEN reason WHEN error IS NULL AND action = 'RELEASE_HOLD' THEN NULL ELSE hold END AS hold_reason FROM e""",
)
def lead_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    rows = customer.select(
        key, F.when(key % 5 == 0, "why").alias("hold_reason"), F.lit("NEW").alias("stage"), F.lit("GENUINE_PROSPECT").alias("lead_classification"), F.nullif("c_nationkey", F.lit(0)).alias("owner_id"),
        F.lit("call").alias("next_action"), as_of().alias("follow_up_at"), F.when(key % 3 == 0, 1).alias("product_opportunity_id"),
    )
    asked = customer.select(
        key, F.element_at(F.array(*map(F.lit, ACTIONS)), (1 + key % 7).cast("int")).alias("action"), F.lit(7).alias("new_owner_id"), F.lit("visit").alias("plan"), as_of().alias("due_at"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).alias("reason"), F.lit("later").alias("condition"),
    )
    return actions.acted(rows, asked, "c_custkey").select("c_custkey", "action", "error", "owner_id", "hold_reason")


STAGE_ORDER = (*actions.PROGRESS, "converted", "lost", "disqualified")


@register(
    "opportunity_transitions",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, stage, target, coalesce(list_contains(CASE stage {" ".join(f"WHEN '{s}' THEN {list(t)}" for s, t in actions.PROGRESS.items())} END, target), false) AS allowed
      FROM (SELECT *, {list(STAGE_ORDER)}[1 + l_partkey % 9] AS stage, {list(STAGE_ORDER)}[1 + l_suppkey % 9] AS target FROM lineitem)""",
)
def opportunity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: F.element_at(F.array(*map(F.lit, STAGE_ORDER)), (1 + F.col(c) % 9).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", named("l_partkey").alias("stage"), named("l_suppkey").alias("target"))
    return rows.withColumn("allowed", actions.may_follow(F.col("stage"), F.col("target")))
