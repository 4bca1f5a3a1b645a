"""Registered queries of the smaller rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.operators import rules
from venuelake.plans.catalog import AS_OF, as_of, pick, register, sql_pick
from venuelake.sources.tables import table

LINKS = (("https://h.org/contact", "nav Contact"), ("https://h.org/a/b/spaces", "Rooms"), ("https://h.org/x/capacity.pdf", "Floor plans"), ("https://h.org/parking", ""), ("https://h.org/blog", "Story"), ("https://h.org/about/gallery", "nav photos"))
_ASSESSED = (("CONTACT", 7, "primary-navigation+contact-route"), ("SPACES", 1, "space-or-hire"), ("CAPACITY", 3, "capacity-or-specification"), ("FACILITIES", 1, "practical-detail"), (None, None, None), ("IMAGES+IDENTITY", 8, "primary-navigation+gallery+venue-character"))


@register(
    "link_assessments",
    f"SELECT event_id, {sql_pick([a[0] for a in _ASSESSED], 'event_id')} AS dims, CAST({sql_pick([a[1] and str(a[1]) for a in _ASSESSED], 'event_id')} AS INT) AS strength, {sql_pick([a[2] for a in _ASSESSED], 'event_id')} AS reason FROM events",
)
def link_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.link_assessment(pick([u for u, _ in LINKS], e), pick([t for _, t in LINKS], e)).alias("a")).select(e, "a.dims", "a.strength", "a.reason")


_PROPERTY = (("https://group.com/bars/aberdeen/", "", 7), ("https://group.com/news/aberdeen", "", 0), ("https://group.com/x", "Aberdeen 21", 8), ("https://group.com/contact", "", 0))


@register("property_links", f"SELECT event_id, CAST({sql_pick([str(p[2]) for p in _PROPERTY], 'event_id')} AS INT) AS strength FROM events")
def property_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.property_strength(F.lit("The Group Bar Aberdeen 21"), F.lit("group.com"), pick([p[0] for p in _PROPERTY], e), pick([p[1] for p in _PROPERTY], e)).alias("strength"))


@register(
    "run_results",
    """SELECT o_custkey AS run, count(*) AS found, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS resolved, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS unresolved, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS enriched, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS advanced,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS qualified, count(*) FILTER (WHERE o_orderstatus = 'O') AS review, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected, count(*) FILTER (WHERE o_totalprice > 200000) AS contactable FROM orders GROUP BY 1""",
)
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "QUALIFIED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("BLOCKED")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.when(o % 3 == 0, "RESOLVED").when(o % 3 == 1, "UNRESOLVED").alias("resolution"), (o % 2 == 0).alias("enriched"), (o % 5 == 0).alias("advanced"), status.alias("status"), (F.col("o_totalprice") > 200000).alias("contactable"))
    return rules.run_counts(rows, "run")


@register(
    "work_classes",
    f"SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'QUARANTINED' WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'CACHE' WHEN event_id % 11 = 0 THEN 'WEBSITE_RESOLUTION' WHEN ts > TIMESTAMP '{AS_OF}' THEN 'DEFERRED' ELSE 'SELECTABLE' END AS class FROM events",
)
def work_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.work_class(e % 5 > 0, e % 7 == 0, e % 4, e % 3 == 0, e % 11 > 0, F.col("ts"), as_of()).alias("class"))


@register(
    "fetch_plans",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'REUSE' ELSE 'FETCH' END AS decision, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'id,name' WHEN 2 THEN 'id,types,name' ELSE 'id,website,phone' END AS fields, CASE event_id % 4 WHEN 0 THEN 'FULL_HIT' WHEN 1 THEN 'PARTIAL_HIT' WHEN 2 THEN 'PARTIAL_HIT' ELSE 'MISS' END AS hit FROM events""",
)
def fetch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    fields = lambda *names: F.array(*map(F.lit, names))
    fresh = F.when(e % 4 == 0, fields("types", "name", "website")).when(e % 4 == 1, fields("types")).when(e % 4 == 2, fields("name")).otherwise(fields("other"))
    plan = rules.fetch_plan(fields("types", "name"), fresh, {"PRO": ("id", "types", "name"), "ENTERPRISE": ("id", "website", "phone")}, F.when(e % 4 == 2, "PRO").when(e % 4 == 3, "ENTERPRISE").otherwise("ESSENTIALS"))
    return table(spark, sf_dir, "events").select(e, plan.alias("p")).select(e, "p.*")


@register("pdf_ceilings", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(20000000, g) ELSE least(20000000, greatest(least(20000000, g), least(r, 15000000))) END AS bytes FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 60 AS g, CAST(floor(o_totalprice) AS BIGINT) * 100 AS r FROM orders)")
def pdf_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.pdf_ceiling(F.when(F.col("o_orderkey") % 3 > 0, price * 100), price * 60).cast("long").alias("bytes"))


LENSES = ("PRESENCE", "TICKETING", "OPERATIONS", "OTHER")
CATEGORIES = ("WEBSITE", "REGISTRATION", "WORKFORCE", "COMPLEXITY", "DISCOVERY")


@register(
    "valid_evidence",
    f"""WITH v AS (SELECT event_id, {sql_pick(LENSES, "event_id")} AS l, {sql_pick(CATEGORIES, "event_id // 4")} AS c FROM events) SELECT event_id, (l = 'PRESENCE' AND c IN ('WEBSITE', 'DISCOVERY') OR l = 'TICKETING' AND c = 'REGISTRATION' OR l = 'OPERATIONS' AND c IN ('WORKFORCE', 'COMPLEXITY')) AND event_id % 3 > 0 AND event_id % 7 > 0 AS valid FROM v""",
)
def valid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.valid_evidence(pick(LENSES, e), pick(CATEGORIES, F.floor(e / 4)), F.when(e % 3 > 0, "HIGH"), F.when(e % 7 > 0, "https://a.org/x").otherwise("no address")).alias("valid"))


ROLES = ("Freelance producer", "Head of events", "Volunteer", "Owner")
_SIGNALS = ("FREELANCE_EVENT_CONNECTOR", "DIRECT_BUYER_CANDIDATE", "ROUTE_TO_BUYER", "DIRECT_BUYER_CANDIDATE")


@register("person_signals", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ACTIVITY_UNVERIFIED' ELSE {sql_pick(_SIGNALS, 'event_id')} END AS signal FROM events")
def person_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.person_signal(pick(ROLES, e), e % 3 > 0).alias("signal"))


ENTRIES = ("PRESENCE", "TICKETING", "OPERATIONS", "UNKNOWN")
CLAIMS = ("A Festival in May", "University congress", "A bakery")
_OFFERS = ("marketing:festival", "ticketing:live-event", "festival-operations", "centre", "marketing", "ticketing", "conference-operations", "centre", "marketing", "ticketing", "operations", "centre")


@register("resource_offers", f"SELECT event_id, {sql_pick(_OFFERS, 'event_id')} AS offer FROM events")
def resource_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, rules.resource_offer(pick(ENTRIES, e), pick(CLAIMS, F.floor(e / 4))).alias("offer"))


@register(
    "recovery_scopes",
    "SELECT o_custkey AS scope, count(*) BETWEEN 1 AND 11 AND count(DISTINCT o_orderkey % 97) = count(*) AND bool_and(o_orderkey % 53 > 0 AND CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 90 < 89 ELSE o_orderkey % 8 BETWEEN 1 AND 6 END) AS valid FROM orders GROUP BY 1",
)
def recovery_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    prior = F.when(o % 2 == 0, F.when(o % 90 < 89, 0).otherwise(1)).otherwise(o % 8)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), (o % 97).alias("queue"), (o % 53 > 0).alias("source_known"), F.when(o % 2 == 0, "UNRESERVED").otherwise("RETRYABLE").alias("mode"), prior.alias("prior"))
    return rules.valid_scopes(rows, "scope")


@register(
    "leading_links",
    """WITH l AS (SELECT user_id AS page, ['/contact', '/events/a', '/spaces', '/x', '/contact-us'][1 + event_id % 5] || '/' || event_id % 3 AS url, max(event_id % 11) AS score FROM events GROUP BY 1, 2), c AS (SELECT page, url FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, url) AS n FROM l WHERE url LIKE '%contact%') WHERE n = 1),
      s AS (SELECT page, url FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, url) AS n FROM l WHERE url LIKE '%spaces%' AND (page, url) NOT IN (SELECT page, url FROM c)) WHERE n = 1)
      SELECT page, url, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN (page, url) IN (SELECT page, url FROM c) THEN 0 WHEN (page, url) IN (SELECT page, url FROM s) THEN 1 ELSE 2 END, score DESC, url) AS position FROM l""",
)
def leading_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    url = F.concat_ws("/", pick(("/contact", "/events/a", "/spaces", "/x", "/contact-us"), e), (e % 3).cast("string"))
    links = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page"), url.alias("url")).agg(F.max(e % 11).alias("score"))
    return rules.leading_links(links, "page", {"PUBLIC_CONTACT": "contact", "VENUE_FACTS": "spaces"})
