"""Registered queries of scores and rules over prospects, people, places and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.operators import scoring
from venuelake.plans.catalog import pick, register, sql_pick
from venuelake.sources.tables import table

CLAIMS = (
    "Organiser of the annual Harvest Festival", "Upcoming conference, tickets on sale", "The venue was held in 2019", "No official website, social-only", "Manual registration at the box office", "Multi-day expo with volunteers",
    "Cancelled show", "Strong official digital presence", "An integrated ticketing system", "Hosts a concert in 2027", "A bakery", "Presents two shows in 2021", "Returns this year with an exhibition",
)
#: What each claim tells, written down by hand: (event, responsible, freshness, gap, gap counter, ticket, ticket counter, complex).
_TOLD = (
    (1, 1, 2, 0, 0, 0, 0, 0), (1, 0, 1, 0, 0, 0, 0, 0), (0, 0, 3, 0, 0, 0, 0, 0), (0, 0, 5, 1, 0, 0, 0, 0), (0, 0, 5, 0, 0, 1, 0, 0), (1, 0, 5, 0, 0, 0, 0, 1),
    (1, 0, 4, 0, 0, 0, 0, 0), (0, 0, 5, 0, 1, 0, 0, 0), (0, 0, 5, 0, 0, 0, 1, 0), (1, 1, 1, 0, 0, 0, 0, 0), (0, 0, 5, 0, 0, 0, 0, 0), (1, 1, 3, 0, 0, 0, 0, 0), (1, 0, 1, 0, 0, 0, 0, 0),
)
RELATIONS = ("PROSPECT", "PROSPECT", "COMPETITOR", "PROSPECT", "CUSTOMER", "PROSPECT")
_V = ", ".join(f"({i}, {', '.join(map(str, t))})" for i, t in enumerate(_TOLD))


@register(
    "prospect_assessment",
    f"""WITH t(k, event, responsible, fresh, gap, gap_counter, ticket, ticket_counter, complex) AS (VALUES {_V}),
      f AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey ELSE -1 - c_custkey END AS candidate, (c_custkey * 7 + i * (1 + c_custkey % 5)) % 13 AS k, (c_custkey + i) % 3 = 0 AS validation, (c_custkey + i) % 2 = 0 AS trusted FROM customer, (SELECT unnest([0, 1, 2, 3]) AS i)),
      n AS (SELECT candidate, sum(CASE WHEN event = 1 AND responsible = 1 AND validation THEN 1 ELSE 0 END) AS confirmed, sum(CASE WHEN event = 1 AND (responsible = 1 OR validation) THEN 1 ELSE 0 END) AS answering, sum(event) AS mentions, min(fresh) AS fresh,
        sum(CASE WHEN trusted THEN 1 ELSE 0 END) AS trusted, sum(gap) AS gap, sum(gap_counter) AS gc, sum(ticket) AS ticket, sum(ticket_counter) AS tc, sum(complex) AS complex FROM f JOIN t USING (k) GROUP BY 1),
      a AS (SELECT c_custkey AS candidate, {sql_pick(RELATIONS, "c_custkey")} AS relationship, n.* EXCLUDE (candidate), {list(scoring.FRESHNESS_ORDER)}[coalesce(fresh, 5)] AS freshness FROM customer LEFT JOIN n ON candidate = c_custkey),
      b AS (SELECT *, CASE WHEN fresh < 3 AND confirmed > 0 THEN 'CONFIRMED' WHEN fresh < 3 AND answering > 0 THEN 'STRONG' WHEN mentions > 0 THEN 'WEAK' ELSE 'NONE' END AS connection FROM a),
      c AS (SELECT *, connection IN ('CONFIRMED', 'STRONG') AS live FROM b),
      d AS (SELECT *, CASE WHEN live AND gap > 0 THEN CASE WHEN gc > 0 THEN 'POSSIBLE' ELSE 'STRONG_HYPOTHESIS' END ELSE 'NONE' END AS presence, CASE WHEN live AND ticket > 0 THEN CASE WHEN tc > 0 THEN 'POSSIBLE' ELSE 'STRONG_HYPOTHESIS' END ELSE 'NONE' END AS ticketing,
        CASE WHEN live AND complex > 0 THEN 'STRONG_HYPOTHESIS' ELSE 'NONE' END AS operations FROM c),
      e AS (SELECT *, CASE WHEN presence LIKE 'S%' THEN 'PRESENCE' WHEN ticketing LIKE 'S%' THEN 'TICKETING' WHEN operations LIKE 'S%' THEN 'OPERATIONS' ELSE 'UNKNOWN' END AS entry, relationship = 'PROSPECT' AND live AS account FROM d)
      SELECT candidate, freshness, connection, presence, ticketing, operations, entry, account, CASE WHEN NOT account THEN 'LOW' WHEN presence LIKE 'S%' OR fresh = 1 AND entry <> 'UNKNOWN' AND trusted > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
        CASE WHEN relationship = 'COMPETITOR' OR connection = 'NONE' THEN 'BLOCKED' WHEN relationship <> 'PROSPECT' THEN 'REVIEW_REQUIRED' WHEN account AND entry <> 'UNKNOWN' THEN 'ELIGIBLE' ELSE 'REVIEW_REQUIRED' END AS outreach FROM e""",
)
def prospect_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    each = customer.select(key, F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    facts = each.select(F.when(key % 10 > 0, key).otherwise(-1 - key).alias("candidate"), pick(CLAIMS, key * 7 + F.col("i") * (1 + key % 5)).alias("claim"), ((key + F.col("i")) % 3 == 0).alias("validation"), ((key + F.col("i")) % 2 == 0).alias("trusted"))
    return scoring.assessed(facts, customer.select(key.alias("candidate"), pick(RELATIONS, key).alias("relationship")), "candidate", 2024)


@register(
    "claim_freshness",
    f"WITH t(k, event, responsible, fresh, gap, gc, ticket, tc, complex) AS (VALUES {_V}) SELECT event_id, {list(scoring.FRESHNESS_ORDER)}[fresh] AS freshness FROM events JOIN t ON k = event_id % 13",
)
def claim_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scoring.freshness(pick(CLAIMS, F.col("event_id")), 2024).alias("freshness"))


FRESH = ("ACTIVE_UPCOMING", "HISTORICAL", "RECENT_RECURRING_EVIDENCE", "CANCELLED_DEAD_UNSUPPORTED", "UNKNOWN")
CONNECTIONS = ("CONFIRMED", "NONE", "STRONG", "WEAK")
OUTREACH = ("ELIGIBLE", "REVIEW_REQUIRED", "BLOCKED")
STATUSES = ("REVIEW_REQUIRED", "QUALIFIED", "REJECTED", "REVIEW_REQUIRED")
RELATED = ("PROSPECT", "UNKNOWN", "PROSPECT", "COMPETITOR", "CUSTOMER")


@register(
    "candidate_status",
    f"""WITH c AS (SELECT event_id, {sql_pick(RELATED, "event_id")} AS r, event_id % 31 = 0 AS own, event_id % 17 = 0 AS noise, {sql_pick(FRESH, "event_id // 5")} AS f, {sql_pick(CONNECTIONS, "event_id // 25")} AS n, event_id % 19 = 0 AS unverified, event_id % 3 = 0 AS handoff, {sql_pick(OUTREACH, "event_id // 3")} AS o FROM events)
      SELECT event_id, CASE WHEN own THEN 'REJECTED' WHEN r = 'COMPETITOR' THEN 'BLOCKED' WHEN noise THEN 'REJECTED' WHEN unverified THEN 'REVIEW_REQUIRED' WHEN (f IN ('HISTORICAL', 'CANCELLED_DEAD_UNSUPPORTED') OR n = 'NONE') AND NOT handoff THEN 'REJECTED' WHEN o = 'ELIGIBLE' THEN 'QUALIFIED' ELSE 'REVIEW_REQUIRED' END AS status,
        CASE WHEN own THEN 'FIRST_PARTY_SELF' WHEN r = 'COMPETITOR' THEN 'COMPETITOR_BLOCKED' WHEN r = 'CUSTOMER' THEN 'RELATIONSHIP_NOT_PROSPECT' WHEN {sql_pick(STATUSES, "event_id // 7")} = 'REJECTED' THEN 'STATUS_REJECTED' WHEN NOT handoff THEN 'LANE_MINIMUM_EVIDENCE_MISSING' WHEN n <> 'NONE' THEN 'EVENT_CONNECTION_REQUIRES_ENRICHMENT' ELSE 'UNVERIFIED_ORGANISER_HINT' END AS handoff FROM c""",
)
def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    related, fresh, connection, outreach = pick(RELATED, e), pick(FRESH, F.floor(e / 5)), pick(CONNECTIONS, F.floor(e / 25)), pick(OUTREACH, F.floor(e / 3))
    status = scoring.candidate_status(related, e % 31 == 0, e % 17 == 0, fresh, connection, e % 19 == 0, e % 3 == 0, outreach)
    gate = scoring.handoff_gate(related, e % 31 == 0, pick(STATUSES, F.floor(e / 7)), e % 3 == 0, connection != "NONE")
    return table(spark, sf_dir, "events").select(e, status.alias("status"), gate.alias("handoff"))


SITES = ("What's on at the Hall", "Official venue of the year", "A directory that lists events", "the band website", "News outlet report", "An Instagram account", "Tender for a stage", "About the event", "The company website", "Nothing known")
_KINDS = (*[k for k, _ in scoring.SITE_KINDS], "UNKNOWN")


@register("site_kinds", f"SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'TICKETING_PROVIDER' ELSE {sql_pick(_KINDS, 'event_id')} END AS kind FROM events")
def site_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, scoring.site_kind(pick(SITES, e), e % 23 == 0).alias("kind"))


NAMES = ("Acme Ticketing Solutions", "Harvest Fair", "Town Club", "Event ticketing software Ltd", "Lakeside")
SUMMARIES = ("An organiser", "It uses Eventbrite for its tickets, and provides ticketing services", "They provide event ticketing platform access", "An existing customer of ours", "A strategic partner")
_RELATED = (("COMPETITOR",) * 5, (None, None, "COMPETITOR", "CUSTOMER", "PARTNER"), (None, None, "COMPETITOR", "CUSTOMER", "PARTNER"), ("COMPETITOR",) * 5, (None, None, "COMPETITOR", "CUSTOMER", "PARTNER"))


@register("account_relationships", f"SELECT event_id, coalesce({sql_pick([x for r in _RELATED for x in r], 'event_id')}, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE 'PROSPECT' END) AS relationship FROM events")
def account_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    fit = F.when(e % 4 == 0, F.when(e % 8 == 0, "UNKNOWN")).otherwise("MEDIUM")
    return table(spark, sf_dir, "events").select(e, scoring.relationship(pick(NAMES, F.floor(e / 5)), pick(SUMMARIES, e), fit).alias("relationship"))


@register(
    "phase_rank",
    """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 = 0 THEN 'ENTERPRISE_DEFERRED' WHEN p_partkey % 2 = 0 AND p_size > 25 THEN 'PHASE_ONE_PRIORITY' ELSE 'STANDARD_PRIORITY' END AS phase FROM part)
      SELECT p_partkey, phase, row_number() OVER (PARTITION BY p_brand ORDER BY CASE phase WHEN 'PHASE_ONE_PRIORITY' THEN 100 WHEN 'STANDARD_PRIORITY' THEN 50 ELSE 0 END DESC, p_partkey) AS rank FROM p""",
)
def phase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    territory = F.when(F.col("p_partkey") % 2 == 0, "GB").otherwise("ZA")
    rows = table(spark, sf_dir, "part").withColumn("p", scoring.phase_one(territory, F.col("p_size") % 7 == 0, F.col("p_size") > 25))
    return scoring.stable_rank(rows, "p_brand", F.col("p.score"), "p_partkey").select("p_partkey", F.col("p.phase").alias("phase"), "rank")


TITLES = ("Head of Events", "Venue Manager", "Procurement Lead", "Freelance Producer", "Founder & CEO", "Baker", "Box Office Supervisor", "Operations Director", None, "Commercial Manager", "Audience Development Lead", "Head of Technology", "Programme Manager")
_ROLES = (("event leadership", "LIKELY_BUYER", 100), ("venue operations", "LIKELY_BUYER", 80), ("procurement or supplier management", "INFLUENCER_OR_ROUTE_TO_BUYER", 55), ("freelance event professional", "INFLUENCER_OR_ROUTE_TO_BUYER", 45), ("managing director, founder or owner", "LIKELY_BUYER", 80), (None, "IRRELEVANT", 0),
    ("ticketing or box office", "LIKELY_BUYER", 80), ("event operations", "LIKELY_BUYER", 100), (None, "IRRELEVANT", 0), ("commercial leadership", "LIKELY_BUYER", 80),
    ("marketing or audience growth", "INFLUENCER_OR_ROUTE_TO_BUYER", 55), ("digital, technology or product", "INFLUENCER_OR_ROUTE_TO_BUYER", 55), ("event manager, producer or project manager", "INFLUENCER_OR_ROUTE_TO_BUYER", 55))
DOMAINS = ("hall.org", "mail.hall.org", "other.com", None, "thehall.org")


@register(
    "people_ranking",
    f"""SELECT event_id, {sql_pick([r[0] for r in _ROLES], "event_id")} AS family, {sql_pick([r[1] for r in _ROLES], "event_id")} AS class, CAST({sql_pick([str(r[2]) for r in _ROLES], "event_id")} AS INT) AS score,
      CASE event_id // 10 % 5 WHEN 0 THEN 'DOMAIN_CONFIRMED' WHEN 1 THEN 'DOMAIN_CONFIRMED' WHEN 3 THEN CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'DOMAIN_QUERY_SCOPED' ELSE 'DOMAIN_MISSING' END ELSE 'DOMAIN_CONFLICT' END AS employer FROM events""",
)
def people_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    employer = scoring.employer_outcome(F.lit("hall.org"), pick(DOMAINS, F.floor(e / 10)), e % 3 == 0, e % 2 == 0)
    return table(spark, sf_dir, "events").select(e, scoring.role_ranking(pick(TITLES, e)).alias("r"), employer.alias("employer")).select(e, "r.*", "employer")


@register(
    "contact_status",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey & 1 > 0 AS p, l_partkey & 2 > 0 AS pm, l_partkey & 4 > 0 AS b, l_suppkey & 1 > 0 AS rm, l_suppkey & 2 > 0 AS d, l_orderkey % 3 = 0 AS x, l_orderkey % 5 = 0 AS g, l_orderkey % 2 = 0 AS j FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN p AND pm THEN CASE WHEN b THEN 'BUYER_EMAIL_VERIFIED' ELSE 'ROLE_EMAIL_VERIFIED' END WHEN rm THEN CASE WHEN d THEN 'ROLE_EMAIL_VERIFIED' ELSE 'ORGANISATION_EMAIL_VERIFIED' END WHEN p THEN 'BUYER_IDENTIFIED_NO_ROUTE'
        WHEN x THEN 'OTHER_DIRECT_CONTACT_VERIFIED' WHEN g THEN 'CONTACT_PAGE_ONLY' WHEN j THEN 'THIRD_PARTY_CONTACT_REJECTED' ELSE 'NO_VERIFIED_CONTACT' END AS status FROM f""",
)
def contact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda c, n: F.col(c).bitwiseAND(F.lit(n)) > 0
    o = F.col("l_orderkey")
    status = scoring.contact_status(bit("l_partkey", 1), bit("l_partkey", 2), bit("l_partkey", 4), bit("l_suppkey", 1), bit("l_suppkey", 2), o % 3 == 0, o % 5 == 0, o % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


PLACES = "SELECT l_orderkey AS search, l_linenumber AS n, l_partkey % 3 > 0 AS name_ok, l_orderkey % 4 > 0 AND l_suppkey % 2 > 0 AS locality_ok, l_orderkey % 4 > 0 AS locality_asked, l_partkey % 5 > 1 AS type_ok, CASE l_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS domain_ok, l_quantity < 6 AS closed, l_partkey % 4 > 0 AS brand_ok, l_partkey % 6 = 0 AS brand_same FROM lineitem"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("search"), F.col("l_linenumber").alias("n"), (p % 3 > 0).alias("name_ok"), ((F.col("l_orderkey") % 4 > 0) & (s % 2 > 0)).alias("locality_ok"), (F.col("l_orderkey") % 4 > 0).alias("locality_asked"), (p % 5 > 1).alias("type_ok"), F.when(s % 5 == 0, True).when(s % 5 == 1, False).alias("domain_ok"),
        (F.col("l_quantity") < 6).alias("closed"), (p % 4 > 0).alias("brand_ok"), (p % 6 == 0).alias("brand_same"), (F.col("l_quantity") >= 6).alias("operating"),
    )


@register(
    "place_matches",
    f"""WITH p AS ({PLACES}), o AS (SELECT *, CASE WHEN NOT domain_ok THEN 'CONFLICTING' WHEN coalesce(domain_ok, false) OR name_ok AND (locality_ok OR type_ok OR NOT locality_asked) THEN CASE WHEN closed THEN 'REVIEW_REQUIRED' ELSE 'EXACT_OR_STRONG' END WHEN name_ok OR locality_ok OR type_ok THEN 'REVIEW_REQUIRED' ELSE 'NO_MATCH' END AS own FROM p),
      m AS (SELECT *, own IN ('EXACT_OR_STRONG', 'REVIEW_REQUIRED') AND count(*) FILTER (WHERE own IN ('EXACT_OR_STRONG', 'REVIEW_REQUIRED')) OVER (PARTITION BY search) > 1 AS several FROM o)
      SELECT search, n, CASE WHEN several THEN 'REVIEW_REQUIRED' ELSE own END AS match, concat_ws(',', CASE WHEN NOT domain_ok THEN 'WEBSITE_DOMAIN_CONFLICT' END, CASE WHEN NOT name_ok THEN 'NAME_NOT_ALIGNED' END, CASE WHEN locality_asked AND NOT locality_ok THEN 'LOCALITY_NOT_ALIGNED' END, CASE WHEN closed THEN 'CLOSED_PLACE_COUNTER_EVIDENCE' END, CASE WHEN several THEN 'MULTIPLE_PLAUSIBLE_MATCHES' END) AS reasons FROM m""",
)
def place_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.place_matches(_places(spark, sf_dir), "search").select("search", "n", "match", F.array_join("reasons", ",").alias("reasons"))


@register(
    "place_selection",
    f"""WITH p AS ({PLACES}), s AS (SELECT *, 4 * CAST(name_ok AS INT) + 4 * CAST(brand_same AS INT) + 3 + 2 * CAST(locality_ok AS INT) AS score FROM p WHERE coalesce(domain_ok, true) AND brand_ok AND (locality_ok OR NOT locality_asked) AND type_ok AND NOT closed),
      r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score DESC, n) AS position FROM s) SELECT search, n, score, position FROM r WHERE position <= 2""",
)
def place_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_places(_places(spark, sf_dir), "search", "n").select("search", "n", "score", "position")


@register(
    "registry_outcomes",
    """WITH c AS (SELECT o_custkey * 4 + o_orderkey % 4 AS search, o_orderkey AS company, o_orderkey % 3 = 0 AS exact, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'dissolved' ELSE 'liquidation' END AS status FROM orders),
      a AS (SELECT search, count(*) AS n, count(*) FILTER (WHERE exact) AS e, count(*) FILTER (WHERE exact AND status = 'Active') AS a, bool_or(exact AND status = 'dissolved') AS gone, min(company) FILTER (WHERE exact AND status = 'Active') AS one FROM c GROUP BY 1)
      SELECT q.search, CASE WHEN a = 1 THEN 'REGISTRAR_CONFIRMED' WHEN a > 1 OR e > 1 THEN 'REGISTRAR_AMBIGUOUS' WHEN gone THEN 'REGISTRAR_CONFLICT' WHEN n > 0 THEN 'REGISTRAR_AMBIGUOUS' ELSE 'REGISTRAR_NOT_FOUND' END AS outcome, CASE WHEN a = 1 THEN one END AS company FROM (SELECT c_custkey * 4 + unnest(range(4)) AS search FROM customer) q LEFT JOIN a USING (search)""",
)
def registry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "dissolved").otherwise("liquidation")
    companies = o.select((F.col("o_custkey") * 4 + F.col("o_orderkey") % 4).alias("search"), F.col("o_orderkey").alias("company"), (F.col("o_orderkey") % 3 == 0).alias("exact"), status.alias("status"))
    return scoring.registry_outcomes(table(spark, sf_dir, "customer").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("c_custkey") * 4 + i)).alias("search")), companies, "search")


TIERS = (("id", "ESSENTIALS", 1, 5), ("name", "ESSENTIALS", 1, 5), ("types", "PRO", 2, 17), ("website", "ENTERPRISE", 3, 20), ("reviews", "ATMOSPHERE", 4, 25))
FIELDS = ("id", "name", "types", "website", "unheard", "reviews")


@register(
    "mask_tiers",
    f"""WITH m AS (SELECT c_custkey, unnest([{sql_pick(FIELDS, "c_custkey")}, {sql_pick(FIELDS[:3], "c_custkey // 2")}]) AS f FROM customer)
      SELECT c_custkey, ['ESSENTIALS', 'PRO', 'ENTERPRISE', 'ATMOSPHERE'][max(CASE WHEN f IN ('id', 'name') THEN 1 WHEN f = 'types' THEN 2 WHEN f = 'website' THEN 3 ELSE 4 END)] AS tier, [5, 17, 20, 25][max(CASE WHEN f IN ('id', 'name') THEN 1 WHEN f = 'types' THEN 2 WHEN f = 'website' THEN 3 ELSE 4 END)] AS cost FROM m GROUP BY 1""",
)
def mask_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    masks = table(spark, sf_dir, "customer").select(key, F.array(pick(FIELDS, key), pick(FIELDS[:3], F.floor(key / 2))).alias("fields"))
    return scoring.mask_tiers(masks, spark.createDataFrame(TIERS, "field string, tier string, rank int, cost int"), "c_custkey", "ATMOSPHERE")


CATEGORIES = (*scoring.POLICIES, "RESOURCE_DOWNLOAD", "TEMPLATE_DOWNLOAD", None)
CONSENTS = ("UNKNOWN", "OPTED_IN", "OPTED_OUT", None, "granted", "GRANTED", "WITHDRAWN", "Valid")


@register(
    "communication_policy",
    f"""WITH s AS (SELECT event_id, {sql_pick(CATEGORIES, "event_id")} AS c, coalesce(upper({sql_pick(CONSENTS, "event_id // 9")}) IN ('GRANTED', 'OPTED_IN', 'VALID'), false) AS v FROM events)
      SELECT event_id, coalesce(c IN ('DEMO_REQUEST', 'TALK_TO_SALES', 'PRODUCT_ENQUIRY'), false) AS owner_required, coalesce(c NOT IN ('DEMO_REQUEST', 'TALK_TO_SALES', 'TRIAL_STARTED', 'PRODUCT_ENQUIRY', 'INTERNAL_TEST'), true) AS consent_required, coalesce(c <> 'INTERNAL_TEST', true) AS approval_required,
        CASE WHEN c IN ('DEMO_REQUEST', 'TALK_TO_SALES') THEN 'IMMEDIATE' WHEN c IN ('TRIAL_STARTED', 'PRODUCT_ENQUIRY') THEN 'SAME_DAY' WHEN c = 'NEWSLETTER_SIGNUP' THEN 'NURTURE' WHEN c = 'INTERNAL_TEST' THEN 'NONE' ELSE 'WITHIN_2_DAYS' END AS urgency,
        coalesce(v AND (c IN ('NEWSLETTER_SIGNUP', 'RESOURCE_DOWNLOAD', 'TEMPLATE_DOWNLOAD') OR c IS NULL), false) AS marketing,
        CASE c WHEN 'DEMO_REQUEST' THEN 2 WHEN 'TALK_TO_SALES' THEN 1 WHEN 'TRIAL_STARTED' THEN 1 WHEN 'PRODUCT_ENQUIRY' THEN 1 WHEN 'NEWSLETTER_SIGNUP' THEN CAST(v AS INT) WHEN 'INTERNAL_TEST' THEN 0 ELSE 1 + CAST(v AS INT) END AS n_communications FROM s""",
)
def communication_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    told = table(spark, sf_dir, "events").select(e, scoring.communication_policy(pick(CATEGORIES, e), pick(CONSENTS, F.floor(e / 9))).alias("p")).select(e, "p.*")
    marketing = F.exists("communications", lambda c: c.rlike("^Marketing"))
    return told.select(e, "owner_required", "consent_required", "approval_required", "urgency", marketing.alias("marketing"), F.size("communications").alias("n_communications"))


COUNTRIES = ("za", "United Kingdom", " GB ", "FR", None)
ACTIVITIES = ("RUNS_EVENTS", "SERVICES_EVENT_ORGANISERS", "RUNS_AND_SERVICES", "UNKNOWN")
CLIENTS = ("SCHOOL", "VENUE", "AGENCY", "UNKNOWN", None)
FREQUENCIES = ("RECURRING", "HIGH_FREQUENCY", "ONE_OFF", None)
NEEDS = ("Workforce rosters", "stage production", "catering")


@register(
    "lead_assessment",
    f"""WITH a AS (SELECT event_id, upper(trim({sql_pick(COUNTRIES, "event_id")})) AS c, {sql_pick(ACTIVITIES, "event_id // 5")} AS act, {sql_pick(CLIENTS, "event_id // 3")} AS k, {sql_pick(FREQUENCIES, "event_id // 2")} AS f, event_id % 3 AS need, event_id % 7 > 2 AS prov, event_id % 11 > 0 AS s FROM events),
      b AS (SELECT *, CASE WHEN s AND c = 'ZA' THEN 'ZA' WHEN s AND c IN ('GB', 'UNITED KINGDOM') THEN 'GB' ELSE 'UNKNOWN' END AS territory, act IN ('RUNS_EVENTS', 'RUNS_AND_SERVICES') OR coalesce(k IN ('SCHOOL', 'VENUE'), false) AS d, act IN ('SERVICES_EVENT_ORGANISERS', 'RUNS_AND_SERVICES') AS l FROM a)
      SELECT event_id, territory, CASE WHEN NOT s THEN 'UNKNOWN' WHEN d AND l THEN 'BOTH' WHEN d THEN 'DIRECT' WHEN l THEN 'LOCAL' ELSE 'UNKNOWN' END AS motion,
        concat_ws(',', CASE WHEN territory <> 'UNKNOWN' THEN 'TERRITORY_' || territory END, CASE WHEN s AND k <> 'UNKNOWN' THEN 'CLIENT_TYPE_' || k END, CASE WHEN s AND f IN ('RECURRING', 'HIGH_FREQUENCY') THEN 'MULTIPLE_EVENTS' END, CASE WHEN s AND f = 'HIGH_FREQUENCY' THEN 'HIGH_EVENT_FREQUENCY' END,
          CASE WHEN s AND prov THEN 'USES_EXISTING_TICKETING_PLATFORM' END, CASE WHEN s AND need = 0 THEN 'WORKFORCE_COMPLEXITY' END, CASE WHEN s AND need = 1 THEN 'PRODUCTION_COMPLEXITY' END) AS signals,
        concat_ws(',', CASE WHEN territory = 'UNKNOWN' THEN 'territory_unknown' END, CASE WHEN coalesce(k, 'UNKNOWN') = 'UNKNOWN' THEN 'client_type_unknown' END, CASE WHEN f IS NULL THEN 'event_frequency_unknown' END, CASE WHEN NOT prov THEN 'ticketing_provider_unknown' END,
          CASE WHEN need <> 0 THEN 'workforce_complexity_unknown' END, CASE WHEN need <> 1 THEN 'production_operations_unknown' END, CASE WHEN NOT s THEN 'evidence_missing' END) AS gaps FROM b""",
)
def lead_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    a = scoring.lead_assessment(
        pick(COUNTRIES, e), pick(ACTIVITIES, F.floor(e / 5)), pick(CLIENTS, F.floor(e / 3)), pick(FREQUENCIES, F.floor(e / 2)), F.array(pick(NEEDS, e)), F.when(e % 7 > 2, "x"), e % 11
    )
    return table(spark, sf_dir, "events").select(e, a.alias("a")).select(e, "a.territory", "a.motion", F.array_join("a.signals", ",").alias("signals"), F.array_join("a.gaps", ",").alias("gaps"))
