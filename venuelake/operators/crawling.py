"""Planning crawls and judging them afterwards, from tables of candidates, crawls and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of a page in a plan.
TIER_WEIGHT, STRENGTH_WEIGHT, SERVED_WEIGHT, MOST_DEPTH, LINK_BONUS, ARTICLE_PENALTY = 1000, 10, 4, 6, 2, 30

# Connection failures by pattern of the diagnostic code, in order, with code and category.
FAILURES = (
    ("DNS_NXDOMAIN", "DNS_NXDOMAIN", "TERMINAL"),
    ("ENOTFOUND", "DNS_NOT_FOUND_UNCONFIRMED", "EVIDENCE_HELD"),
    ("EAI_AGAIN|EBUSY", "DNS_TEMPORARY", "RETRYABLE"),
    ("ETIMEDOUT|DiscoveryTimeout", "CONNECTION_TIMEOUT", "RETRYABLE"),
    ("ECONNRESET|ECONNABORTED|EPIPE", "CONNECTION_RESET", "RETRYABLE"),
    ("CERT|TLS|EPROTO", "TLS_CERTIFICATE_FAILURE", "EVIDENCE_HELD"),
    ("BOT_WAF_CHALLENGE", "BOT_WAF_CHALLENGE_SUSPECTED", "EVIDENCE_HELD"),
)
# Answers by status.
STATUSES = {
    404: ("HTTP_404", "TERMINAL"),
    410: ("HTTP_410", "TERMINAL"),
    429: ("HTTP_429_RATE_LIMIT", "RETRYABLE"),
    500: ("HTTP_500", "RETRYABLE"),
    502: ("HTTP_502", "RETRYABLE"),
    503: ("HTTP_503", "RETRYABLE"),
    504: ("HTTP_504", "RETRYABLE"),
    401: ("HTTP_401_AUTH_REQUIRED", "EVIDENCE_HELD"),
    403: ("HTTP_403_ACCESS_UNCERTAIN", "EVIDENCE_HELD"),
}


def merged_plan(candidates: DataFrame, site: str, key: str, first: list[str]) -> DataFrame:
    """One row a page of a site: the dimensions of all its candidates (dims array), their greatest strength, and the columns
    `first` of the earliest by `order`."""
    earliest = [F.min_by(c, "order").alias(c) for c in first]
    dims = F.array_sort(F.array_distinct(F.flatten(F.collect_set("dims"))))
    return candidates.filter(F.size("dims") > 0).groupBy(site, key).agg(dims.alias("dims"), F.max("strength").alias("strength"), F.min("order").alias("order"), *earliest)


def ranked_plan(plan: DataFrame, site: str, open_dims: list[str]) -> DataFrame:
    """Pages that serve an open dimension, with `served`, `score` and `position`: better tiers wait for none, then the score
    decides, then the order of discovery."""
    served = F.size(F.array_intersect("dims", F.array(*map(F.lit, open_dims))))
    score = (
        (4 - F.col("tier")) * TIER_WEIGHT + F.col("strength") * STRENGTH_WEIGHT + F.col("served") * SERVED_WEIGHT
        - F.least("depth", F.lit(MOST_DEPTH)) + F.when(F.col("is_link"), LINK_BONUS).otherwise(0) - F.when(F.col("is_article"), ARTICLE_PENALTY).otherwise(0)
    )
    rows = plan.withColumn("served", served).filter("served > 0").withColumn("score", score)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(site).orderBy("tier", F.desc("score"), "order")))


def with_disposition(crawls: DataFrame) -> DataFrame:
    """Add `code` and `category` to a row a crawl with: excluded boolean, conflict string, blocked array of reasons, failure
    string, message string, status int, entry_is_site and site_reachable boolean, documents long, identity_verified and
    contact_accepted boolean (null: not assessed), redirects long, failure_class string. The first rule that holds decides."""
    blocked = lambda pattern: F.exists(F.coalesce("blocked", F.array()), lambda r: r.rlike(pattern))
    failure, message, status = F.coalesce("failure", F.lit("")), F.coalesce("message", F.lit("")), F.col("status")
    rules: list[tuple[Column, str | Column, str]] = [
        (F.col("excluded"), "HUMAN_CONFIRMED_EXCLUSION", "EVIDENCE_HELD"),
        (F.coalesce("conflict", F.lit("")) != "", "WRONG_PROPERTY_CONFLICT", "EVIDENCE_HELD"),
        (blocked("^ROBOTS_DISALLOW$"), "ROBOTS_EXCLUDED", "EVIDENCE_HELD"),
        (blocked("NON_PUBLIC|BATCH_SCOPE|REDIRECT_(UNSAFE|HTTPS_DOWNGRADE)"), "INVALID_OR_UNSAFE_URL", "EVIDENCE_HELD"),
        (blocked("^REDIRECT_"), "REDIRECT_AUTHORITY_UNVERIFIED", "EVIDENCE_HELD"),
    ]
    said = {"CONNECTION_TIMEOUT": "(?i)request timed out", "TLS_CERTIFICATE_FAILURE": "(?i)certificate|TLS handshake"}
    for pattern, code, category in FAILURES:
        rules.append((failure.rlike(pattern) | (message.rlike(said[code]) if code in said else F.lit(False)), code, category))
    gone_elsewhere = status.isin(404, 410) & ~F.col("entry_is_site") & F.col("site_reachable")
    rules.append((gone_elsewhere, F.concat(F.lit("LINKED_PAGE_HTTP_"), status), "EVIDENCE_HELD"))
    rules += [(status == number, code, category) for number, (code, category) in STATUSES.items()]
    rules.append((status >= 400, F.concat(F.lit("HTTP_"), status), "EVIDENCE_HELD"))
    has_pages = F.col("documents") > 0
    rules += [
        (has_pages & ~F.col("identity_verified"), "NO_VENUE_IDENTITY_EVIDENCE", "EVIDENCE_HELD"),
        (has_pages & ~F.col("contact_accepted"), "NO_USABLE_CONTACT_EVIDENCE", "EVIDENCE_HELD"),
        (has_pages & F.col("identity_verified") & (F.col("redirects") > 0), "OFFICIAL_URL_REDIRECT_VERIFIED", "SUCCESS"),
        (has_pages & F.col("identity_verified"), "WEBSITE_EVIDENCE_FETCHED", "SUCCESS"),
        (has_pages, "SITE_REACHABLE_UNVERIFIED", "EVIDENCE_HELD"),
        (message.rlike("(?i)size limit|byte|budget|render|content.type"), "RETRIEVAL_LIMIT_EVIDENCE_INCOMPLETE", "EVIDENCE_HELD"),
        (F.col("failure_class") == "RETRYABLE", "TECHNICAL_FAILURE_UNCLASSIFIED", "RETRYABLE"),
        (F.lit(True), "TECHNICAL_FAILURE_UNCLASSIFIED", "EVIDENCE_HELD"),
    ]
    chosen = F.coalesce(*[F.when(test, F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(category).alias("category"))) for test, code, category in rules])
    return crawls.withColumn("_d", chosen).withColumn("code", F.col("_d.code")).withColumn("category", F.col("_d.category")).drop("_d")


def capacity_conflicts(facts: DataFrame, venue: str) -> DataFrame:
    """(venue, space, layout, n_counts) where the stated counts differ, between pages or for a named space."""
    groups = facts.groupBy(venue, F.lower("space").alias("space"), F.lower("layout").alias("layout"))
    found = groups.agg(F.countDistinct("capacity").alias("n_counts"), F.countDistinct("url").alias("n_pages"))
    return found.filter((F.col("n_counts") > 1) & ((F.col("n_pages") > 1) | F.col("space").isNotNull())).drop("n_pages")
