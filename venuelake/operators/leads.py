"""The lead ledger folded into a projection, and the queue and metrics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intent rank of the submission categories.
RANKS = {"TALK_TO_SALES": 5, "DEMO_REQUEST": 5, "TRIAL_STARTED": 4, "PRODUCT_ENQUIRY": 4, "RESOURCE_DOWNLOAD": 1, "TEMPLATE_DOWNLOAD": 1, "NEWSLETTER": 0}
#: Order of the priorities.
PRIORITY_RANKS = {"VERY_HIGH": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 1}
#: Contact that a consent state allows beside an answer to the request itself.
CONSENT_ALLOWS = {"GRANTED": "MARKETING", "UNKNOWN": "SERVICE_ONLY", "WITHDRAWN": "NONE"}


def lookup(column: Column, table: dict) -> Column:
    out = F.lit(None)
    for key, value in reversed(table.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def once(submissions: DataFrame) -> DataFrame:
    """Idempotent insert: of rows with one (source_system, source_record_id) the first arrival stays."""
    keys = Window.partitionBy("source_system", "source_record_id").orderBy("received_at", "id")
    return submissions.withColumn("__n", F.row_number().over(keys)).filter("__n = 1").drop("__n")


def canonical_key(email: Column, submission: Column, product: Column) -> Column:
    mail = F.lower(F.trim(email))
    return F.concat(F.when(mail != "", mail).otherwise(F.concat(F.lit("submission:"), submission.cast("string"))), F.lit("|"), product)


def partials(submissions: DataFrame) -> DataFrame:
    """What the fold keeps of the events of a key: its first and its last in order of arrival, and a few counts. `merged` puts the
    partials of parts of a ledger together."""
    order, rank = F.struct("received_at", "id"), lookup(F.col("category"), RANKS)
    return submissions.groupBy("canonical_key").agg(
        F.min(order).alias("first_at"), F.min_by("category", order).alias("first_category"), F.max(order).alias("last_at"), F.max_by("category", order).alias("latest_category"), F.count("*").alias("activity_count"),
        F.max(rank).alias("highest_rank"), F.count_if(rank >= 4).alias("high"), F.min("occurred_at").alias("first_activity"), F.max("occurred_at").alias("last_activity"),
    )


def merged(states: DataFrame) -> DataFrame:
    """The partials of each key as one."""
    return states.groupBy("canonical_key").agg(
        F.min("first_at").alias("first_at"), F.min_by("first_category", "first_at").alias("first_category"), F.max("last_at").alias("last_at"), F.max_by("latest_category", "last_at").alias("latest_category"), F.sum("activity_count").alias("activity_count"),
        F.max("highest_rank").alias("highest_rank"), F.sum("high").alias("high"), F.min("first_activity").alias("first_activity"), F.max("last_activity").alias("last_activity"),
    )


def project(submissions: DataFrame) -> DataFrame:
    """One row a canonical key from the ledger (canonical_key, id, category, received_at, occurred_at).

    The fold has a closed form in the first and the last event of arrival and a few counts, so it is one grouped pass,
    combined before its shuffle, at any length of a key's history. Intent and priority: very high from rank 5, high at 4,
    else medium from the third event on, which then is the last event's word alone; of two events the second decides if its
    rank is 4 or more, or, for intent, if it is a newsletter, else the first, which starts low. The stage starts as trial or
    new; a later event of rank 4 makes a new one reviewing.
    """
    return finished(partials(submissions))


def finished(folded: DataFrame) -> DataFrame:
    """Partials to projected leads."""
    ladder = lambda c: F.when(c >= 5, "VERY_HIGH").when(c == 4, "HIGH")
    first, last, n = lookup(F.col("first_category"), RANKS), lookup(F.col("latest_category"), RANKS), F.col("activity_count")
    nurture = lambda c: F.when(c == 0, "NURTURE")
    start = F.coalesce(ladder(first), F.lit("LOW"))
    later_high = F.col("high") - F.when(first >= 4, 1).otherwise(0) > 0
    third = F.when(n >= 3, "MEDIUM")
    return folded.select(
        "canonical_key",
        F.coalesce(ladder(last), third, nurture(last), F.coalesce(ladder(first), nurture(first), F.lit("LOW"))).alias("current_intent"),
        F.coalesce(ladder(last), third, start).alias("priority"),
        "latest_category", "first_category", "highest_rank",
        F.when(F.col("first_category") == "TRIAL_STARTED", "TRIAL_ACTIVE").when(later_high, "REVIEWING").otherwise("NEW").alias("stage"),
        "first_activity", "last_activity", "activity_count",
    )


def issues(lead: dict[str, Column]) -> Column:
    """The data-quality labels of a lead, in fixed order."""
    labels = (
        ("ORGANISATION_UNRESOLVED", lead["organisation"].isNull()),
        ("WEBSITE_MISSING", lead["website"].isNull()),
        ("LOCATION_MISSING", lead["location"].isNull()),
        ("NO_COMMERCIAL_SIGNAL", lead["intent"].isin("LOW", "NURTURE")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in labels]))


def queue(leads: DataFrame, category: str | None = None, stage: str | None = None, size: int = 50, offset: int = 0) -> DataFrame:
    """A page by priority, last activity and key, with the filtered total on each row. The source filter matches the first
    or the latest category. The total is its own aggregate of one row, so the page needs no global window."""
    rows = leads.withColumn("priority_rank", lookup(F.col("priority"), PRIORITY_RANKS))
    if category and category != "ALL":
        rows = rows.filter((F.col("first_category") == category) | (F.col("latest_category") == category))
    if stage and stage != "ALL":
        rows = rows.filter(F.col("stage") == stage)
    total = rows.agg(F.count("*").alias("total_count"))
    page = rows.orderBy(F.desc_nulls_last("priority_rank"), F.desc("last_activity"), F.desc("canonical_key")).offset(offset).limit(min(max(size, 1), 100))
    return page.crossJoin(total)  # one row


def metrics(leads: DataFrame, as_of: Column, stale_days: int = 7) -> DataFrame:
    """One row of counters."""
    stale = F.col("last_activity") < as_of - F.expr(f"interval {stale_days} days")
    return leads.agg(
        F.count("*").alias("leads"),
        F.count_if(F.col("current_intent").isin("VERY_HIGH", "HIGH")).alias("high_intent"),
        F.count_if(F.col("stage") == "REVIEWING").alias("reviewing"),
        F.count_if(F.col("stage") == "TRIAL_ACTIVE").alias("trials"),
        F.count_if(stale).alias("stale"),
        F.sum("activity_count").alias("activities"),
    )


def account_match(leads: DataFrame, accounts: DataFrame) -> DataFrame:
    """RESOLVED, AMBIGUOUS or UNRESOLVED by how many accounts have the lead's normalised name; the account if only one."""
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    counted = accounts.groupBy(name(F.col("account_name")).alias("__name")).agg(F.count("*").alias("__n"), F.min("account_id").alias("__id"))
    joined = leads.withColumn("__name", name(F.col("organisation"))).join(counted, "__name", "left")
    state = F.when(F.col("__n") == 1, "RESOLVED").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return joined.select(*leads.columns, state.alias("identity_state"), F.when(F.col("__n") == 1, F.col("__id")).alias("account_id"))
