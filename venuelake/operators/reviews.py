"""Decisions of people on prospects and leads, applied as tables: each row to its new state or to why it may not change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inventory actions, each with the status it leads to (None: the status stays) and the decision on record.
INVENTORY_ACTIONS = {"QUALIFY": ("QUALIFIED", "QUALIFIED"), "REJECT": ("REJECTED", "REJECTED"), "BLOCK": ("BLOCKED", "BLOCKED"), "MARK_DUPLICATE": ("DUPLICATE", "DUPLICATED"), "RESTORE": ("REVIEW_REQUIRED", "REOPENED"), "SET_NEXT_ACTION": (None, "NEXT_ACTION_SET")}
#: The longest note and next action.
NOTE_MOST, NEXT_ACTION_MOST = 1000, 500
#: What may be done to many leads at once, and to how many.
BULK_ACTIONS, BULK_MOST = ("ASSIGN_OWNER", "MARK_REVIEWED", "CLASSIFY"), 100
#: States of a promotion that a new import does not touch.
PROTECTED = ("PROMOTED", "REJECTED", "IN_REVIEW")


def decided(candidates: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Candidates (key, status, next_action, approved) joined with the action asked of each (key, action, note, wanted): `error`, or
    the decision on record with the new status and next action. An action may be taken from any status. Blocking an
    approved candidate revokes the approval: `revoked`. A blank note is none; `wanted` is the next action that
    SET_NEXT_ACTION sets, trimmed, and must not be blank or too long. What a request's texts decide is decided before the
    join, so that these texts are not moved unless they are asked for afterwards."""
    next_action = F.trim("wanted")
    sets = F.col("action") == "SET_NEXT_ACTION"
    refused = (
        F.when(~F.coalesce(F.col("action").isin(*INVENTORY_ACTIONS), F.lit(False)), "PROSPECT_REVIEW_ACTION_INVALID").when(F.char_length("note") > NOTE_MOST, "PROSPECT_BLOCK_NOTE_TOO_LONG")
        .when(sets & (F.coalesce(next_action, F.lit("")) == ""), "PROSPECT_NEXT_ACTION_INVALID").when(sets & (F.char_length(next_action) > NEXT_ACTION_MOST), "PROSPECT_NEXT_ACTION_INVALID")
    )
    judged = asked.withColumn("__refused", refused).withColumn("__set", F.when(sets & F.col("__refused").isNull(), next_action))
    joined = judged.join(candidates.hint("merge"), key, "left")  # files of candidates are far smaller than their rows in memory
    error = F.coalesce("__refused", F.when(F.col("status").isNull(), "PROSPECT_NOT_FOUND"))
    target = decision = F.lit(None).cast("string")
    for action, (to, record) in INVENTORY_ACTIONS.items():
        mine = F.col("action") == action
        target = F.when(mine, F.lit(to)).otherwise(target)
        decision = F.when(mine, F.lit(record)).otherwise(decision)
    done = F.col("error").isNull()
    return (
        joined.withColumn("error", error).withColumn("decision", F.when(done, decision)).withColumn("new_status", F.when(done, F.coalesce(target, "status")).otherwise(F.col("status")))
        .withColumn("new_action", F.when(done & sets, F.col("__set")).otherwise(F.col("next_action"))).withColumn("revoked", F.coalesce(done & (F.col("action") == "BLOCK") & F.col("approved"), F.lit(False))).drop("__refused", "__set")
    )


def bulk(rows: DataFrame, requests: DataFrame, request: str, key: str) -> DataFrame:
    """(request, key, error) of bulk requests (request, action, keys): each key of a request, once, or one row with why the whole
    request is refused."""
    keys = F.array_distinct("keys")
    size = F.size(keys)
    whole = F.when((size < 1) | (size > BULK_MOST), "BULK_SIZE").when(~F.col("action").isin(*BULK_ACTIONS), "BULK_ACTION")
    marked = requests.withColumn("__error", whole)
    each = marked.select(request, F.explode(F.when(F.col("__error").isNull(), keys).otherwise(F.array(F.lit(None).cast("long")))).alias(key), "__error")
    known = rows.select(key, F.lit(True).alias("__known"))
    return each.join(known, key, "left").select(request, key, F.coalesce("__error", F.when(F.col("__known").isNull(), "NOT_FOUND")).alias("error"))


def reviewed_once(reviews: DataFrame, key: str, idempotency: str, order: str) -> DataFrame:
    """Reviews with `outcome`: a repeated idempotency key is REPLAYED if it asks the same (`content`), else CONFLICT; others are
    RECORDED, and `current` marks the last recorded one of each key."""
    first = F.first("content").over(Window.partitionBy(idempotency).orderBy(order))
    n = F.row_number().over(Window.partitionBy(idempotency).orderBy(order))
    outcome = F.when(n == 1, "RECORDED").when(F.col("content") == first, "REPLAYED").otherwise("CONFLICT")
    marked = reviews.withColumn("outcome", outcome)
    last = F.max(F.when(F.col("outcome") == "RECORDED", F.col(order))).over(Window.partitionBy(key))
    return marked.withColumn("current", (F.col("outcome") == "RECORDED") & (F.col(order) == last))


def promoted(queue: DataFrame, imports: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """A promotion queue after an import: new keys are PENDING, known ones take the import's columns unless their state is
    protected; `change` says which."""
    q = queue.select(key, F.col("state").alias("__state"), *[F.col(c).alias(f"__{c}") for c in payload])
    both = q.join(imports.select(key, *payload, F.lit(True).alias("__new")), key, "full")
    frozen = F.col("__state").isin(*PROTECTED)
    change = F.when(F.col("__new").isNull(), "KEPT").when(F.col("__state").isNull(), "ADDED").when(frozen, "PROTECTED").otherwise("UPDATED")
    taken = F.col("change").isin("ADDED", "UPDATED")
    marked = both.withColumn("change", change)
    return marked.select(key, F.coalesce("__state", F.lit("PENDING")).alias("state"), *[F.when(taken, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in payload], "change")


def compare_and_set(rows: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, revision, value) after updates (key, revision, value): one that names the row's revision is taken and raises it;
    of several the first by `order`. `stale` counts those that are refused."""
    joined = updates.select(key, F.col("revision").alias("__asked"), F.col(value).alias("__value"), "order").join(rows.select(key, "revision"), key)
    fits = F.col("__asked") == F.col("revision")
    best = joined.groupBy(key).agg(F.min(F.when(fits, F.struct("order", "__value"))).alias("__won"), F.count("*").alias("__n"))
    out = rows.join(best, key, "left")
    won = F.col("__won").isNotNull()
    return out.select(key, F.when(won, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(won, F.col("__won.__value")).otherwise(F.col(value)).alias(value), (F.coalesce("__n", F.lit(0)) - won.cast("long")).alias("stale"))


def test_state(submissions: DataFrame, leads: DataFrame, key: str) -> DataFrame:
    """Leads with `is_test`: whether any of their submissions is one, by its flag, environment or category."""
    test = F.col("flag") | (F.col("environment") != "PRODUCTION") | (F.col("category") == "INTERNAL_TEST")
    any_test = submissions.groupBy(key).agg(F.bool_or(test).alias("is_test"))
    return leads.join(any_test, key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def audited(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, before, after): both images, as JSON, of the rows that a change has altered, for an append-only log."""
    image = lambda d, name: d.select(key, F.to_json(F.struct(*columns)).alias(name))
    return image(before, "before").join(image(after, "after"), key).filter(~F.col("before").eqNullSafe(F.col("after")))


#: What outbound text must not hold: unresolved placeholders, traces of research, claims without support.
PLACEHOLDER = r"(?i)(?:\[\s*(?:your\s+name|name|company|sender|email)\s*\]|\{\{\s*(?:name|sender|company|email)\s*\}\}|<\s*(?:todo|name|sender|company)\s*>|\bTODO\b)"
RESEARCH_TRACE = r"(?i)(?:\[\s*(?:\d+|source|citation|evidence|fact|inference)[^\]]*\]|\b(?:evidence|source)[_-]?id\s*[:#-]?\s*[a-z0-9-]+\b|\b(?:fact|inference)[_-]?\d+\b|\b(?:FACT|INFERENCE)\s*[:·-])"
SUPERLATIVE = r"(?i)\b(?:industry-leading|market-leading|best-in-class|world-class)\b"
URL = r"(?i)(?:https?://|www\.)\S+"


def _approved_urls(text: Column, allowed: Column) -> Column:
    """The text with each address that is allowed, less punctuation at its end, and without the others."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: F.regexp_replace(F.regexp_replace(u, r"[.,;:!?]+$", ""), r"\)$", ""))
    kept = F.transform(found, lambda u: F.when(F.array_contains(allowed, u), u).otherwise(""))
    return F.array_join(F.flatten(F.zip_with(F.split(text, URL), kept, lambda t, u: F.array(t, F.coalesce(u, F.lit(""))))), "")


def sanitised(subject: Column, body: Column, allowed: Column, signature: str) -> Column:
    """struct<subject, body, error>: outbound text with the addresses of `allowed` only and its signature. Text with a placeholder,
    a trace of research or an unsupported claim is refused, not mended: then both are null and `error` says why. A null
    subject or body is empty."""
    parts = [F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))]
    holds = lambda pattern: parts[0].rlike(pattern) | parts[1].rlike(pattern)
    error = F.when(holds(PLACEHOLDER) | holds(RESEARCH_TRACE), "INTERNAL_EVIDENCE_OR_PLACEHOLDER").when(holds(SUPERLATIVE), "UNSUPPORTED_CLAIM")
    clean_subject = F.trim(F.regexp_replace(_approved_urls(parts[0], allowed), r"\s{2,}", " "))
    clean_body = F.regexp_replace(F.regexp_replace(_approved_urls(parts[1], allowed), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    signed = F.when(clean_body.rlike(f"(?i)best regards,?\\s*{signature}"), clean_body).otherwise(F.concat(clean_body, F.lit(f"\n\nBest regards,\n{signature}")))
    return F.struct(F.when(error.isNull(), clean_subject).alias("subject"), F.when(error.isNull(), signed).alias("body"), error.alias("error"))
