"""Actions of operators on leads: guards decide, the row changes, and the audit keeps both images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages that may follow each stage of an opportunity.
PROGRESS = {
    "identified": ("qualified", "nurture", "disqualified"),
    "qualified": ("contacted", "demo_scheduled", "nurture", "lost", "disqualified"),
    "contacted": ("demo_scheduled", "proposal", "nurture", "lost", "disqualified"),
    "demo_scheduled": ("proposal", "nurture", "lost", "disqualified"),
    "proposal": ("converted", "lost", "nurture"),
    "nurture": ("qualified", "lost", "disqualified"),
}
# Actions that move a lead along.
MOVES = ("CHANGE_STAGE", "QUALIFY", "MOVE_TO_NURTURE", "DISQUALIFY", "MARK_CONVERTED", "MARK_CONTACTED")


def may_follow(stage: Column, target: Column) -> Column:
    """Whether an opportunity may go from one stage to the other; false for unknown or missing stages."""
    allowed = F.create_map(*[F.lit(x) for s, targets in PROGRESS.items() for x in (s, f"|{'|'.join(targets)}|")])
    return F.coalesce(F.contains(F.try_element_at(allowed, stage), F.concat(F.lit("|"), F.lower(target), F.lit("|"))), F.lit(False))


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def action_error(action: Column) -> Column:
    """Why an action on a lead is refused, null if it is not: the first guard that fails. The row has the lead's columns and
    the action's own_id, plan, due_at, reason and condition."""
    c, moves = F.col, action.isin(*MOVES)
    unplanned = c("owner_id").isNull() | _blank(c("next_action")) | c("follow_up_at").isNull()
    settled = (c("stage") == "TRIAL_ACTIVE") | (c("lead_classification") == "EXISTING_CUSTOMER")
    guards = [
        (c("hold_reason").isNotNull() & moves, "INCOMING_LEAD_HOLD_ACTIVE"),
        (action.isin("QUALIFY", "MARK_CONTACTED") & (settled | unplanned), "INCOMING_LEAD_OPPORTUNITY_INELIGIBLE"),
        ((action == "MARK_CONVERTED") | (c("product_opportunity_id").isNotNull() & moves), "INCOMING_LEAD_USE_OPPORTUNITY_PROGRESSION"),
        ((action == "SET_WORK_PLAN") & c("new_owner_id").isNull(), "INCOMING_LEAD_OWNER_INVALID"),
        ((action == "SET_WORK_PLAN") & (_blank(c("plan")) | c("due_at").isNull()), "INCOMING_LEAD_WORK_PLAN_REQUIRED"),
        ((action == "HOLD") & _blank(c("reason")), "INCOMING_LEAD_HOLD_REASON_REQUIRED"),
        ((action == "HOLD") & (_blank(c("condition")) | c("due_at").isNull()), "INCOMING_LEAD_HOLD_REVIEW_REQUIRED"),
        ((action == "RELEASE_HOLD") & _blank(c("reason")), "INCOMING_LEAD_REASON_REQUIRED"),
    ]
    return F.coalesce(*[F.when(test, F.lit(error)) for test, error in guards])


def acted(leads: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Leads after a batch of actions, at most one a lead: all leads, with `action`, `error` and the new values of the work
    plan and the hold. Refused actions change nothing; leads without an action stay as they are."""
    rows = leads.join(actions, key, "left").withColumn("error", action_error(F.col("action")))
    done = lambda name: F.coalesce(F.col("error").isNull() & (F.col("action") == name), F.lit(False))
    sets = {
        "owner_id": F.when(done("SET_WORK_PLAN") | done("ASSIGN_OWNER"), F.col("new_owner_id")).otherwise(F.col("owner_id")),
        "next_action": F.when(done("SET_WORK_PLAN"), F.trim(F.left("plan", F.lit(500)))).otherwise(F.col("next_action")),
        "follow_up_at": F.when(done("SET_WORK_PLAN"), F.col("due_at")).otherwise(F.col("follow_up_at")),
        "hold_reason": F.when(done("HOLD"), F.trim(F.left("reason", F.lit(1000)))).when(~done("RELEASE_HOLD"), F.col("hold_reason")),
    }
    return rows.withColumns(sets).select(*leads.columns, "action", "error")
