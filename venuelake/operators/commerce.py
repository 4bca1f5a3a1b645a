"""Commercial tables: prices, playbooks, claims, and the overview of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in which nothing more is due.
CLOSED = ("CONVERTED", "CLOSED", "EXCLUDED")


def price_tiers(cards: DataFrame, key: str, tiers: str) -> DataFrame:
    """(key, events, price): a row a tier of each card, cards being tables of any length."""
    return cards.select(key, F.inline(tiers))


def with_playbook(leads: DataFrame, books: DataFrame) -> DataFrame:
    """Leads with the playbook of their product, territory and motion, or the error that there is none."""
    joined = leads.join(books, ["product", "territory", "motion"], "left")
    return joined.withColumn("error", F.when(F.col("playbook").isNull(), "PLAYBOOK_MISSING"))


def usable_claim(strength: Column, category: Column, comparison: Column, confidence: Column) -> Column:
    """Whether a claim may stand as what sets one apart: only with all four."""
    return (strength == "DEFENSIBLE") & (category == "DEFENSIBLE_DIFFERENTIATOR") & (comparison == "EVIDENCE_BACKED") & (confidence == "HIGH")


def commodity_claims(labels: DataFrame) -> DataFrame:
    return labels.select(F.concat(F.lit("commodity-"), F.replace("label", F.lit(" "), F.lit("-"))).alias("id"), F.col("label").alias("claim"))


def overview(leads: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """One row of counters over leads and over runs, with the latest run; each is one pass, and both rows are joined."""
    real, kind = ~F.coalesce("is_test", F.lit(False)), F.upper(F.coalesce("classification", F.lit("")))
    live = ~F.upper(F.coalesce("stage", F.lit(""))).isin(*CLOSED)
    of_leads = leads.agg(
        F.count_if(real & (kind == "NEEDS_REVIEW")).alias("needs_review"), F.count_if(real & (kind == "GENUINE_PROSPECT")).alias("active_genuine"),
        F.count_if(real & kind.isin("NEEDS_REVIEW", "GENUINE_PROSPECT") & F.upper("intent").isin("HIGH", "VERY_HIGH") & live).alias("high_intent"),
        F.count_if(real & F.coalesce(F.col("follow_up_at") <= as_of, F.lit(False)) & live).alias("follow_up_due"), F.count_if(real & (kind == "EXISTING_CUSTOMER")).alias("existing_customers"), F.count_if(real).alias("leads"),
    )
    status = F.upper("status")
    of_runs = runs.agg(F.count("*").alias("total_runs"), F.count_if(status == "COMPLETED").alias("completed_runs"), F.count_if(status.isin("FAILED", "ERROR")).alias("failed_runs"), F.max_by("run", F.struct("created_at", "run")).alias("latest_run"))
    return of_leads.crossJoin(of_runs)  # one row each
