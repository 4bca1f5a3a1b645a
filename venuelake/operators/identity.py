"""Whether a site is a place's own: names, locations and domains compared, candidates of searches scored and chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.functions.addresses import registrable_domain
from venuelake.functions.documents import distinctive_words
from venuelake.operators.resolution import canonical_name

#: Kinds of places that stand for one another at the end of a name.
SUFFIXES = ("hall", "venue", "centre", "center", "theatre", "theater", "club", "hotel", "arena", "rooms")
#: Words that lend no initial to an acronym.
SMALL_WORDS = ("the", "of", "and", "at", "in", "on", "a")


def _tokens(name: Column) -> Column:
    return F.filter(F.split(canonical_name(name), " "), lambda t: t != "")


def location_terms(locality: Column, address: Column) -> Column:
    """The names by which a place's location may be told: its locality and aliases of it, and the parts of its address without
    brackets, postcodes and bare numbers."""
    aliases = F.transform(F.split(F.coalesce(locality, F.lit("")), r"(?i)\s*/\s*|\s+or\s+"), canonical_name)
    stripped = F.array(canonical_name(F.coalesce(locality, F.lit(""))), canonical_name(F.regexp_replace(F.coalesce(locality, F.lit("")), r"(?i)\s+region$", "")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(address, F.lit("")), r"\([^)]*\)", " "), r"\b\d{4}\b", " "), r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", " ")
    parts = F.filter(F.transform(F.split(bare, ","), canonical_name), lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\d+$"))
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.concat(stripped, aliases), lambda t: F.length(t) >= 3), parts)))


def name_matches(target: Column, candidate: Column, location: Column) -> Column:
    """Whether a candidate's name is the target's: it has all its words, or all written together; else the target's own words, those
    of its location apart, and some kind of place where the target names one."""
    wanted, held = _tokens(target), _tokens(candidate)
    folded = F.replace(canonical_name(candidate), F.lit(" "), F.lit(""))
    whole = F.replace(canonical_name(target), F.lit(" "), F.lit(""))
    near = F.flatten(F.transform(location, lambda t: F.split(t, " ")))
    own = distinctive_words(target)
    core = F.filter(own, lambda t: ~F.array_contains(near, t))
    needed = F.when(F.size(core) > 0, core).otherwise(own)
    has = lambda t: F.array_contains(held, t) | F.contains(folded, t)
    kinds = F.array(*map(F.lit, SUFFIXES))
    plain = F.filter(wanted, lambda t: ~F.array_contains(kinds, t) & (~F.array_contains(near, t) | (F.size(core) == 0)))
    kind_ok = (F.size(F.array_intersect(wanted, kinds)) == 0) | (F.size(F.array_intersect(held, kinds)) > 0)
    loose = (F.size(own) > 0) & F.forall(needed, has) & (F.size(plain) > 0) & F.forall(plain, has) & kind_ok
    return (F.size(wanted) > 0) & ((F.size(F.array_except(wanted, held)) == 0) | ((F.length(whole) >= 6) & F.contains(folded, whole)) | loose)


def operated(name: Column, host: Column, homepage_names: Column) -> Column:
    """By what a site shows that the place itself runs it, or null: its domain has a word of the name, lies within it, or is its
    acronym, or its home page names it as the site."""
    label = F.regexp_replace(F.regexp_replace(registrable_domain(host), r"\..*$", ""), "[^a-z0-9]", "")
    folded = F.regexp_replace(registrable_domain(host), "[^a-z0-9]", "")
    initials = F.array_join(F.transform(F.filter(_tokens(name), lambda w: ~w.isin(*SMALL_WORDS)), lambda w: F.left(w, F.lit(1))), "")
    return (
        F.when(F.exists(distinctive_words(name), lambda w: (F.length(w) >= 4) & F.contains(folded, w)), "NAME_IN_DOMAIN")
        .when((F.length(label) >= 5) & F.contains(F.replace(canonical_name(name), F.lit(" "), F.lit("")), label), "DOMAIN_IN_NAME")
        .when((F.length(initials) >= 3) & (label == initials), "ACRONYM").when(homepage_names, "HOMEPAGE")
    )


def website_state(rejected_host: Column, postcode_conflict: Column, verified: Column, name_signal: Column, in_scope: Column, generic_alone: Column, signal: Column) -> Column:
    """struct<state, reason> of a website: the first thing that speaks against it, else SELECTED."""
    out = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    return (
        F.when(rejected_host, out("REJECTED", "REDIRECTED_TO_NON_FIRST_PARTY_HOST")).when(postcode_conflict, out("REJECTED", "ADDRESS_POSTCODE_CONFLICT"))
        .when(~verified & name_signal, out("UNVERIFIED", "NAME_ALIGNED_WITHOUT_LOCATION_OR_IDENTITY_PROOF")).when(~verified, out("REJECTED", "NO_SAME_ENTITY_IDENTITY_EVIDENCE"))
        .when(~in_scope, out("UNVERIFIED", "OUTSIDE_ACCEPTED_SITE_SCOPE")).when(generic_alone, out("UNVERIFIED", "GENERIC_NAME_REQUIRES_ADDRESS_CORROBORATION"))
        .when(signal.isNull(), out("UNVERIFIED", "THIRD_PARTY_PAGE_NOT_VENUE_OPERATED")).otherwise(out("SELECTED", "VERIFIED_DIRECT"))
    )


def ranked_sites(found: DataFrame, search: str, pool: int = 5) -> DataFrame:
    """(search, origin, score, position): two points for a domain of the name, one for a title, two less for a page of one event;
    sites of the name's domain if there are any, else home pages; the best result of each origin, the first `pool` by rank."""
    score = F.when(F.col("domain_aligned"), 2).otherwise(0) + F.when(F.col("title_aligned"), 1).otherwise(0) - F.when(F.col("event_path"), 2).otherwise(0)
    scored = found.withColumn("score", score).filter("domain_aligned or title_aligned").filter("domain_aligned or not event_path")
    aligned = F.bool_or("domain_aligned").over(Window.partitionBy(search))
    kept = scored.withColumn("any", aligned).filter(F.when(F.col("any"), F.col("domain_aligned")).otherwise(F.col("homepage")))
    first = kept.groupBy(search, "origin").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(search).orderBy("rank", "origin")))
    return placed.filter(F.col("position") <= pool).select(search, "origin", "score", "position")


def fallback(first: DataFrame, second: DataFrame, search: str, reasons: list[str]) -> DataFrame:
    """Results of the preferred provider, and of the second for searches whose first gave none, or was denied for one of the
    reasons: rows are (search, url, denied), one without a url where there is no result."""
    use_second = first.groupBy(search).agg((F.count("url") == 0).alias("empty"), F.max("denied").alias("denied")).filter((F.col("empty") & F.col("denied").isNull()) | F.col("denied").isin(*reasons)).select(search)
    own = first.filter("url is not null").join(use_second, search, "left_anti").select(search, "url", F.lit("first").alias("provider"))
    return own.unionByName(second.filter("url is not null").join(use_second, search, "left_semi").select(search, "url", F.lit("second").alias("provider")))
