"""Smaller rules over links, runs, people, evidence and work, each a column or one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.functions.addresses import CONTACT_WORDS, IDENTITY_WORDS, page_words, path
from venuelake.operators.resolution import canonical_name

#: Words of links, by the dimension that a page of theirs serves.
SPACE_WORDS = r"venue[- ]hire|private[- ]hire|hire|spaces?|rooms?|halls?|suites?|weddings?|conferences?|functions?|meetings?"
CAPACITY_WORDS = r"capacit\w*|seating|layouts?|floor[- ]?plans?|spec(?:ification)?s?"
PRACTICAL_WORDS = r"accessib\w*|parking|getting[- ]here|directions|facilit\w*|amenit\w*"
IMAGE_WORDS = r"galler(?:y|ies)|photos?|images|pictures"
#: Words of navigation, which name no place.
NAVIGATION = frozenset("the and at one hotel hotels bar bars venue venues restaurant restaurants royal our locations location contact events hire bookings nav".split())
#: Categories of evidence that each lens takes.
LENS_CATEGORIES = {"PRESENCE": ("WEBSITE", "DISCOVERY"), "TICKETING": ("PROVIDER_FRAGMENTATION", "REGISTRATION"), "OPERATIONS": ("COMPLEXITY", "WORKFORCE")}
PDF_LIMIT, PDF_RELEVANT = 20_000_000, 15_000_000


def link_assessment(url: Column, label: Column) -> Column:
    """struct<dims, strength, reason> of a link: the dimensions its words speak of, with their reasons; strength by navigation, reasons
    and depth, at least 1. Null where it speaks of none."""
    text, nav, pdf = page_words(url, label), F.coalesce(label, F.lit("")).rlike(r"(?i)\bnav\b"), path(url).rlike(r"(?i)\.pdf$")
    has = lambda words: text.rlike(rf"(?i)\b(?:{words})\b")
    told = (("contact-route", "CONTACT", has(CONTACT_WORDS)), ("space-or-hire", "SPACES", has(SPACE_WORDS)), ("capacity-or-specification", "CAPACITY", has(CAPACITY_WORDS) | pdf), ("practical-detail", "FACILITIES", has(PRACTICAL_WORDS)), ("gallery", "IMAGES", has(IMAGE_WORDS)), ("venue-character", "IDENTITY", has(IDENTITY_WORDS)))
    dims = F.array_compact(F.array(*[F.when(t, d) for _, d, t in told]))
    reasons = F.array_compact(F.array(F.when(nav, "primary-navigation"), *[F.when(t, r) for r, _, t in told]))
    depth = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    strength = F.when(nav, 4).otherwise(0) + F.least(F.size(reasons), F.lit(4)) * 2 + F.when(pdf, 3).otherwise(0) - F.least(depth, F.lit(4))
    return F.when(F.size(dims) > 0, F.struct(F.array_join(dims, "+").alias("dims"), F.greatest(strength, F.lit(1)).alias("strength"), F.array_join(reasons, "+").alias("reason")))


def property_strength(name: Column, host: Column, url: Column, label: Column) -> Column:
    """How well a link on a group's site names a place: 6 and its matching words, those of navigation and of the host apart; 0 for
    news and shops."""
    words = F.array_distinct(F.filter(F.split(canonical_name(name), " "), lambda w: ((F.length(w) >= 3) | w.rlike(r"\d")) & ~w.isin(*sorted(NAVIGATION)) & ~F.contains(F.regexp_replace(host, "[^a-z0-9]", ""), w)))
    found = F.split(canonical_name(page_words(url, label)), " ")
    n = F.size(F.array_intersect(words, found))
    off = path(url).rlike(r"(?i)/(?:blogs?|news|press|offers?|products?|collections|shop)(?:/|$)")
    return F.when(off | (n == 0), 0).otherwise(6 + n)


def run_counts(candidates: DataFrame, run: str) -> DataFrame:
    """(run, found, resolved, unresolved, enriched, advanced, qualified, review, rejected, contactable): what a run came to."""
    s = F.col("status")
    return candidates.groupBy(run).agg(
        F.count("*").alias("found"), F.count_if(F.col("resolution") == "RESOLVED").alias("resolved"), F.count_if(F.col("resolution") == "UNRESOLVED").alias("unresolved"), F.count_if("enriched").alias("enriched"), F.count_if("advanced").alias("advanced"),
        F.count_if(s == "QUALIFIED").alias("qualified"), F.count_if(s == "REVIEW_REQUIRED").alias("review"), F.count_if(s.isin("BLOCKED", "REJECTED")).alias("rejected"), F.count_if("contactable").alias("contactable"),
    )


def work_class(country_ok: Column, quarantined: Column, gaps: Column, cached: Column, url_ok: Column, next_at: Column, now: Column) -> Column:
    """What becomes of an item of work before batches are chosen; null for one without gaps."""
    return (
        F.when(~country_ok | quarantined, "QUARANTINED").when(gaps == 0, None).when(cached, "CACHE").when(~url_ok, "WEBSITE_RESOLUTION").when(next_at > now, "DEFERRED").otherwise("SELECTABLE")
    )


def fetch_plan(requested: Column, fresh: Column, bundles: dict[str, Sequence[str]], tier: Column) -> Column:
    """struct<decision, fields, hit>: nothing to fetch if all requested fields are fresh, else the bundle of the tier that the missing
    ones need, or these with the id."""
    missing = F.array_except(requested, fresh)
    fields = F.array_distinct(F.concat(F.array(F.lit("id")), missing))
    for name, bundle in bundles.items():
        fields = F.when(tier == name, F.array(*map(F.lit, bundle))).otherwise(fields)
    known = F.size(F.array_intersect(requested, fresh)) > 0
    return F.when(F.size(missing) == 0, F.struct(F.lit("REUSE").alias("decision"), F.lit("").alias("fields"), F.lit("FULL_HIT").alias("hit"))).otherwise(
        F.struct(F.lit("FETCH").alias("decision"), F.array_join(fields, ",").alias("fields"), F.when(known, "PARTIAL_HIT").otherwise("MISS").alias("hit"))
    )


def pdf_ceiling(relevant: Column, generic: Column) -> Column:
    """How many bytes of a PDF are read: the generic bound, more for a relevant one, never over the format's."""
    base = F.least(F.lit(PDF_LIMIT), generic)
    return F.when(relevant.isNull(), base).otherwise(F.least(F.lit(PDF_LIMIT), F.greatest(base, F.least(relevant, F.lit(PDF_RELEVANT)))))


def valid_evidence(lens: Column, category: Column, confidence: Column, url: Column) -> Column:
    """Whether a piece of commercial evidence fits its lens, with a known confidence and a web address."""
    fits = F.lit(False)
    for name, categories in LENS_CATEGORIES.items():
        fits = F.when(lens == name, category.isin(*categories)).otherwise(fits)
    return F.coalesce(fits & confidence.isin("LOW", "MEDIUM", "HIGH") & url.rlike(r"^https?://[^/\s]+"), F.lit(False))


def person_signal(role: Column, recent: Column) -> Column:
    """What a person's sourced role makes of them; nothing without recent activity."""
    return (
        F.when(~recent, "ACTIVITY_UNVERIFIED").when(role.rlike(r"(?i)\b(?:freelance|independent|contract)\b"), "FREELANCE_EVENT_CONNECTOR")
        .when(role.rlike(r"(?i)\b(?:director|head|manager|owner|founder)\b"), "DIRECT_BUYER_CANDIDATE").otherwise("ROUTE_TO_BUYER")
    )


def resource_offer(entry: Column, claims: Column) -> Column:
    """The resource that goes with an entry, by what its claims speak of."""
    text = F.lower(claims)
    return (
        F.when(entry == "PRESENCE", F.when(text.contains("festival"), "marketing:festival").otherwise("marketing")).when(entry == "TICKETING", F.when(text.rlike("promoter|concert|festival|live music"), "ticketing:live-event").otherwise("ticketing"))
        .when(entry == "OPERATIONS", F.when(text.contains("festival"), "festival-operations").when(text.rlike("conference|university|symposium|congress"), "conference-operations").otherwise("operations")).otherwise("centre")
    )


def valid_scopes(entries: DataFrame, scope: str, most: int = 11) -> DataFrame:
    """(scope, valid): a recovery's entries are 1 to `most`, each of its own, of a known source, with the count its mode asks for."""
    fresh, count = F.col("mode") == "UNRESERVED", F.col("prior")
    good = F.coalesce(F.col("source_known") & F.when(fresh, count == 0).otherwise((F.col("mode") == "RETRYABLE") & count.between(1, 6)), F.lit(False))
    return entries.groupBy(scope).agg((F.count("*").between(1, most) & (F.count_distinct("queue") == F.count("*")) & F.bool_and(good)).alias("valid"))


def leading_links(links: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """(key, url, position): for each pattern in turn the best link of a page that it fits leads, then all others by score; a link leads
    once, for the first pattern that takes it."""
    order = [F.desc("score"), F.asc("url")]
    rest, lead = links.withColumn("__rank", F.lit(len(patterns))), None
    for i, pattern in enumerate(patterns.values()):
        mine = rest.filter(F.col("url").rlike(pattern)).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("n = 1").drop("n").withColumn("__rank", F.lit(i))
        lead = mine if lead is None else lead.unionByName(mine)
        rest = rest.join(mine.select(key, "url"), [key, "url"], "left_anti")
    whole = rest if lead is None else lead.unionByName(rest)
    return whole.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__rank", *order))).select(key, "url", "position")
