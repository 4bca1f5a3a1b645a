"""Scores and rules over prospects and leads: what facts tell of a candidate, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of claims, by what they tell.
EVENT_WORDS = r"(?i)\b(?:festival|conference|exhibition|concert|event|expo|show)s?\b"
RESPONSIBLE_WORDS = r"(?i)\b(?:organis(?:es|ed|er)|organiz(?:es|ed|er)|hosts?|presents?|runs|produces)\b"
GAP_WORDS = r"(?i)\b(?:no (?:official )?website|outdated website|fragmented presence|social[- ]only)\b"
STRONG_PRESENCE = r"(?i)\b(?:mature|coherent|strong)\b.{0,80}\b(?:owned|official|event website|digital presence)\b"
TICKET_WORDS = r"(?i)\b(?:manual (?:registration|reconciliation|ticket)|box office|settlement|reconciliation|paid (?:tickets?|registration)|registration)\b"
STRONG_TICKETS = r"(?i)\b(?:established|mature|integrated|coherent)\b.{0,100}\b(?:ticketing|registration|admission|checkout|system)\b"
COMPLEX_WORDS = r"(?i)\b(?:multi-day|multi-stage|multiple venues?|multiple locations?|concurrent|simultaneous|exhibitors?|vendors?|workforce|volunteers?|accreditation)\b"
DEAD_WORDS = r"(?i)\b(?:cancelled|canceled|defunct|no longer operating)\b"
COMING_WORDS = r"(?i)\b(?:upcoming|next edition|tickets? on sale|this year|current|announced)\b"
RECURRING_WORDS = r"(?i)\b(?:annual|recurring|returns?|returning|edition)\b"
PAST_WORDS = r"(?i)\b(?:historic|historical|archive|archived|took place|was held)\b"
#: Kinds of sites, the first whose words a claim has.
SITE_KINDS = (
    ("VENUE_CALENDAR", r"(?i)\b(?:venue calendar|what's on at|what.s on at|events at the venue)\b"),
    ("VENUE_OFFICIAL", r"(?i)\b(?:official venue|venue website|venue operator|the venue presents)\b"),
    ("EVENT_LISTING_DIRECTORY", r"(?i)\b(?:directory|event listing|lists? events|calendar of events|events from multiple|multiple unrelated organisers)\b"),
    ("ARTIST_OFFICIAL", r"(?i)\b(?:official artist|artist website|band website|performer website)\b"),
    ("NEWS_EDITORIAL", r"(?i)\b(?:news report|editorial|journalist|press article|news outlet)\b"),
    ("SOCIAL_COMMUNITY", r"(?i)\b(?:social page|community page|facebook event|instagram|social media)\b"),
    ("INSTITUTIONAL_PROCUREMENT", r"(?i)\b(?:institutional procurement|procurement notice|tender|seeking an? (?:promoter|operator)|appointed event operator)\b"),
    ("EVENT_OFFICIAL", r"(?i)\b(?:official event website|official event site|event domain|event.s own website|about the event|event contact)\b"),
    ("ORGANISATION_OFFICIAL", r"(?i)\b(?:official organisation|official organization|company website|organiser.s website|organisation.s website|organisation official|organizer.s website)\b"),
)
#: Freshness, the strongest first, and titles of people by role family.
FRESHNESS_ORDER = ("ACTIVE_UPCOMING", "RECENT_RECURRING_EVIDENCE", "HISTORICAL", "CANCELLED_DEAD_UNSUPPORTED", "UNKNOWN")
ROLE_FAMILIES = (
    ("event leadership", ("event director", "head of events", "director of events", "event portfolio director", "organiser", "organizer")),
    ("event operations", ("event operations", "operations director", "operations manager", "head of operations", "event producer")),
    ("venue operations", ("venue director", "venue manager", "venue operations", "general manager")),
    ("commercial leadership", ("commercial director", "commercial manager", "revenue director", "business development")),
    ("ticketing or box office", ("ticketing", "box office", "registration manager", "admissions manager")),
    ("marketing or audience growth", ("marketing director", "marketing manager", "audience development", "audience growth")),
    ("digital, technology or product", ("digital director", "digital manager", "technology director", "technology manager", "product director", "product manager", "head of digital", "head of technology")),
    ("procurement or supplier management", ("procurement", "supplier manager", "vendor manager", "purchasing manager")),
    ("managing director, founder or owner", ("managing director", "founder", "owner", "chief executive officer", "ceo")),
    ("event manager, producer or project manager", ("event manager", "event producer", "project manager", "programme manager", "program manager")),
    ("freelance event professional", ("freelance event", "freelance producer", "independent event")),
)
BUYERS = ("event leadership", "event operations", "venue operations", "commercial leadership", "ticketing or box office", "managing director, founder or owner")
#: What may be done for a submission, by category and consent.
PRODUCT_CATEGORIES = ("DEMO_REQUEST", "TALK_TO_SALES", "TRIAL_STARTED", "PRODUCT_ENQUIRY")


def freshness(claim: Column, year: int) -> Column:
    """What a claim tells of an event's time, years in it against `year`."""
    years = F.transform(F.regexp_extract_all(claim, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int"))
    return (
        F.when(claim.rlike(DEAD_WORDS), "CANCELLED_DEAD_UNSUPPORTED").when(claim.rlike(COMING_WORDS) | F.exists(years, lambda y: y >= year), "ACTIVE_UPCOMING")
        .when(claim.rlike(RECURRING_WORDS), "RECENT_RECURRING_EVIDENCE").when(claim.rlike(PAST_WORDS) | F.exists(years, lambda y: y < year), "HISTORICAL").otherwise("UNKNOWN")
    )


def assessed(facts: DataFrame, candidates: DataFrame, key: str, year: int) -> DataFrame:
    """Candidates (key, relationship) with what their facts (key, claim, validation, trusted) come to.

    One grouped pass counts the facts that support and counter each of three lenses (presence, ticketing, operations). A lens
    counts only for a current event that the candidate answers for: a STRONG_HYPOTHESIS without counter-evidence, else POSSIBLE.
    The first strong lens is the entry; priority and outreach follow from these.
    """
    c = F.col("claim")
    event, responsible = c.rlike(EVENT_WORDS), c.rlike(RESPONSIBLE_WORDS)
    fresh = F.array_position(F.array(*map(F.lit, FRESHNESS_ORDER)), freshness(c, year))
    counts = facts.groupBy(key).agg(
        F.count_if(event & responsible & F.col("validation")).alias("confirmed"), F.count_if(event & (responsible | F.col("validation"))).alias("answering"), F.count_if(event).alias("mentions"),
        F.min(fresh).alias("fresh"), F.count_if("trusted").alias("trusted"), F.count_if(c.rlike(GAP_WORDS)).alias("gap"), F.count_if(c.rlike(STRONG_PRESENCE)).alias("gap_counter"),
        F.count_if(c.rlike(TICKET_WORDS)).alias("ticket"), F.count_if(c.rlike(STRONG_TICKETS)).alias("ticket_counter"), F.count_if(c.rlike(COMPLEX_WORDS)).alias("complex"),
    )
    zero = {n: F.coalesce(n, F.lit(0)) for n in counts.columns if n not in (key, "fresh")}
    d = candidates.join(counts, key, "left").withColumns(zero).withColumn("freshness", F.element_at(F.array(*map(F.lit, FRESHNESS_ORDER)), F.coalesce("fresh", F.lit(len(FRESHNESS_ORDER))).cast("int")))
    current = F.col("freshness").isin("ACTIVE_UPCOMING", "RECENT_RECURRING_EVIDENCE")
    connection = F.when((F.col("confirmed") > 0) & current, "CONFIRMED").when((F.col("answering") > 0) & current, "STRONG").when(F.col("mentions") > 0, "WEAK").otherwise("NONE")
    d = d.withColumn("connection", connection).withColumn("eligible", F.col("connection").isin("CONFIRMED", "STRONG"))
    lens = lambda n, counter: F.when(F.col("eligible") & (F.col(n) > 0), F.when(counter > 0, "POSSIBLE").otherwise("STRONG_HYPOTHESIS")).otherwise("NONE")
    d = d.withColumn("presence", lens("gap", F.col("gap_counter"))).withColumn("ticketing", lens("ticket", F.col("ticket_counter"))).withColumn("operations", lens("complex", F.lit(0)))
    entry = F.when(F.col("presence") == "STRONG_HYPOTHESIS", "PRESENCE").when(F.col("ticketing") == "STRONG_HYPOTHESIS", "TICKETING").when(F.col("operations") == "STRONG_HYPOTHESIS", "OPERATIONS").otherwise("UNKNOWN")
    d = d.withColumn("entry", entry).withColumn("account", (F.col("relationship") == "PROSPECT") & F.col("eligible"))
    priority = F.when(~F.col("account"), "LOW").when((F.col("presence") == "STRONG_HYPOTHESIS") | ((F.col("freshness") == "ACTIVE_UPCOMING") & (F.col("entry") != "UNKNOWN") & (F.col("trusted") > 1)), "HIGH").otherwise("MEDIUM")
    outreach = (
        F.when((F.col("relationship") == "COMPETITOR") | (F.col("connection") == "NONE"), "BLOCKED").when(F.col("relationship") != "PROSPECT", "REVIEW_REQUIRED")
        .when(F.col("account") & (F.col("entry") != "UNKNOWN"), "ELIGIBLE").otherwise("REVIEW_REQUIRED")
    )
    return d.withColumn("priority", priority).withColumn("outreach", outreach).select(key, "freshness", "connection", "presence", "ticketing", "operations", "entry", "account", "priority", "outreach")


def candidate_status(relationship: Column, first_party: Column, provider_noise: Column, fresh: Column, connection: Column, unverified: Column, handoff: Column, outreach: Column) -> Column:
    """A candidate's status, by the first rule that holds; one without a live event is rejected unless it is handed to identity
    review."""
    dead = fresh.isin("HISTORICAL", "CANCELLED_DEAD_UNSUPPORTED") | (connection == "NONE")
    return (
        F.when(first_party, "REJECTED").when(relationship == "COMPETITOR", "BLOCKED").when(provider_noise, "REJECTED").when(unverified, "REVIEW_REQUIRED").when(dead & ~handoff, "REJECTED")
        .when(outreach == "ELIGIBLE", "QUALIFIED").otherwise("REVIEW_REQUIRED")
    )


def handoff_gate(relationship: Column, first_party: Column, status: Column, evidence: Column, connected: Column) -> Column:
    """Why a candidate may or may not go to identity review: the first failing rule, or what it goes for."""
    return (
        F.when(first_party, "FIRST_PARTY_SELF").when(relationship == "COMPETITOR", "COMPETITOR_BLOCKED").when(~relationship.isin("PROSPECT", "UNKNOWN"), "RELATIONSHIP_NOT_PROSPECT")
        .when(~status.isin("REVIEW_REQUIRED", "QUALIFIED"), F.concat(F.lit("STATUS_"), status)).when(~evidence, "LANE_MINIMUM_EVIDENCE_MISSING")
        .when(connected, "EVENT_CONNECTION_REQUIRES_ENRICHMENT").otherwise("UNVERIFIED_ORGANISER_HINT")
    )


def site_kind(claim: Column, provider_host: Column) -> Column:
    out = F.when(provider_host, "TICKETING_PROVIDER")
    for name, pattern in SITE_KINDS:
        out = out.when(claim.rlike(pattern), name)
    return out.otherwise("UNKNOWN")


def relationship(name_and_site: Column, summary: Column, fit: Column) -> Column:
    """A competitor sells ticketing itself, one that only uses another's does not; customers and partners say so."""
    uses = F.lower(summary).rlike(r"\b(?:uses?|using|runs? on|powered by|tickets? (?:sold|available) (?:through|via))\b.{0,60}\b(?:ticketmaster|eventbrite)\b")
    sells = r"\b(?:event )?ticketing\s+(?:software|technology|platform|services?|provider|company|solutions?)\b|\b(?:box office|ticket sales)\s+platform\b"
    whole = F.lower(F.concat_ws(" ", name_and_site, summary))
    return (
        F.when(F.lower(name_and_site).rlike(sells) | (~uses & F.lower(summary).rlike(rf"\bprovides? (?:{sells})")), "COMPETITOR").when(whole.rlike("existing customer|current customer"), "CUSTOMER")
        .when(whole.rlike("current partner|strategic partner|partner organisation"), "PARTNER").when(fit.isNull() | (fit == "UNKNOWN"), "UNKNOWN").otherwise("PROSPECT")
    )


def phase_one(territory: Column, enterprise: Column, independent: Column) -> Column:
    """struct<phase, score>: groups wait, small British organisers come first."""
    of = lambda name, score: F.struct(F.lit(name).alias("phase"), F.lit(score).alias("score"))
    return F.when(enterprise, of("ENTERPRISE_DEFERRED", 0)).when((territory == "GB") & independent, of("PHASE_ONE_PRIORITY", 100)).otherwise(of("STANDARD_PRIORITY", 50))


def stable_rank(rows: DataFrame, scope: str, score: Column, order: str) -> DataFrame:
    """Rows with `rank` in their scope, by score, then as they came."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(score.desc(), order)))


def role_family(title: Column) -> Column:
    """The first family that has a word of the title; null if none has."""
    value, out = F.lower(title), None
    for family, words in ROLE_FAMILIES:
        test = value.rlike("|".join(words))
        out = F.when(test, family) if out is None else out.when(test, family)
    return out


def role_ranking(title: Column) -> Column:
    """struct<family, class, score>: likely buyers, then those who lead to them."""
    family, value = role_family(title), F.lower(title)
    kind = F.when(family.isNull(), "IRRELEVANT").when(family.isin(*BUYERS), "LIKELY_BUYER").otherwise("INFLUENCER_OR_ROUTE_TO_BUYER")
    senior = value.rlike("director|head")
    score = F.when(family.isNull(), 0).when(family.isin(*BUYERS), F.when(senior, 100).otherwise(80)).when(family == "freelance event professional", 45).otherwise(55)
    return F.struct(family.alias("family"), kind.alias("class"), score.alias("score"))


def employer_outcome(expected: Column, actual: Column, scoped: Column, same_name: Column) -> Column:
    """Whether a person's employer is the organisation: by its domain or a part of it, or by name in a search kept to it."""
    same = (expected == actual) | F.endswith(actual, F.concat(F.lit("."), expected))
    return F.when(actual.isNotNull(), F.when(same, "DOMAIN_CONFIRMED").otherwise("DOMAIN_CONFLICT")).when(scoped & same_name & expected.isNotNull(), "DOMAIN_QUERY_SCOPED").otherwise("DOMAIN_MISSING")


def contact_status(person: Column, person_mail: Column, buyer: Column, route_mail: Column, department: Column, route_direct: Column, route_page: Column, rejected: Column) -> Column:
    """The best way to reach an organisation that research has found."""
    return (
        F.when(person & person_mail, F.when(buyer, "BUYER_EMAIL_VERIFIED").otherwise("ROLE_EMAIL_VERIFIED")).when(route_mail, F.when(department, "ROLE_EMAIL_VERIFIED").otherwise("ORGANISATION_EMAIL_VERIFIED"))
        .when(person, "BUYER_IDENTIFIED_NO_ROUTE").when(route_direct, "OTHER_DIRECT_CONTACT_VERIFIED").when(route_page, "CONTACT_PAGE_ONLY").when(rejected, "THIRD_PARTY_CONTACT_REJECTED").otherwise("NO_VERIFIED_CONTACT")
    )


def place_matches(found: DataFrame, search: str) -> DataFrame:
    """Places with `match` and `reasons` from what agrees (name, locality, type, domain; domain null if unknown). Where a search asks
    for no locality, the name alone is strong. Several plausible places of a search are all for review, and so is a closed one."""
    name, near, kind, domain = (F.col(c) for c in ("name_ok", "locality_ok", "type_ok", "domain_ok"))
    strong = F.coalesce(domain, F.lit(False)) | name & (near | kind | ~F.col("locality_asked"))
    own = F.when(~domain, "CONFLICTING").when(strong, "EXACT_OR_STRONG").when(name | near | kind, "REVIEW_REQUIRED").otherwise("NO_MATCH")
    own = F.when(F.col("closed") & (own == "EXACT_OR_STRONG"), "REVIEW_REQUIRED").otherwise(own)
    plausible = F.col("own").isin("EXACT_OR_STRONG", "REVIEW_REQUIRED")
    several = F.count_if(plausible).over(Window.partitionBy(search)) > 1
    told = (
        ("WEBSITE_DOMAIN_CONFLICT", ~domain), ("NAME_NOT_ALIGNED", ~name), ("LOCALITY_NOT_ALIGNED", F.col("locality_asked") & ~near),
        ("CLOSED_PLACE_COUNTER_EVIDENCE", F.col("closed")), ("MULTIPLE_PLAUSIBLE_MATCHES", plausible & F.col("several")),
    )
    judged = found.withColumn("own", own).withColumn("several", several)
    return judged.withColumn("match", F.when(plausible & F.col("several"), "REVIEW_REQUIRED").otherwise(F.col("own"))).withColumn("reasons", F.array_compact(F.array(*[F.when(t, n) for n, t in told]))).drop("own", "several")


def best_places(found: DataFrame, search: str, order: str, n: int = 2) -> DataFrame:
    """The `n` best places of a search that nothing speaks against, by points for name, brand, locality, type and operation."""
    score = sum((F.when(F.col(c), p).otherwise(0) for c, p in (("name_ok", 4), ("brand_same", 4), ("locality_ok", 2), ("type_ok", 2), ("operating", 1))), F.lit(0))
    sound = F.coalesce(F.col("domain_ok"), F.lit(True)) & F.col("brand_ok") & (F.col("locality_ok") | ~F.col("locality_asked")) & F.col("type_ok") & F.col("operating")
    ranked = found.filter(sound).withColumn("score", score).withColumn("position", F.row_number().over(Window.partitionBy(search).orderBy(F.desc("score"), order)))
    return ranked.filter(F.col("position") <= n)


def registry_outcomes(searches: DataFrame, companies: DataFrame, search: str) -> DataFrame:
    """(search, outcome, company): confirmed by one exact active company; two of either kind are ambiguous, a dissolved one
    conflicts, other results are ambiguous."""
    exact, active = F.col("exact"), F.col("exact") & (F.lower("status") == "active")
    seen = companies.groupBy(search).agg(F.count("*").alias("n"), F.count_if(exact).alias("e"), F.count_if(active).alias("a"), F.bool_or(exact & (F.lower("status") == "dissolved")).alias("gone"), F.min(F.when(active, F.col("company"))).alias("one"))
    outcome = (
        F.when(F.col("a") == 1, "REGISTRAR_CONFIRMED").when((F.col("a") > 1) | (F.col("e") > 1), "REGISTRAR_AMBIGUOUS").when(F.col("gone"), "REGISTRAR_CONFLICT")
        .when(F.col("n") > 0, "REGISTRAR_AMBIGUOUS").otherwise("REGISTRAR_NOT_FOUND")
    )
    return searches.join(seen, search, "left").select(search, outcome.alias("outcome"), F.when(F.col("a") == 1, F.col("one")).alias("company"))


def mask_tiers(masks: DataFrame, tiers: DataFrame, key: str, highest: str) -> DataFrame:
    """(key, tier, cost): the highest tier of a mask's fields sets the price; an unknown field counts as `highest`. Tiers are
    (field, tier, rank, cost)."""
    top = F.max(F.struct("rank", "tier", "cost"))
    worst = tiers.filter(F.col("tier") == highest).agg(top.alias("w")).select("w.*")
    each = masks.select(key, F.explode("fields").alias("field")).join(tiers, "field", "left").join(F.broadcast(worst.toDF("w_rank", "w_tier", "w_cost")))
    known = each.select(key, *[F.coalesce(c, f"w_{c}").alias(c) for c in ("rank", "tier", "cost")])
    return known.groupBy(key).agg(top.alias("t")).select(key, "t.tier", "t.cost")


#: Consent states that are evidence of consent.
CONSENTED = ("GRANTED", "OPTED_IN", "VALID")
#: Fixed values, by category: what is permitted, whether marketing needs consent, urgency, whether an owner and an approval are needed, what to
#: send, and what ends the state. Two entries in a field: with valid consent, and without.
POLICIES = {
    "DEMO_REQUEST": ("Transactional acknowledgement and human sales follow-up permitted.", False, "IMMEDIATE", True, True, ("Transactional acknowledgement", "Human demo follow-up"), "Owner records contact or demo is scheduled."),
    "TALK_TO_SALES": ("Direct response to the enquiry permitted.", False, "IMMEDIATE", True, True, ("Direct human response",), "Owner records contact and qualification outcome."),
    "TRIAL_STARTED": ("Service and activation communication permitted; commercial assistance is separate.", False, "SAME_DAY", False, True, ("Trial activation/service support",), "Trial is active, qualified, or closed."),
    "PRODUCT_ENQUIRY": ("Human qualification permitted.", False, "SAME_DAY", True, True, ("Human qualification response",), "Qualification outcome recorded."),
    "NEWSLETTER_SIGNUP": (
        {True: "Marketing communication permitted with recorded consent.", False: "No marketing communication until valid consent evidence exists."}, True, "NURTURE", False, True,
        {True: ("Marketing newsletter",), False: ()}, "Consent is confirmed or the contact opts out.",
    ),
    "INTERNAL_TEST": ("No communication.", False, "NONE", False, False, (), "Remain excluded."),
}
OTHER_POLICY = (
    {True: "Requested resource delivery; marketing nurture is permitted with recorded consent.", False: "Requested resource delivery only; marketing nurture requires valid consent."}, True, "WITHIN_2_DAYS", False, True,
    {True: ("Requested resource delivery", "Marketing nurture"), False: ("Requested resource delivery",)}, "Delivery is complete, consent changes, or engagement becomes high intent.",
)
_POLICY_FIELDS = ("treatment", "consent_required", "urgency", "owner_required", "approval_required", "communications", "transition")


def communication_policy(category: Column, consent: Column) -> Column:
    """struct<treatment, consent_required, urgency, owner_required, approval_required, communications, transition>: what may be
    sent for a submission. Marketing is sent on recorded consent only: an unknown, withdrawn or missing state is none."""
    valid = F.coalesce(F.upper(consent).isin(*CONSENTED), F.lit(False))

    def literal(value: object) -> Column:
        return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)

    def policy(values: tuple) -> Column:
        pick = lambda v: F.when(valid, literal(v[True])).otherwise(literal(v[False])) if isinstance(v, dict) else literal(v)
        return F.struct(*[pick(v).alias(f) for f, v in zip(_POLICY_FIELDS, values, strict=True)])

    out = policy(OTHER_POLICY)
    for name, values in reversed(POLICIES.items()):
        out = F.when(category == name, policy(values)).otherwise(out)
    return out

def lead_assessment(country: Column, activity: Column, kind: Column, frequency: Column, needs: Column, provider: Column, evidence: Column) -> Column:
    """struct<territory, motion, signals, gaps>: what is supported of an account by at least one piece of evidence, and what is
    not known of it."""
    supported, code = evidence > 0, F.upper(F.trim(country))
    territory = F.when(supported & code.isin("ZA", "SOUTH AFRICA"), "ZA").when(supported & code.isin("GB", "UK", "UNITED KINGDOM"), "GB").otherwise("UNKNOWN")
    direct = activity.isin("RUNS_EVENTS", "RUNS_AND_SERVICES") | kind.isin("SCHOOL", "VENUE")
    local = activity.isin("SERVICES_EVENT_ORGANISERS", "RUNS_AND_SERVICES")
    motion = F.when(~supported, "UNKNOWN").when(direct & local, "BOTH").when(direct, "DIRECT").when(local, "LOCAL").otherwise("UNKNOWN")
    has = lambda word: F.exists(needs, lambda n: F.lower(n).contains(word))
    told = lambda c: c.isNotNull() & (c != "UNKNOWN")
    signals = F.array_compact(F.array(
        F.when(territory != "UNKNOWN", F.concat(F.lit("TERRITORY_"), territory)), F.when(supported & told(kind), F.concat(F.lit("CLIENT_TYPE_"), kind)), F.when(supported & frequency.isin("RECURRING", "HIGH_FREQUENCY"), "MULTIPLE_EVENTS"),
        F.when(supported & (frequency == "HIGH_FREQUENCY"), "HIGH_EVENT_FREQUENCY"), F.when(supported & provider.isNotNull(), "USES_EXISTING_TICKETING_PLATFORM"), F.when(supported & has("workforce"), "WORKFORCE_COMPLEXITY"), F.when(supported & has("production"), "PRODUCTION_COMPLEXITY"),
    ))
    gaps = F.array_compact(F.array(
        F.when(territory == "UNKNOWN", "territory_unknown"), F.when(~F.coalesce(told(kind), F.lit(False)), "client_type_unknown"), F.when(~F.coalesce(told(frequency), F.lit(False)), "event_frequency_unknown"), F.when(provider.isNull(), "ticketing_provider_unknown"),
        F.when(~has("workforce"), "workforce_complexity_unknown"), F.when(~has("production"), "production_operations_unknown"), F.when(~supported, "evidence_missing"),
    ))
    return F.struct(territory.alias("territory"), motion.alias("motion"), signals.alias("signals"), gaps.alias("gaps"))
