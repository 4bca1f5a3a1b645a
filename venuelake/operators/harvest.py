"""What pages hold, as rows: contacts, images, identity facts, text matrices, hydration state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.functions.text import visible_text

from venuelake.functions import capacities, text

#: Words of a column that is no layout.
OTHER_COLUMNS = r"size|area|sq\.? ?m|sqm|m2|m²|sq\.? ?ft|sqft|dimensions?|height|ceiling(?: height)?"
_TERMS = rf"(?i)\b(theatre|theater|cabaret|banquet(?:ing)?|dinner|dining|reception|standing|seated|classroom|boardroom|conference|cocktail|capacity|{OTHER_COLUMNS})\b"
_CELL = r"(?:\d{1,3}(?:,\d{3})+|\d{1,6}(?:\.\d+)?|[-–]|n/a)"
#: Structured types and words that tell what a site is.
SIGNAL_TYPES = (("SCHEMA_PLACE_OR_VENUE", ("eventvenue", "place", "civicstructure", "performingartsvenue")), ("SCHEMA_ORGANISATION", ("organization", "localbusiness", "corporation", "ngo")))
SIGNAL_WORDS = (
    ("FESTIVAL_OR_SERIES_LANGUAGE", r"(?i)\b(?:festival|fest)\b"), ("PROMOTER_LANGUAGE", r"(?i)\b(?:promot(?:er|ing|es)|presents)\b"),
    ("TICKETING_OR_MEDIA_LANGUAGE", r"(?i)\b(?:tickets?|box office|ticketmaster|dice\.fm)\b"), ("FACILITY_LANGUAGE", r"(?i)\b(?:capacity|seating|function rooms?|venue hire|banquet|auditorium)\b"),
)
#: Names of spaces that name none, and words of categories, of articles and of kinds of space.
GENERIC_SPACE = r"(?i)^(?:the |our |your )?(?:newsletter|contact|what'?s on|whats on|latest news|conference venue|wedding venue|corporate venue|home|gallery|events|hall|room|rooms|venue|space|spaces|guest accommodation|accommodation|facilities|amenities|our venue|outdoor space|private events|meeting rooms|chapel|weddings|conferences|functions|hire|venue hire|private hire|corporate hire)$"
ARTICLES = ("the", "our", "your", "a", "an")
CATEGORY_WORDS = ("guest", "wedding", "honeymoon", "private", "corporate", "meeting", "function", "outdoor", "conference", "event", "events")
CATEGORY_NOUNS = ("accommodation", "facilities", "amenities", "gallery", "venue", "newsletter", "contact", "home")
SPACE_TYPES = "hall halls room rooms suite suites cottage cottages chalet chalets chapel chapels auditorium ballroom ballrooms studio studios terrace terraces garden gardens nave theatre theater bar barn vault vaults".split()


def contacts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, value, source): links of mail, phones and messengers, and mail addresses in the text that no link has."""
    h = F.coalesce(html, F.lit(""))
    body = F.lower(text.visible_text(h))
    links = F.transform(F.regexp_extract_all(h, F.lit(r"(?i)href=[\"']((?:mailto:|tel:|https?://wa\.me/)[^\"']+)[\"']"), 1), lambda x: F.regexp_replace(x, r"\?.*$", ""))
    linked = F.transform(links, lambda x: F.struct(F.when(x.rlike("(?i)^mailto:"), "EMAIL").when(x.rlike("(?i)^tel:"), "PHONE").otherwise("WHATSAPP").alias("kind"), F.lower(F.regexp_replace(x, r"(?i)^(?:mailto:|tel:|https?://wa\.me/)", "")).alias("value"), F.lit("LINK").alias("source")))
    written = F.regexp_extract_all(body, F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"), 1)
    free = F.transform(F.filter(written, lambda m: ~F.exists(linked, lambda c: c["value"] == m)), lambda m: F.struct(F.lit("EMAIL").alias("kind"), m.alias("value"), F.lit("TEXT").alias("source")))
    return pages.select(key, F.explode(F.array_distinct(F.concat(linked, free))).alias("c")).select(key, "c.*")


def identity_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, field, value): title, first heading, site name, description and canonical address of a page, those that it has."""
    h = F.coalesce(html, F.lit(""))
    plain = lambda c: F.nullif(text.visible_text(c), F.lit(""))
    one = lambda pattern: plain(F.regexp_extract(h, pattern, 1))
    told = (
        ("title", one(r"(?is)<title\b[^>]*>(.*?)</title>")), ("heading", one(r"(?is)<h1\b[^>]*>(.*?)</h1>")), ("siteName", one(r"(?i)<meta\b[^>]*property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']*)")),
        ("description", one(r"(?i)<meta\b[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)")), ("canonical", one(r"(?i)<link\b[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)")),
    )
    facts = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), v.alias("value"))) for n, v in told]))
    return pages.select(key, F.inline(facts))


def matrix_capacities(texts: DataFrame, key: str, body: str, reach: int = 40) -> DataFrame:
    """(key, space, layout, number) of matrices in plain text: a line of two layouts or more heads the columns of the lines after it, up
    to the next such line and `reach` lines on; a line counts if its cells are as many as the columns."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    terms = lambda x: F.regexp_extract_all(x, F.lit(_TERMS), 1)
    layout = lambda t: F.when(~t.rlike(f"(?i)^(?:{OTHER_COLUMNS})"), capacities.layout_of(t))
    is_head = lambda x: F.size(F.filter(terms(x), lambda t: layout(t).isNotNull())) >= 2
    # each line with the place and the text of the last head before it
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("head"), F.lit(0).alias("i"), F.array().cast("array<struct<head:string,line:string>>").alias("rows"))
    step = lambda s, x: F.when(is_head(x), F.struct((s["i"] + 1).alias("at"), x.alias("head"), (s["i"] + 1).alias("i"), s["rows"].alias("rows"))).otherwise(
        F.struct(s["at"].alias("at"), s["head"].alias("head"), (s["i"] + 1).alias("i"), F.when((s["at"] > 0) & (s["i"] + 1 - s["at"] < reach), F.array_append(s["rows"], F.struct(s["head"].alias("head"), x.alias("line")))).otherwise(s["rows"]).alias("rows"))
    )
    rows = texts.select(key, F.inline(F.aggregate(lines, start, step, lambda s: s["rows"])))
    shape = rf"(?i)^([A-Za-z][A-Za-z0-9'&\- ]{{1,58}}?)\s+({_CELL}(?:\s+{_CELL})*)$"
    cells = F.split(F.regexp_extract("line", shape, 2), r"\s+")
    parsed = rows.filter(F.col("line").rlike(shape)).select(key, capacities.space_name(F.regexp_extract("line", shape, 1)).alias("space"), terms(F.col("head")).alias("terms"), cells.alias("cells"))
    each = parsed.filter(F.col("space").isNotNull() & (F.size("terms") == F.size("cells"))).select(key, "space", F.inline(F.arrays_zip("terms", "cells")))
    return each.select(key, "space", layout(F.col("terms")).alias("layout"), capacities.count_of(F.col("cells")).alias("number")).filter("layout is not null and number is not null")


def hydration_texts(pages: DataFrame, key: str, html: str, least: int = 3) -> DataFrame:
    """(key, value): the texts of a page's embedded state, those of at least `least` characters with a letter and no address."""
    state = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*id=[\"']__(?:NEXT|NUXT)_DATA__[\"'][^>]*>(.*?)</script>", 1)
    values = F.regexp_extract_all(state, F.lit(r'[:\[,]\s*"((?:[^"\\]|\\.)*)"(?!\s*:)'), 1)
    plain = F.transform(values, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\\[ntr]", " "), r"\\(.)", "$1")))
    kept = F.filter(plain, lambda v: (F.length(v) >= least) & v.rlike("[A-Za-z]") & ~v.rlike(r"^(?:https?:/)?/"))
    return pages.select(key, F.explode(F.array_distinct(kept)).alias("value"))


def site_signals(html: Column) -> Column:
    """What a page tells of the kind of its site, in fixed order: types of its structured data, words of its title, description and
    text, and the conflicts between these."""
    meta = lambda name: F.regexp_extract(html, rf"""(?i)<meta\b[^>]*\b(?:name|property)=["']{name}["'][^>]*\bcontent="([^"]*)\"""", 1)
    filled = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    title = filled(visible_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), meta("og:title"))
    text = F.concat_ws(" ", title, filled(meta("description"), meta("og:description")), visible_text(html))
    scripts = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1), " ")
    told = F.array_join(F.regexp_extract_all(scripts, F.lit(r'"@type"\s*:\s*("[^"]*"|\[[^\]]*\])'), 1), ",")
    types = F.transform(F.regexp_extract_all(told, F.lit('"([^"]*)"'), 1), lambda t: F.lower(F.trim(F.regexp_replace(t, r"^.*[/#]", ""))))
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    # the page's text and types are made once, however many signals are sought in them
    by_type = once(types, lambda t: F.array(*[F.when(F.arrays_overlap(t, F.array(*map(F.lit, known))), name) for name, known in SIGNAL_TYPES]))
    by_word = once(text, lambda t: F.array(*[F.when(t.rlike(p), n) for n, p in SIGNAL_WORDS]))
    plain = F.array_compact(F.concat(by_type, by_word))

    def with_conflicts(found: Column) -> Column:
        has = lambda name: F.array_contains(found, name)
        place = has("SCHEMA_PLACE_OR_VENUE") | has("FACILITY_LANGUAGE")
        conflicts = F.array(F.when(has("SCHEMA_ORGANISATION") & place, "ORGANISATION_VENUE_CONFLICT"), F.when(has("FESTIVAL_OR_SERIES_LANGUAGE") & place, "FESTIVAL_PLACE_CONFLICT"))
        return F.concat(found, F.array_compact(conflicts))

    return once(plain, with_conflicts)


def space_class(name: Column, capacity: Column, structured: Column, listed: Column) -> Column:
    """Whether a named space is CONFIRMED, for REVIEW or REJECTED. A proper name with a kind of space is confirmed, as are two kinds
    together; other names need a capacity, a structured place or a list of spaces beside them. A heading of a category is for
    review at best, and only with a capacity or a structured place."""

    def judged(clean: Column) -> Column:
        flag = lambda c: F.coalesce(c, F.lit(False))
        backed = flag(capacity) | flag(structured)
        strong = backed | flag(listed)
        words = F.split(F.lower(clean), " ")
        content = F.filter(words, lambda w: ~w.isin(*ARTICLES))
        types = F.size(F.filter(content, lambda w: w.isin(*SPACE_TYPES)))
        category = F.exists(content, lambda w: w.isin(*CATEGORY_WORDS, *CATEGORY_NOUNS))
        proper, n = F.size(F.filter(content, lambda w: ~w.isin(*CATEGORY_WORDS, *CATEGORY_NOUNS, *SPACE_TYPES))), F.size(content)
        weak = F.when(backed, "REVIEW").otherwise("REJECTED")
        named = (proper >= 1) & (types >= 1) | (proper >= 2) & strong | (proper == 1) & (n == 1) & strong | (proper == 0) & (types >= 2) & (types == n)
        the_kind = (proper == 0) & (types == 1) & (F.size(words) == 2) & F.get(words, F.lit(0)).isin(*ARTICLES) & strong
        return (
            F.when((clean == "") | (F.length(clean) > 60), "REJECTED").when(clean.rlike(GENERIC_SPACE), weak).when(n == 0, "REJECTED").when((proper == 0) & (types <= 1) & category, weak)
            .when(named | the_kind, "CONFIRMED").when(proper == 0, weak).otherwise(F.when(strong, "CONFIRMED").otherwise("REVIEW"))
        )

    return F.get(F.transform(F.array(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))), judged), F.lit(0))


def required(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, missing): the names of the fields that a row lacks, in order."""
    return rows.select(key, F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])).alias("missing"))
