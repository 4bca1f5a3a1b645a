"""Registered queries of the readers: sitemaps, robots rules, search responses, bodies, and what pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import text
from venuelake.operators import harvest, leads, ledgers
from venuelake.plans.catalog import pick, register, sql_pick
from venuelake.sources import documents
from venuelake.sources.tables import table


@register(
    "sitemap_urls",
    """SELECT o_custkey AS map, CASE o_custkey % 3 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'URLSET' ELSE 'TEXT' END AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, 'https://hall.org/' || o_orderkey AS url FROM orders""",
)
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("map")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    each = lambda before, after: F.array_join(F.transform("keys", lambda k: F.concat(F.lit(f"{before}https://hall.org/"), k.cast("string"), F.lit(after))), "\n")
    m = F.col("map")
    body = F.when(m % 3 == 0, F.concat(F.lit("<?xml?><sitemapindex>"), each("<sitemap><loc> ", " </loc></sitemap>"))).when(m % 3 == 1, F.concat(F.lit("<urlset>"), each("<url><loc>", "</loc></url>"))).otherwise(F.concat(F.lit("# list\n"), each("", "")))
    return documents.sitemap_urls(urls.select("map", body.alias("body")), "map", "body", most=None)


ROBOTS = ("User-agent: *\nDisallow: /private\nAllow: /private/open # x\nDisallow: /*.pdf$", "User-agent: Other\nUser-agent: Crawler\nDisallow: /\n\nUser-agent: *\nAllow: /", "", None, "User-agent: *\nDisallow: /\n\nUser-agent: Crawler\nDisallow:", "User-agent: crawl\nDisallow: /private/*/y\nAllow: /private\n\nUser-agent: *\nDisallow: /")
ASKED = ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdf?x")


@register(
    "robots_decisions",
    f"""WITH a AS (SELECT DISTINCT 'h' || user_id AS host, user_id % 6 AS k, {sql_pick(ASKED, "event_id")} AS path FROM events) SELECT host, path, CASE k WHEN 0 THEN path NOT IN ('/private/x', '/a.pdf') WHEN 1 THEN false WHEN 5 THEN path <> '/private/open/y' ELSE true END AS allowed FROM a""",
)
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"))
    bodies = e.select("host", "user_id").distinct().select("host", pick(ROBOTS, F.col("user_id")).alias("body"))
    return documents.robots_allowed(e.select("host", pick(ASKED, F.col("event_id")).alias("path")), documents.robots_rules(bodies, "host", "body"), "Crawler")


@register(
    "search_rows",
    """SELECT event_id, k AS rank, 'Title ' || k AS title, 'https://site' || k || '.org/' || event_id AS link FROM events, (SELECT unnest(range(1, 4)) AS k) WHERE event_id % 4 < 3 AND NOT (k = 2 AND event_id % 4 = 1)""",
)
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    row = lambda k: F.concat(F.lit(f'{{"title":"Title {k}","position":{k},"link":"'), F.when((e % 4 == 1) & F.lit(k == 2), "javascript:x").otherwise(F.concat(F.lit(f"https://site{k}.org/"), e.cast("string"))), F.lit('"}'))
    body = F.when(e % 4 == 3, '{"ads":[{"title":"x"}]}').otherwise(F.concat(F.lit('{"organic":['), F.concat_ws(",", row(1), row(2), row(3)), F.lit("]}")))
    return documents.search_results(table(spark, sf_dir, "events").select(e, body.alias("body")), "event_id", "body")


BODIES = ("%PDF-1.7 x", "BEGIN:VCALENDAR", " <!DOCTYPE html><p>", "<?xml version='1'?>", '{"a":1}', "plain", "", "bytes")
TYPES = ("text/html", "text/plain", None, "application/xml", "text/javascript", "text/plain; charset=utf-8", "application/json", "application/octet-stream")
_KINDS = ("PDF", "ICS", "HTML", "XML", "JSON", "TEXT", "JSON", "OTHER")


@register("content_kinds", f"SELECT event_id, {sql_pick(_KINDS, 'event_id')} AS kind FROM events")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, documents.content_kind(pick(TYPES, e), pick(BODIES, e)).alias("kind"))


@register("binary_bodies", "SELECT event_id, event_id % 4 IN (1, 2) AS is_binary FROM events")
def binary_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    body = F.when(e % 4 == 0, "plain text\twith tabs\n").when(e % 4 == 1, F.concat(F.lit("abc"), F.char(F.lit(0)), F.lit("def"))).when(e % 4 == 2, F.concat(F.lit("abcdefghij"), F.char(F.lit(1)))).otherwise(F.concat(F.repeat(F.lit("a"), 5000), F.char(F.lit(0))))
    return table(spark, sf_dir, "events").select(e, text.looks_binary(body).alias("is_binary"))


@register("idempotent_inserts", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id * 10 + event_id % 10 ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def idempotent_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("id"), F.col("event_type").alias("source_system"), (F.col("user_id") * 10 + F.col("event_id") % 10).alias("source_record_id"), F.col("ts").alias("received_at"))
    return leads.once(rows).select("event_id")


@register(
    "ledger_edits",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'DELETED' ELSE 'EDITED' END AS change FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0",
)
def ledger_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("c_nationkey"))
    after = before.filter("c_custkey % 7 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "new").otherwise(F.col("c_name")))
    return ledgers.illegal_edits(before, after, "c_custkey", ["c_name", "c_nationkey"])


@register("retry_backoff", "SELECT event_id, CAST(greatest(2 * pow(2, event_id % 6), CASE WHEN event_id % 4 = 0 THEN 20 ELSE 0 END) AS BIGINT) AS hours FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, ledgers.backoff_hours(e % 6, 2, F.when(e % 4 == 0, 20)).alias("hours"))


@register(
    "lead_issues",
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'ORGANISATION_UNRESOLVED' END, CASE WHEN c_custkey % 3 = 0 THEN 'WEBSITE_MISSING' END, CASE WHEN c_nationkey < 5 THEN 'LOCATION_MISSING' END, CASE WHEN c_acctbal < 0 THEN 'NO_COMMERCIAL_SIGNAL' END) AS issues FROM customer""",
)
def lead_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    found = leads.issues({"organisation": F.when(key % 2 > 0, "o"), "website": F.when(key % 3 > 0, "w"), "location": F.when(F.col("c_nationkey") >= 5, "l"), "intent": F.when(F.col("c_acctbal") < 0, "LOW").otherwise("HIGH")})
    return table(spark, sf_dir, "customer").select(key, F.array_join(found, ",").alias("issues"))


@register("discovery_keys", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '|' || CASE WHEN p_partkey % 3 > 0 THEN 'a.org' ELSE '' END AS key FROM part")
def discovery_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug_key(F.concat_ws(" & ", "p_name", "p_type"), F.when(F.col("p_partkey") % 3 > 0, "a.org")).alias("key"))


@register("wildcard_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || '_' || p_size || '%'), '_2') AND contains(lower(p_name || '_' || p_size || '%'), '%')")
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.lit("%"))
    return table(spark, sf_dir, "part").filter(text.escaped_ilike(name, "_2") & text.escaped_ilike(name, "%")).select("p_partkey")


PAGES = (
    '<title>The Hall</title><meta property="og:site_name" content="Hall &amp; Co"><h1>Hire <b>us</b></h1><a href="mailto:Hi@hall.org?subject=x">mail</a> hi@hall.org and <b>Jo@hall.org</b> <a href="tel:+44 20">call</a>',
    '<img src="x.jpg" srcset="a.jpg 300w, main-hall.jpg 900w" alt="Main"><img src="/pixel.gif"><img data-src="logo.png" src="data:x" alt="Our logo"><a href="https://wa.me/2721">w</a>',
    "<link rel='canonical' href='https://hall.org/'><meta name='description' content='A hall'><p>nothing</p><img src=\"plan.png\" alt=\"Floor plan\">",
    '<script id="__NEXT_DATA__" type="application/json">{"props":{"name":"Grand \\"Hall\\"","url":"/x","n":3,"list":["for hire","ab"]}}</script>',
)
_CONTACTS = {0: (("EMAIL", "hi@hall.org", "LINK"), ("PHONE", "+44 20", "LINK"), ("EMAIL", "jo@hall.org", "TEXT")), 1: (("WHATSAPP", "2721", "LINK"),)}
_FACTS = {0: (("title", "The Hall"), ("heading", "Hire us"), ("siteName", "Hall & Co")), 2: (("description", "A hall"), ("canonical", "https://hall.org/"))}
_STATE = {3: (('Grand "Hall"',), ("for hire",))}


def _expected(rows: dict, names: tuple[str, ...]) -> str:
    text_of = lambda v: "'" + v.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT event_id, {', '.join(f'{text_of(v)} AS {n}' for n, v in zip(names, r, strict=True))} FROM events WHERE event_id % 4 = {k}" for k, found in rows.items() for r in found)


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", pick(PAGES, F.col("event_id")).alias("html"))


@register("page_contacts", _expected(_CONTACTS, ("kind", "value", "source")))
def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.contacts(_made_pages(spark, sf_dir), "event_id", "html")


@register("page_identity", _expected(_FACTS, ("field", "value")))
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.identity_facts(_made_pages(spark, sf_dir), "event_id", "html")


@register("hydration_texts", _expected(_STATE, ("value",)))
def hydration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.hydration_texts(_made_pages(spark, sf_dir), "event_id", "html")


@register(
    "capacity_matrices",
    """SELECT event_id, 'Main Hall' AS space, 'theatre' AS layout, CAST(20 + user_id AS INT) AS number FROM events UNION ALL SELECT event_id, 'Main Hall', 'standing', CAST(1000 + user_id AS INT) FROM events UNION ALL SELECT event_id, 'Loft', 'standing', CAST(50 AS INT) FROM events WHERE event_id % 2 = 0""",
)
def capacity_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id")
    big = F.format_number(1000 + n, 0)
    last = F.when(F.col("event_id") % 2 == 0, "Loft n/a 40 50").otherwise("Loft 40 50")
    body = F.concat(F.lit("Spaces\nTheatre  Size  Standing\nMain Hall "), (20 + n).cast("string"), F.lit(" 90.5 "), big, F.lit("\n"), last, F.lit("\nPrices 5"))
    return harvest.matrix_capacities(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body")


SPACES = ("Main Hall", "the  Hall", "Garden Room", "Blue", "Guest Accommodation", "Private Gallery", "The Loft", "Meeting Studio", "Great Oak", "Wedding", "Our Chapel Vault", "the", "", "Corporate Events Suite")
_IN = {"a": "'the', 'our', 'your', 'a', 'an'", "c": ", ".join(f"'{w}'" for w in (*harvest.CATEGORY_WORDS, *harvest.CATEGORY_NOUNS)), "t": ", ".join(f"'{w}'" for w in harvest.SPACE_TYPES)}


@register(
    "space_classes",
    f"""WITH s AS (SELECT event_id, trim(regexp_replace({sql_pick(SPACES, "event_id")} || CASE WHEN user_id % 4 = 0 THEN ' ' || event_type ELSE '' END, '\\s+', ' ', 'g')) AS name, event_id // 14 % 3 = 0 AS cap, event_id // 14 % 5 = 0 AS struct, event_id // 14 % 2 = 0 AS listed FROM events),
      w AS (SELECT *, string_split(lower(name), ' ') AS words, cap OR struct AS backed, cap OR struct OR listed AS strong FROM s), c AS (SELECT *, list_filter(words, lambda x: x NOT IN ({_IN["a"]})) AS content FROM w),
      n AS (SELECT *, len(content) AS n, len(list_filter(content, lambda x: x IN ({_IN["t"]}))) AS types, len(list_filter(content, lambda x: x IN ({_IN["c"]}))) AS cats FROM c), p AS (SELECT *, n - types - cats AS proper FROM n)
      SELECT event_id, CASE WHEN name = '' THEN 'REJECTED' WHEN regexp_full_match(lower(name), '(the |our |your )?(gallery|events|hall|room|chapel|guest accommodation|accommodation|venue)') THEN CASE WHEN backed THEN 'REVIEW' ELSE 'REJECTED' END WHEN n = 0 THEN 'REJECTED' WHEN proper = 0 AND types <= 1 AND cats > 0 THEN CASE WHEN backed THEN 'REVIEW' ELSE 'REJECTED' END
        WHEN proper >= 1 AND types >= 1 OR proper >= 2 AND strong OR proper = 1 AND n = 1 AND strong OR proper = 0 AND types >= 2 AND types = n OR proper = 0 AND types = 1 AND len(words) = 2 AND words[1] IN ({_IN["a"]}) AND strong THEN 'CONFIRMED' WHEN proper = 0 THEN CASE WHEN backed THEN 'REVIEW' ELSE 'REJECTED' END WHEN strong THEN 'CONFIRMED' ELSE 'REVIEW' END AS class FROM p""",
)
def space_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name, group = F.concat(pick(SPACES, e), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit(" "), "event_type")).otherwise("")), F.floor(e / 14)
    return table(spark, sf_dir, "events").select(e, harvest.space_class(name, group % 3 == 0, group % 5 == 0, group % 2 == 0).alias("class"))


TOLD = ("Buy tickets for our shows.", "Venue hire and a festival.", "She presents it.", "Seating", "Nothing.", "The Fest; box  office")
SCHEMA_TYPES = ('["Thing","Organization"]', '"http://schema.org/EventVenue"', '"Place"', '"LocalBusiness"', '"Event"')


@register(
    "site_signals",
    f"""WITH d AS (SELECT doc_id, {sql_pick(TOLD, "doc_id")} || ' ' || coalesce(text, '') AS t, doc_id // 6 % 7 AS k FROM documents),
      s AS (SELECT doc_id, k IN (1, 2) AS place, k IN (0, 3) AS org, regexp_matches(t, '\\b(festival|fest)\\b', 'i') AS f, regexp_matches(t, '\\b(promot(er|ing|es)|presents)\\b', 'i') AS p, regexp_matches(regexp_replace(t, '\\s+', ' ', 'g'), '\\b(tickets?|box office|ticketmaster|dice\\.fm)\\b', 'i') AS m, regexp_matches(t, '\\b(capacity|seating|function rooms?|venue hire|banquet|auditorium)\\b', 'i') AS c FROM d)
      SELECT doc_id, concat_ws(',', CASE WHEN place THEN 'SCHEMA_PLACE_OR_VENUE' END, CASE WHEN org THEN 'SCHEMA_ORGANISATION' END, CASE WHEN f THEN 'FESTIVAL_OR_SERIES_LANGUAGE' END, CASE WHEN p THEN 'PROMOTER_LANGUAGE' END, CASE WHEN m THEN 'TICKETING_OR_MEDIA_LANGUAGE' END, CASE WHEN c THEN 'FACILITY_LANGUAGE' END,
        CASE WHEN org AND (place OR c) THEN 'ORGANISATION_VENUE_CONFLICT' END, CASE WHEN f AND (place OR c) THEN 'FESTIVAL_PLACE_CONFLICT' END) AS signals FROM s""",
)
def site_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("doc_id"), F.floor(F.col("doc_id") / 6) % 7
    data = F.when(k < 5, F.concat(F.lit('<script type="application/ld+json">{"@type" : '), pick(SCHEMA_TYPES, k), F.lit("}</script>"))).otherwise("")
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>A page</title>"), data, F.lit("</head><body><p>"), pick(TOLD, d), F.lit("</p> <div>"), body, F.lit("</div></body>"))
    return table(spark, sf_dir, "documents").select(d, F.array_join(harvest.site_signals(html), ",").alias("signals"))
