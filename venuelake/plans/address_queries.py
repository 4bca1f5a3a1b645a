"""Registered queries of web addresses: sites, plan keys, tiers, redirects, networks, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import addresses
from venuelake.operators import linking
from venuelake.plans.catalog import AS_OF, as_of, pick, quoted, register, sql_pick
from venuelake.sources.tables import table

#: Endings of hosts, by which the rules of sites differ.
ENDINGS = ("example.com", "shop.example.co.uk", "hall.org.za", "github.io", "wordpress.com", "eventbrite.co.uk", "foo.ltd.uk", "a.b.museum", "co.uk", "club.sch.uk", "x.or.jp", "localhost", "bar.biz.id", "one.nhs.uk", "pages.dev")
FIRSTS = ("www.", "", "news.", "www.events.", "a.")
_HOST = f"{sql_pick(FIRSTS, 'event_id')} || {sql_pick(ENDINGS, 'event_id // 5')}"
_LABELS = "list_filter(string_split(host, '.'), lambda x: x <> '')"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(map(quoted, values))


@register(
    "site_domains",
    f"""WITH h AS (SELECT event_id, {_HOST} AS host FROM events), l AS (SELECT *, {_LABELS} AS p, len({_LABELS}) AS n FROM h),
      t AS (SELECT *, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three, array_to_string(p[-4:], '.') AS four, regexp_replace(host, '^www[.]', '') AS bare FROM l)
      SELECT event_id, host, CASE WHEN n < 2 THEN NULL WHEN n >= 3 AND three IN ({_listed(addresses.PLATFORMS)}) THEN CASE WHEN n > 3 THEN four END WHEN two IN ({_listed(addresses.PLATFORMS)}) THEN CASE WHEN n > 2 THEN three END
          WHEN length(p[-1]) = 2 AND p[-2] IN ({_listed(addresses.SECOND_LEVELS)}) THEN CASE WHEN n >= 3 THEN three END ELSE two END AS site,
        CASE WHEN regexp_matches(bare, '(^|[.])(co|org|ac|gov|net|com|ltd|plc|me|nic|web|nom|sch|police|mod|nhs)[.](uk|za)$') THEN regexp_extract(bare, '([^.]+[.])?[^.]+[.][^.]+$') ELSE regexp_extract(bare, '([^.]+[.])?[^.]+$') END AS mail_site,
        CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE 'www.' || host END AS counterpart FROM t""",
)
def site_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(pick(FIRSTS, e), pick(ENDINGS, F.floor(e / 5)))
    rows = table(spark, sf_dir, "events").select(e, name.alias("host"))
    h = F.col("host")
    return rows.select(e, h, addresses.registrable_domain(h).alias("site"), addresses.mail_domain(h).alias("mail_site"), addresses.www_counterpart(h).alias("counterpart"))


@register(
    "page_addresses",
    f"""WITH h AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages),
      l AS (SELECT *, {_LABELS} AS p, len({_LABELS}) AS n FROM h), q AS (SELECT *, regexp_extract(url, '^([^?#]*)', 1) AS bare, list_filter(string_split(substr(regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(tracking|utm_[a-z_]+|fbclid|gclid)(=|$)', 'i')) AS kept FROM l)
      SELECT page_id, host, CASE WHEN n < 2 THEN NULL WHEN length(p[-1]) = 2 AND p[-2] IN ({_listed(addresses.SECOND_LEVELS)}) THEN CASE WHEN n >= 3 THEN array_to_string(p[-3:], '.') END ELSE array_to_string(p[-2:], '.') END AS domain,
        bare || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS plain_url FROM q""",
)
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = addresses.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("host"), addresses.registrable_domain(name).alias("domain"), addresses.without_tracking(F.col("url")).alias("plain_url"))


#: Paths and queries, by which planning differs.
PATHS = (
    "", "/", "/Contact-Us/", "/en/private-hire", "/en-gb/rooms/", "/blog/a-day", "/menus", "/food-menu", "/privacy", "/tag/x", "/gallery/12", "/a-b-c-d-e-f-g-h", "/open-2019-day", "/weddings", "/floor-plans.pdf", "/lunch.pdf",
    "/about", "/whats-on", "/img/x.JPG", "/shop/gifts", "/spaces/The-Hall", "/photos", "/de/", "/history", "/downloads/spec", "/sitemap.xml", "/style.css", "/inspiration-board/x",
)
QUERIES_OF = ("", "?page=2", "?utm_source=a&id=7", "?q=hall", "?ref=a&Tracking=b&x=1", "?s=", "?view=grid#top", "#part")
_URL = f"'https://Hall.org' || {sql_pick(PATHS, 'event_id')} || {sql_pick(QUERIES_OF, 'event_id // 28')}"
_SQL_WORDS = {w: getattr(addresses, f"{w}_WORDS") for w in ("CONTACT", "IDENTITY", "MENU", "COMMERCE", "HIRE")}


def _sql_has(word: str) -> str:
    return f"regexp_matches(t, '\\b(?:{_SQL_WORDS[word]})\\b', 'i')"


@register(
    "url_plan",
    f"""WITH u AS (SELECT event_id, {_URL} AS url, {sql_pick(PATHS, "event_id")} AS p0, regexp_extract({sql_pick(QUERIES_OF, "event_id // 28")}, '^([^#]*)', 1) AS q FROM events),
      v AS (SELECT *, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS p, list_filter(string_split(substr(q, 2), '&'), lambda x: x <> '') AS params FROM u),
      w AS (SELECT *, CASE WHEN p = '/' THEN p ELSE regexp_replace(lower(p), '/+$', '') END AS np, CASE WHEN regexp_matches(p, '^/([a-z]{{2}}|[a-z]{{2}}-[a-z]{{2}})/', 'i') THEN regexp_replace(p, '^/[A-Za-z-]+', '') END AS lp,
        list_filter(string_split(lower(p), '/'), lambda x: x <> '') AS f, trim(regexp_replace(regexp_replace(p, '[/_.-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM v),
      a AS (SELECT *, len(f) > 0 AND (len(list_filter(f, lambda s: regexp_full_match(s, '{addresses.ARTICLE_FOLDERS}') OR regexp_matches(s, '(^|-)inspiration(-|$)') OR s IN ('menu', 'menus'))) > 0 OR regexp_matches(f[-1], '-menus?$')
        OR len(f) > 1 AND f[-2] IN ('gallery', 'galleries', 'portfolio', 'download', 'downloads') OR len(string_split(f[-1], '-')) >= 8 OR regexp_matches(f[-1], '(^|-)20[0-9][0-9](-|$)')) AS article FROM w)
      SELECT event_id, url, 'https://Hall.org' || np || q AS plan_key, 'https://Hall.org' || CASE WHEN lp = '/' THEN lp ELSE regexp_replace(lower(lp), '/+$', '') END || q AS locale_twin,
        CASE WHEN len(params) > 0 AND len(list_filter(params, lambda x: NOT regexp_matches(x, '^({addresses.ITEM_PARAMETERS})(=|$)', 'i'))) = 0 THEN 'https://Hall.org' || np END AS query_twin,
        NOT (regexp_matches(p, '(^|/)({addresses.UNPLANNED_FOLDERS})(/|$|\\.)', 'i') OR regexp_matches(p, '\\.({addresses.UNPLANNED_FILES})$', 'i') OR regexp_matches(q, '[?&](s|q|replytocom|share|print|add-to-cart)=', 'i')) AS plannable, article,
        CASE WHEN p = '/' OR {_sql_has("CONTACT")} THEN 1 WHEN p LIKE '%.pdf' THEN CASE WHEN {_sql_has("MENU")} OR {_sql_has("COMMERCE")} THEN 4 WHEN {_sql_has("HIRE")} THEN 2 ELSE 3 END
          WHEN {_sql_has("MENU")} OR {_sql_has("COMMERCE")} OR article THEN 4 WHEN {_sql_has("IDENTITY")} THEN 1 WHEN {_sql_has("HIRE")} THEN 2 ELSE 3 END AS tier FROM a""",
)
def url_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    u = F.col("url")
    rows = table(spark, sf_dir, "events").select(e, F.concat(F.lit("https://Hall.org"), pick(PATHS, e), pick(QUERIES_OF, F.floor(e / 28))).alias("url"))
    return rows.select(
        e, u, addresses.plan_key(u).alias("plan_key"), addresses.locale_twin(u).alias("locale_twin"), addresses.query_twin(u).alias("query_twin"), addresses.plannable(u).alias("plannable"),
        addresses.article_like(u).alias("article"), addresses.page_tier(u, F.lit("")).alias("tier"),
    )


@register(
    "public_addresses",
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INT) AS a, CAST(l_suppkey * 37 % 256 AS INT) AS b, CAST(l_orderkey % 3 AS INT) AS c, l_linenumber AS d FROM lineitem), n AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 300 ELSE a END AS aa FROM a)
      SELECT l_orderkey, l_linenumber, aa || '.' || b || '.' || c || '.' || d AS address, CASE WHEN aa < 256 THEN NOT (aa IN (0, 10, 127) OR aa = 100 AND b BETWEEN 64 AND 127 OR aa = 169 AND b = 254 OR aa = 172 AND b BETWEEN 16 AND 31 OR aa = 192 AND b = 0 AND c IN (0, 2)
        OR aa = 192 AND b = 168 OR aa = 198 AND b IN (18, 19) OR aa = 198 AND b = 51 AND c = 100 OR aa = 203 AND b = 0 AND c = 113 OR aa >= 224) END AS public FROM n""",
)
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("l_linenumber") == 7, 300).otherwise(F.col("l_partkey") % 256)
    text = F.concat_ws(".", first.cast("string"), (F.col("l_suppkey") * 37 % 256).cast("string"), (F.col("l_orderkey") % 3).cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("address")).withColumn("public", addresses.public_ipv4(F.col("address")))


TARGETS = ("https://hall.org/x", "https://www.hall.org/", "http://hall.org/", "ftp://hall.org/", "https://tickets.hall.org/", "https://other.com/", "", None, "/relative", "https://10.0.0.1/", "https://a.local/", "https://hall.org/%22x", "https://cdn.hall.org/")
MODES = ("ENTRY", "ROBOTS", "PAGE")


@register(
    "redirect_reasons",
    f"""WITH r AS (SELECT event_id, {sql_pick(TARGETS, "event_id")} AS t, {sql_pick(MODES, "event_id // 13")} AS mode FROM events)
      SELECT event_id, mode, CASE WHEN t IS NULL OR t = '' THEN 'MISSING_LOCATION' WHEN t LIKE '/%' THEN 'INVALID_LOCATION' WHEN t LIKE 'http:%' THEN 'HTTPS_DOWNGRADE' WHEN t LIKE 'ftp:%' THEN 'NON_HTTPS_SCHEME' WHEN t LIKE '%10.0.0.1%' OR t LIKE '%.local/%' OR t LIKE '%\\%22%' ESCAPE '\\' THEN 'NON_PUBLIC_TARGET'
        WHEN t LIKE 'https://hall.org/%' THEN CASE WHEN mode = 'ROBOTS' THEN 'SAME_ORIGIN' ELSE 'GRANTED_ORIGIN' END WHEN t LIKE 'https://cdn.%' AND mode <> 'ROBOTS' THEN 'GRANTED_ORIGIN'
        WHEN t LIKE 'https://www.%' THEN CASE mode WHEN 'ROBOTS' THEN 'ROBOTS_WWW_APEX' WHEN 'ENTRY' THEN 'WWW_APEX_CANONICAL' ELSE 'UNEVIDENCED_SUBDOMAIN' END WHEN t LIKE '%.hall.org/%' THEN 'UNEVIDENCED_SUBDOMAIN' ELSE 'CROSS_SITE' END AS reason FROM r""",
)
def redirect_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, pick(TARGETS, e).alias("location"), pick(MODES, F.floor(e / 13)).alias("mode"))
    granted = F.array(F.lit("https://hall.org"), F.lit("https://cdn.hall.org"))
    return rows.select(e, "mode", addresses.redirect_reason(F.lit("https://hall.org/start"), F.col("location"), F.col("mode"), granted).alias("reason"))


RETRIES = ("120", " 7 ", "Sat, 20 Jan 2024 00:01:00 GMT", "Fri, 19 Jan 2024 23:00:00 GMT", "soon", None, "Sat, 20 Jan 2024 01:00:00 GMT", "-5")


@register(
    "retry_delays",
    f"""WITH r AS (SELECT event_id, {sql_pick(RETRIES, "event_id")} AS h FROM events) SELECT event_id, CASE WHEN regexp_matches(h, '^\\s*[0-9]+\\s*$') THEN CAST(trim(h) AS BIGINT)
      WHEN h LIKE '%GMT' AND strptime(h[6:25], '%d %b %Y %H:%M:%S') >= TIMESTAMP '{AS_OF}' THEN CAST(epoch(strptime(h[6:25], '%d %b %Y %H:%M:%S')) - epoch(TIMESTAMP '{AS_OF}') AS BIGINT) END AS seconds FROM r""",
)
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", addresses.retry_seconds(pick(RETRIES, F.col("event_id")), as_of()).alias("seconds"))


#: Domains and what they are, as a table; a real one is a parameter of any length.
DOMAIN_KINDS = (("eventbrite.co.uk", "TICKETING"), ("wordpress.com", "AGGREGATOR"), ("github.io", "CACHED"), ("example.com", "SOCIAL"), ("events.example.com", "DIRECTORY"), ("hall.org.za", "DIRECTORY"))


@register(
    "host_rejections",
    f"""WITH h AS (SELECT event_id, {_HOST} AS host FROM events), d AS (SELECT * FROM (VALUES {", ".join(f"({quoted(d)}, {quoted(k)})" for d, k in DOMAIN_KINDS)}) v(domain, kind))
      SELECT event_id, host, (SELECT arg_max(kind, length(domain)) FROM d WHERE host = domain OR ends_with(host, '.' || domain)) AS kind FROM h""",
)
def host_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.concat(pick(FIRSTS, e), pick(ENDINGS, F.floor(e / 5))).alias("host"))
    return linking.by_domain(rows, spark.createDataFrame(DOMAIN_KINDS, "domain string, kind string"), "event_id", "host", "kind")


@register(
    "page_anchors",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a\b[^>]*?href="[^"]*"[^>]*>[^<]*</a>', 0, 'i')) AS a FROM pages), b AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1, 'i') AS href, lower(regexp_extract(a, '>([^<]*)</a>', 1, 'i') || ' ' || regexp_extract(a, 'href="([^"]*)"', 1, 'i')) AS t FROM a),
      c AS (SELECT page_id, href, CAST(contains(t, 'th') AS INT) + CAST(contains(t, 'la') AS INT) + CAST(contains(t, 'er') AS INT) + CAST(contains(t, 'con') AS INT) AS score FROM b)
      SELECT page_id, href, max(score) AS score, row_number() OVER (PARTITION BY page_id ORDER BY max(score) DESC, href) AS position FROM c WHERE score > 0 GROUP BY 1, 2""",
)
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.ranked_links(linking.anchors(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html"), "page_id", ["th", "la", "er", "con"])


@register(
    "event_links",
    f"""WITH u AS (SELECT user_id AS page, {sql_pick(("/events/a", "/about", "/gigs/may-2024/x", "/shows", "/whats-on/2024", "/live/x/y", "/prices"), "event_id")} AS href, {sql_pick(("Next", "Sat night", "Tickets"), "event_id // 7")} AS label FROM events),
      s AS (SELECT page, href, len(list_filter(string_split(href, '/'), lambda x: x <> '')) > 1 AS deeper, regexp_matches(label || ' ' || href, '\\b(20[0-9]{{2}}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)\\b', 'i') AS dated,
        regexp_matches(href, '(^|/)(events?|gigs?|shows?|tour|live|whats[-_]?on|calendar|concerts?)(/|$)', 'i') AS event FROM u)
      SELECT page, href, max(CAST(deeper AS INT) + 2 * CAST(dated AS INT)) AS score FROM s WHERE event AND (deeper OR dated) GROUP BY 1, 2""",
)
def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), pick(("/events/a", "/about", "/gigs/may-2024/x", "/shows", "/whats-on/2024", "/live/x/y", "/prices"), e).alias("href"), pick(("Next", "Sat night", "Tickets"), F.floor(e / 7)).alias("label"))
    return linking.event_links(rows, "page", F.lit(1))


@register(
    "useful_links",
    f"""WITH u AS (SELECT user_id AS page, {sql_pick(("/events/a", "/about", "/Gigs/may-2024", "/private-hire", "/whats-on/2024", "/search/events", "/venue-hire/rooms"), "event_id")} AS href, {sql_pick(("Next", "What's on", "Contact", "Live dates"), "event_id // 7")} || ' ' || event_type AS label FROM events),
      s AS (SELECT page, href, list_sum(list_transform(['contact', 'hire', 'view', 'purchase'], lambda t: CAST(contains(lower(label || ' ' || href), t) AS INT))) + CASE WHEN regexp_matches(href, '(^|/)(events?|gigs?|shows?|tour|live|whats[-_]?on|calendar|concerts?)(/|$)', 'i') THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(label, '\\b(events?|gigs?|shows?|tour dates?|live dates?|what''?s on|calendar|concerts?)\\b', 'i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(href, '/events?/', 'i') THEN 1 ELSE 0 END AS score FROM u WHERE NOT contains(href, 'search'))
      SELECT page, href, CAST(max(score) AS INT) AS score, row_number() OVER (PARTITION BY page ORDER BY max(score) DESC, href) AS position FROM s WHERE score > 0 GROUP BY 1, 2""",
)
def useful_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    href = pick(("/events/a", "/about", "/Gigs/may-2024", "/private-hire", "/whats-on/2024", "/search/events", "/venue-hire/rooms"), e)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), href.alias("href"), F.concat_ws(" ", pick(("Next", "What's on", "Contact", "Live dates"), F.floor(e / 7)), "event_type").alias("label"))
    return linking.ranked_links(rows, "page", ["contact", "hire", "view", "purchase"], events=True)
