"""Queries on the table of nodes of pages. Where the driver's pages lack a part, such as tables or events, pages are written
around the texts and figures of other tables, with end tags left out and markup inside texts, and the SQL starts from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.operators import page_reading
from venuelake.plans.catalog import pick, register
from venuelake.sources import markup
from venuelake.sources.shared import stored
from venuelake.sources.tables import table

_DECODED = """replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;', '<'), '&gt;', '>')"""
_PLAIN = f"trim(regexp_replace({_DECODED}, '&amp;?', '&', 'g'))"
_SPACES = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The table of nodes, parsed once for all that reads it."""
    return stored(markup.nodes(pages, key, html), "nodes")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


@register(
    "page_lines",
    f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*$', ''), '(?s)<head>.*?</head>', ''), '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g') AS h FROM pages),
      l AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(h, '</?(?:p|li|ul|nav|div|article|h1|footer)(?: [^>]*)?>|<br>', chr(10), 'g'), chr(10)), lambda t: {_PLAIN.format("regexp_replace(t, '<[^>]*>', '', 'g')")}), lambda t: t <> '') AS lines FROM b)
      SELECT page_id, unnest(generate_series(1, len(lines))) AS position, unnest(lines) AS text FROM l""",
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = markup.shown_lines(_nodes(_pages(spark, sf_dir), "page_id", "html"))
    counted = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return counted.select(F.col("id").alias("page_id"), F.posexplode("lines").alias("at", "x")).select("page_id", (F.col("at") + 1).cast("long").alias("position"), "x.text")


@register(
    "placed_links",
    f"""WITH h AS (SELECT page_id, regexp_replace(html, '<[^>]*$', '') AS h FROM pages), m AS (SELECT page_id, h, regexp_extract(h, '(?s)<nav>.*?</nav>') AS nav FROM h),
      a AS (SELECT page_id, unnest(regexp_extract_all(nav, '(?s)<a href="[^"]*">.*?</a>')) AS a, true AS navigation FROM m UNION ALL SELECT page_id, unnest(regexp_extract_all(replace(h, nav, ''), '(?s)<a href="[^"]*">.*?</a>')), false FROM m)
      SELECT page_id, {_PLAIN.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, {_PLAIN.format("regexp_extract(a, '(?s)>(.*)</a>', 1)")} AS label, navigation FROM a""",
)
def placed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_reading.links(_nodes(_pages(spark, sf_dir), "page_id", "html")).select(F.col("id").alias("page_id"), "href", "label", "navigation")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


@register(
    "article_events",
    f"""WITH d AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS text, {_SPACES.format("substr(coalesce(text, ''), 1, 60)")} AS title, {_SPACES.format("coalesce(text, '')")} AS about FROM documents)
      SELECT doc_id, title, source || ' ' || doc_id AS external_id, CASE WHEN n_chars % 5 > 0 THEN TIMESTAMP '2024-01-01 17:30:00' + INTERVAL 1 DAY * (n_chars % 365) END AS start_at, CASE WHEN n_chars % 5 > 1 THEN TIMESTAMP '2024-01-01 23:00:00' + INTERVAL 1 DAY * (n_chars % 365) END AS end_at,
        'Hall of ' || source AS venue, substr(about, 1, 10000) AS description, CASE lang WHEN 'en' THEN 'https://' || source || '.example/t/' || doc_id WHEN 'de' THEN 'https://' || lang || '.example.org/book/' || doc_id END AS ticket_url
      FROM d WHERE lang <> 'es' AND title <> ''""",
)
def article_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text, number, lang, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string"), F.col("lang"), F.col("n_chars")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).cast("string")
    starts = F.when(n % 5 > 0, F.concat(F.lit("<time datetime='"), day, F.lit("T19:30:00+02:00'>at night</time>"))).otherwise("<time datetime='tonight'>tonight</time>")
    ends = F.when(n % 5 > 1, F.concat(F.lit("<time datetime="), day, F.lit("T23:00Z>late</time>"))).otherwise("")
    ticket = F.when(lang == "en", F.concat(F.lit("<a href='https://"), F.col("source"), F.lit(".example/t/"), number, F.lit("'>Get <b>tickets</b></a>"))).when(lang == "de", F.concat(F.lit("<a href='/book/"), number, F.lit("'>Book now</a>"))).otherwise("<a href='mailto:x@example.org'>Tickets</a>")
    html = F.concat(
        F.lit("<body><h1>Site</h1><div itemprop='location'>Not here</div><main><ul><li><article data-event-id=' "), _escaped(F.col("source")), F.lit("\n"), number, F.lit("'><h1>"), _escaped(F.substring(text, 1, 60)), F.lit("<script>no()</script></h1>"), starts,
        F.lit("<div class=x>skip</div><p><div itemprop=location>Hall <i>of</i>\n"), _escaped(F.col("source")), F.lit("</div>"), ends, F.lit("<div class='y sqs-html-content'><p hidden>no</p>"), _escaped(text), F.lit("</div><a href='/about'>About</a>"), ticket, F.lit("</article><li><article><h1>Other</h1></article></ul>"),
    )
    url = F.concat(F.lit("https://"), lang, F.lit(".example.org"), F.when(lang == "es", "/about/").otherwise("/whats-on/"), number)
    pages = d.select("doc_id", url.alias("url"), html.alias("html"))
    return page_reading.article_events(_nodes(pages, "doc_id", "html"), pages, "doc_id", "url").withColumnRenamed("id", "doc_id")


_LINES = "SELECT l_orderkey, l_linenumber, 'Wing ' || l_linestatus AS mode, CAST(l_quantity AS INT) AS quantity, l_returnflag, CAST(floor(l_extendedprice) AS INT) % 900 AS price FROM lineitem"


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order: a list, a table and, in one of its cells, another table, with the figures of its items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Wing "), "l_linestatus").alias("mode"), F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag", (F.floor("l_extendedprice") % 900).cast("int").alias("price"))
    name = F.concat_ws(" ", "mode", F.col("l_linenumber").cast("string"))
    row = F.concat(F.lit("<tr><td>"), name, F.lit("<td><b>"), F.col("quantity").cast("string"), F.lit("</b> guests<td>"), F.when(F.col("l_returnflag") == "N", "-").otherwise(F.format_number("price", 0)))
    cards = F.concat(F.lit('<div class="grid_item event '), F.col("l_returnflag"), F.lit('" data-date="2024-'), F.lpad((1 + F.col("quantity") % 12).cast("string"), 2, "0"), F.lit("-15\"><h2>"), name, F.lit(" <i>live</i></h2><p class='date'>"), F.when(F.col("l_returnflag") == "N", "doors late").otherwise(F.concat((1 + F.col("price") % 12).cast("string"), F.lit(":05pm start"))), F.lit("<p class='location'>Stage "), F.col("l_returnflag"), F.lit("</div>"))
    grouped = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row"), cards.alias("card"), "quantity", "price"))).alias("x"))
    joined = lambda field: F.array_join(F.transform("x", lambda i: i[field]), "")
    least = F.array_min(F.transform("x", lambda i: i["quantity"]))
    inner = F.concat(F.lit("<table><tr><td>Seated<td>"), (least + 1000).cast("string"), F.lit("<tr><td>Doors<td>7</table>"))
    html = F.concat(
        F.lit("<h2>Hall "), F.col("l_orderkey").cast("string"), F.lit(" hire</h2><dl><dt>Banquet<dd>"), (least + 100).cast("string"), F.lit("<dd>9<dt>Opens<dd>8</dl><h3>Contact us</h3>"),
        F.lit("<table><thead><tr><th>Room<th>Theatre<th>Standing<tbody>"), joined("row"), F.lit("<tr><td>x"), inner, F.lit("</table><main>"), joined("card"), F.lit("</main>"),
    )
    return grouped.select("l_orderkey", html.alias("html"))


@register(
    "page_capacities",
    f"""WITH l AS ({_LINES}), f AS (SELECT l_orderkey, min(quantity) AS q FROM l GROUP BY 1)
      SELECT l_orderkey, mode || ' ' || l_linenumber AS space, 'theatre' AS layout, quantity AS number FROM l UNION ALL SELECT l_orderkey, mode || ' ' || l_linenumber, 'standing', price FROM l WHERE l_returnflag <> 'N' AND price > 0
      UNION ALL SELECT l_orderkey, NULL, 'seated', q + 1000 FROM f""",
)
def page_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_reading.table_capacities(markup.elements(_order_pages(spark, sf_dir), "l_orderkey", "html", page_reading.TABLE_TAGS))
    return found.select(F.col("id").alias("l_orderkey"), "space", "layout", F.col("count").alias("number"))


@register("listed_capacities", f"""WITH l AS ({_LINES}) SELECT l_orderkey, 'Hall ' || l_orderkey AS space, 'banquet' AS layout, 100 + min(quantity) AS number, 'Banquet ' || (100 + min(quantity)) AS statement FROM l GROUP BY 1""")
def listed_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_reading.definition_capacities(markup.elements(_order_pages(spark, sf_dir), "l_orderkey", "html", page_reading.LIST_TAGS))
    return found.select(F.col("id").alias("l_orderkey"), "space", "layout", F.col("count").alias("number"), "statement")


@register(
    "card_events",
    f"""WITH l AS ({_LINES}), t AS (SELECT *, 1 + price % 12 AS h FROM l), s AS (SELECT *, make_timestamp(2024, 1 + quantity % 12, 15, CASE WHEN l_returnflag = 'N' THEN 19 WHEN h < 12 THEN h + 12 ELSE h END, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 5 END, 0) AS wall FROM t)
      SELECT l_orderkey, mode || ' ' || l_linenumber || ' live' AS title, wall - INTERVAL 1 HOUR * CASE WHEN month(wall) BETWEEN 4 AND 10 THEN 1 ELSE 0 END AS start_at, 'Stage ' || l_returnflag AS venue FROM s""",
)
def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_reading.card_events(markup.elements(_order_pages(spark, sf_dir), "l_orderkey", "html", page_reading.CARD_TAGS)).select(F.col("id").alias("l_orderkey"), "title", "start_at", "venue")


_ALTS = ("Main hall", "Building front", "Inside the bar", "", "Our crest", "Company logo")
_CLASSES = ("site hero", "photo-gallery", "x", "navbar-brand", "banner ad")
_FILES = ("", "a.jpg 300w, ", "a.jpg 1x, ", "data:x 900w, ")


@register(
    "page_images",
    f"""WITH e AS (SELECT event_id, event_type, user_id, ['Main hall', 'Building front', 'Inside the bar', '', 'Our crest', 'Company logo'][1 + event_id % 6] AS alt, ['site hero', 'photo-gallery', 'x', 'navbar-brand', 'banner ad'][1 + event_id // 6 % 5] AS c, event_id // 30 % 4 AS f, 20 + CAST(floor(value) AS INT) AS w FROM events),
      i AS (SELECT event_id, 1 AS k, event_type || user_id || '-wide.jpg' AS url, alt, CASE WHEN contains(alt, 'logo') OR c = 'navbar-brand' THEN 'LOGO' WHEN c IN ('site hero', 'banner ad') THEN 'HERO' WHEN alt = 'Building front' THEN 'EXTERIOR' WHEN alt = 'Inside the bar' THEN 'INTERIOR' WHEN alt = 'Main hall' THEN 'SPACE' WHEN c = 'photo-gallery' OR event_type = 'view' THEN 'GALLERY' ELSE 'OTHER' END AS role FROM e WHERE f <> 2
        UNION ALL SELECT event_id, 2, 'lazy-' || user_id || '.png', '', CASE WHEN event_type = 'view' THEN 'GALLERY' ELSE 'OTHER' END FROM e WHERE w >= 50)
      SELECT event_id, url, alt, role FROM i""",
)
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, "event_type", "user_id", (20 + F.floor("value")).cast("string").alias("w"), F.concat(F.col("event_type"), F.col("user_id").cast("string")).alias("name")).repartition("event_id")
    files = pick(_FILES, F.floor(e / 30))
    best = F.when(F.floor(e / 30) % 4 == 2, F.concat("name", F.lit(".jpg 2x"))).otherwise(F.concat("name", F.lit("-wide.jpg 800w")))
    html = F.concat(
        F.lit("<body class='my logo'><div id='m' class='"), pick(_CLASSES, F.floor(e / 6)), F.lit("'><p><img width=20 srcset='"), files, best, F.lit("' src='"), F.lit("spacer.gif' alt='"), pick(_ALTS, e), F.lit("'><img src='https://www.google-analytics.com/a.gif'></div>"),
        F.lit("<img data-src='lazy-"), F.col("user_id").cast("string"), F.lit(".png' src='data:image/gif;x' width='"), F.col("w"), F.lit("'><img src='placeholder.png'><img data-original='lazy-"), F.col("user_id").cast("string"), F.lit(".png' width=20>"),
    )
    pages = rows.select("event_id", F.concat(F.lit("https://a.org/"), F.when(F.col("event_type") == "view", "photos").otherwise("about")).alias("url"), html.alias("html"))
    return page_reading.images(markup.elements(pages, "event_id", "html", ["img"]), pages, "event_id", "url").select(F.col("id").alias("event_id"), "url", "alt", "role")
