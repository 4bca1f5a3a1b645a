"""Readers of pages on their table of nodes: tables and lists under headings, events in articles and cards, links by place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.functions import capacities
from venuelake.functions.text import told_number
from venuelake.sources import markup

HEADINGS = ("h1", "h2", "h3", "h4")
#: Paths of event pages, class words and texts of their parts.
EVENT_PATH = r"(?i)/(?:events?|gigs?|shows?|concerts?|calendar|whats[-_]?on|live|tour)/.+"
TICKET_TEXT = r"(?i)\b(?:tickets?|rsvp|book(?:ing)?)\b"
INSTANT = r"(?i)T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})$"
DESCRIPTION_CLASS = r"\bsqs-html-content\b"
#: Headings that name no space, whatever stands in them.
NO_SPACE_START = r"(?i)^(?:ideal for|capacities|capacity|our spaces|venue spaces|the space|rooms|facilities|venue|contact|home|gallery|events|newsletter|more at|venue hire)"
NO_SPACE_WORDS = r"(?i)\b(?:where|included|signup|follow|blog|homepage|experience|everything|enquiry|opening hours|opening times|access(?:ible|ibility)?|step[- ]free|wheelchair|tickets?|booking|parking|toilets?|companions?|assistance|performances?|event|capacity)\b"
NO_SPACE_WHOLE = r"(?i)^(?:private|private hire|hire|(?:conference|corporate|wedding)\s+venue)$"


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(name))


def heading_space(heading: Column) -> Column:
    """The space that a heading names: up to six capitalised words or numbers; null if it is about something else."""
    name = F.regexp_replace(heading, r"(?i)\s+(?:hire|facilities)$", "")
    words = F.filter(F.split(F.regexp_replace(name, "[():/]", ""), r"\s+"), lambda w: w != "")
    fits = heading.rlike("^[A-Za-z]") & ~heading.rlike(NO_SPACE_START) & ~heading.rlike(NO_SPACE_WORDS) & ~heading.rlike(NO_SPACE_WHOLE) & ~heading.rlike("[.!?]$")
    fits &= (F.size(F.split(heading, r"\s+")) <= 6) & F.forall(words, lambda w: w.rlike(r"^(?:[A-Z][A-Za-z0-9'&-]*|\d+)$"))
    return F.when(fits, name)


def _under_headings(read: DataFrame) -> DataFrame:
    """Elements with the text of the heading before each in its page, if any."""
    before = Window.partitionBy("id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("heading", F.last(F.when(F.col("tag").isin(*HEADINGS), F.col("content")), ignorenulls=True).over(before))


#: The elements that `tables` and `definition_capacities` read.
TABLE_TAGS, LIST_TAGS = (*HEADINGS, "table", "td", "th"), (*HEADINGS, "dl", "dt", "dd")


def tables(nodes: DataFrame) -> DataFrame:
    """(id, node, heading, rows): each table's rows of cells' texts, rows and cells in order. A cell belongs to the nearest row
    and table around it, so a table within a cell is a table of its own; its text is part of that cell's too. Nodes, or elements
    of TABLE_TAGS; a page's are dealt to a task once, for the heading and the rows."""
    return _tables(nodes, lambda placed: placed)


def _tables(nodes: DataFrame, with_cell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The tables with what `with_cell` makes of the column `cell`, a cell's text and else null, before cells meet."""
    is_cell = markup.closest("tr").isNotNull() & markup.closest("table").isNotNull() & (F.element_at("path", -1)["tag"] == "tr")
    read = markup.with_text(nodes, ~F.col("tag").isin("td", "th") | is_cell, TABLE_TAGS)
    placed = read.select("id", "node", "tag", "content", F.when(F.col("tag") == "table", F.col("node")).otherwise(markup.closest("table")).alias("table"), F.when(F.col("tag") != "table", markup.closest("tr")).alias("row"))
    texts = placed.withColumns({"cell": F.when(F.col("tag").isin("td", "th"), F.col("content")), "content": F.when(F.col("tag").isin(*HEADINGS), F.col("content"))})
    dealt = with_cell(texts).repartition("id")
    headed = _under_headings(dealt).filter(~F.col("tag").isin(*HEADINGS))
    ordered = lambda column: F.transform(F.array_sort(F.collect_list(column)), lambda c: c["value"])
    told = F.max(F.when(F.col("tag") == "table", F.col("heading"))).alias("heading")
    rows = headed.groupBy("id", "table", "row").agg(ordered(F.when(F.col("tag") != "table", F.struct("node", F.col("cell").alias("value")))).alias("cells"), told)
    whole = rows.groupBy("id", F.col("table").alias("node")).agg(F.max("heading").alias("heading"), ordered(F.when(F.size("cells") > 0, F.struct("row", F.col("cells").alias("value")))).alias("rows"))
    return whole.filter(F.size("rows") > 0)


def table_capacities(nodes: DataFrame) -> DataFrame:
    """(id, node, space, layout, count) of the capacities that tables state. A table of layouts and counts without a head is about
    the space that the heading before it names."""
    read = _tables(nodes, lambda placed: capacities.read_cells(placed, "cell")).withColumn("named", heading_space(F.col("heading"))).select("id", "node", "named", "rows")
    found = capacities.table_facts(read)
    return found.select("id", "node", F.coalesce("space", "named").alias("space"), "layout", "count")


def definition_capacities(nodes: DataFrame) -> DataFrame:
    """(id, node, space, layout, count, statement) of definition lists: a term that names a layout and the count right after it;
    the space is that of the heading before the list. Terms and their texts are children of the list. Nodes, or elements of
    LIST_TAGS; a page's are dealt to a task once, for all three."""
    read = markup.with_text(nodes, ~F.col("tag").isin("dt", "dd") | (F.element_at("path", -1)["tag"] == "dl"), LIST_TAGS)
    placed = read.select("id", "node", "tag", "content", F.when(F.col("tag") == "dl", F.col("node")).otherwise(markup.closest("dl")).alias("list"))
    headed = _under_headings(placed.repartition("id")).filter(~F.col("tag").isin(*HEADINGS))
    order = Window.partitionBy("id", "list").orderBy("node")
    first = F.first("heading").over(order.rowsBetween(Window.unboundedPreceding, 0))  # the list itself comes before its parts
    after = headed.withColumn("named", first).withColumn("term", F.when(F.lag("tag").over(order) == "dt", F.lag("content").over(order))).filter("tag = 'dd' and term is not null")
    facts = after.select("id", "node", heading_space(F.col("named")).alias("space"), capacities.layout_of(F.col("term")).alias("layout"), capacities.count_of(F.col("content")).alias("count"), F.concat_ws(" ", "term", "content").alias("statement"))
    return facts.filter("layout is not null and count is not null")


def links(nodes: DataFrame) -> DataFrame:
    """(id, node, href, label, navigation): links in order, with whether they stand in a menu, header or footer."""
    found = markup.with_text(nodes, attribute("href").isNotNull(), ("a",))
    return found.select("id", "node", attribute("href").alias("href"), F.col("content").alias("label"), markup.closest("nav", "header", "footer").isNotNull().alias("navigation"))


#: Pictures that are none, and what their address, text and place on the page tell of their role.
PLACEHOLDER = r"(?i)(?:^data:|blank\.gif|spacer\.gif|placeholder|lazy[-_]?load|transparent\.png|1x1)"
TRACKER = r"(?i)(?:facebook\.com/tr|google-analytics|doubleclick|googletagmanager|pixel\.|/pixel\b|analytics\.)"
LAZY = ("data-src", "data-lazy-src", "data-original", "data-lazy", "data-full", "data-large_image")
LOGO_PLACE = r"(?i)(?:^|[\s_])(?:custom-logo|site-logo|navbar-brand|logo)(?:$|[\s_])"
HERO_PLACE = r"(?i)\b(?:hero|banner|masthead)\b"
GALLERY_PLACE = r"(?i)gallery|carousel|slider|swiper|lightbox"
ROLE_TEXTS = (
    ("EXTERIOR", r"(?i)\b(?:exterior|outside|facade|façade|building front)\b"), ("INTERIOR", r"(?i)\b(?:interior|inside)\b"),
    ("SPACE", r"(?i)\b(?:room|hall|suite|space|studio|auditorium|ballroom|theatre|terrace|bar|lounge)\b"),
)
LEAST_PIXELS = 50


def _sources(value: Column) -> Column:
    """array<(width, score, url)> of a srcset: its width, or its density as a thousand each; null without one."""
    parts = F.transform(F.split(value, r",\s+(?=\S)"), lambda p: F.split(F.trim(p), r"\s+"))
    width = lambda p: told_number(F.regexp_extract(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"^(\d+)w$", 1))
    density = lambda p: told_number(F.regexp_extract(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"^(\d+(?:\.\d+)?)x$", 1), "double")
    each = F.transform(parts, lambda p: F.struct(width(p).alias("width"), F.coalesce(width(p).cast("double"), density(p) * 1000, F.lit(1.0)).alias("score"), F.get(p, F.lit(0)).alias("url")))
    return F.when(value.isNotNull(), F.filter(each, lambda s: (s["url"] != "") & ~s["url"].rlike("(?i)^data:")))


def images(nodes: DataFrame, pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, node, url, alt, role) of a page's pictures, each address once, in order: of the best of each srcset the widest, else the first lazy
    source, else its own unless that is a placeholder. Trackers and pictures under 50 pixels go. The role goes by logos,
    by elements of hero and gallery classes around it, which its path tells, and by its text; a gallery's page makes all its
    others GALLERY. Nodes, or elements of the tag img."""
    marks = F.concat_ws(" ", attribute("class"), attribute("id"))
    own = nodes.filter("tag = 'img'")
    within = lambda pattern, *but: F.exists("path", lambda a: ~a["tag"].isin("", *but) & F.concat_ws(" ", a["class"], a["id"]).rlike(pattern))
    best = lambda c: F.element_at(F.array_sort(c, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1)
    sets = F.array(_sources(F.coalesce(attribute("data-srcset"), attribute("data-lazy-srcset"))), _sources(attribute("srcset")))
    bests = F.transform(F.filter(sets, lambda c: F.size(c) > 0), best)
    widest = F.try_element_at(F.array_sort(bests, lambda a, b: F.coalesce(b["width"], F.lit(0)) - F.coalesce(a["width"], F.lit(0))), F.lit(1))
    lazy = F.coalesce(*[F.when(~attribute(k).rlike("(?i)^data:|^$"), attribute(k)) for k in LAZY])
    plain = F.when(~attribute("src").rlike(PLACEHOLDER) & (attribute("src") != ""), attribute("src"))
    pixels = lambda k: told_number(F.regexp_extract(F.coalesce(attribute(k), F.lit("")), r"^\s*(\d+)", 1))
    # the widest is sought once a picture: what it tells is a row of the generator, which filters do not repeat below it
    picked = lambda w: F.struct(F.coalesce(w["url"], lazy, plain).alias("url"), F.coalesce(w["width"], pixels("width")).alias("width"), F.when(w["width"].isNull(), pixels("height")).alias("height"))
    found = own.select("id", "node", within(LOGO_PLACE, "body", "html").alias("logo"), within(HERO_PLACE).alias("hero"), within(GALLERY_PLACE).alias("gallery"), F.coalesce(attribute("alt"), F.lit("")).alias("alt"), marks.alias("marks"), F.inline_outer(F.transform(F.array(widest), picked)))
    sound = F.col("url").isNotNull() & ~F.col("url").rlike(TRACKER) & (F.coalesce("width", F.lit(LEAST_PIXELS)) >= LEAST_PIXELS) & (F.coalesce("height", F.lit(LEAST_PIXELS)) >= LEAST_PIXELS)
    paths = pages.select(F.col(id_col).alias("id"), F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^https?://[^/?#]+([^?#]*)", 1).alias("page_path"))
    placed = found.filter(sound).join(paths, "id", "left")
    file = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    role = F.when(F.concat_ws(" ", file, "alt", "marks").rlike("(?i)logo") | F.col("logo"), "LOGO").when(F.col("hero"), "HERO")
    for name, pattern in ROLE_TEXTS:
        role = role.when(F.col("alt").rlike(pattern), name)
    role = role.when(F.col("page_path").rlike("(?i)gallery|photos") | F.col("gallery"), "GALLERY").otherwise("OTHER")
    first = placed.withColumn("role", role).groupBy("id", "url").agg(F.min_by(F.struct("node", "alt", "role"), "node").alias("x"))
    return first.select("id", "x.node", "url", "x.alt", "x.role")


def article_events(nodes: DataFrame, pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, title, external_id, start_at, end_at, venue, description, ticket_url): the event of each page whose path is that of
    an event and whose first article has a title. Instants are those of time elements that tell their zone, in UTC; the ticket
    link is the first https one that speaks of tickets, a link within the site made whole. Whether a node is the article's
    is a test of its interval."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).filter(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).rlike(EVENT_PATH))
    first = nodes.filter("tag = 'article'").groupBy("id").agg(F.min_by(F.struct(F.col("node").alias("begin"), F.col("last").alias("end"), F.coalesce(attribute("data-event-id"), attribute("data-item-id")).alias("own_id")), "node").alias("a")).join(urls, "id").select("id", "url", "a.*")
    inner = nodes.join(first, "id").filter("node > begin and node <= end")
    parts = markup.with_text(inner, F.lit(True), ("h1", "div", "a", "time"))
    of = lambda test, value: F.min_by(F.when(test, value), F.when(test, F.col("node")))
    is_div, moment = F.col("tag") == "div", attribute("datetime")
    place = is_div & ((attribute("itemprop") == "location") | attribute("data-venue").isNotNull() & (attribute("data-venue") != ""))
    about = is_div & ((attribute("itemprop") == "description") | attribute("class").rlike(DESCRIPTION_CLASS))
    target = attribute("href")
    whole = F.when(target.rlike("^/[^/]"), F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), target)).otherwise(target)
    ticket = (F.col("tag") == "a") & F.col("content").rlike(TICKET_TEXT) & whole.rlike(r"(?i)^https://[^/@\s]+\.[a-z]{2,}")
    found = parts.groupBy("id").agg(
        of(F.col("tag") == "h1", F.col("content")).alias("title"), F.min("own_id").alias("own_id"),
        F.array_sort(F.collect_list(F.when((F.col("tag") == "time") & moment.rlike(INSTANT), F.struct("node", F.try_to_timestamp(F.regexp_replace(moment, r"(?i)(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")).alias("value"))))).alias("times"),
        of(F.coalesce(place, F.lit(False)), F.col("content")).alias("venue"), of(F.coalesce(about, F.lit(False)), F.substring("content", 1, 10_000)).alias("description"), of(F.coalesce(ticket, F.lit(False)), whole).alias("ticket_url"),
    )
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    utc = lambda i: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.get(F.filter("times", lambda t: t["value"].isNotNull()), F.lit(i))["value"].cast("timestamp_ntz"))
    squeezed_id = F.substring(markup.squeezed(F.col("own_id")), 1, 256)
    return found.filter("title <> ''").select(
        "id", "title", F.when(squeezed_id != "", squeezed_id).alias("external_id"), utc(0).alias("start_at"), utc(1).alias("end_at"),
        blank("venue").alias("venue"), "description", "ticket_url",
    )


#: The elements that `card_events` reads.
CARD_TAGS = ("h2", "p", "a", "img", "div")


def card_events(nodes: DataFrame) -> DataFrame:
    """(id, node, title, start_at, venue, ticket_url, image_url) of the cards of an events page: div elements of the classes
    grid_item and event, with a date and a title. A card without a time of its own starts at 19:00; times are London's, given
    in UTC. A part belongs to the nearest card around it; the first of its kind counts. Nodes, or elements of CARD_TAGS."""
    tag, css = F.col("tag"), attribute("class")
    has = lambda text, name: text.rlike(rf"(?:^|\s){name}(?:\s|$)")
    of_card = lambda tag, text: (tag == "div") & text.contains("grid_item") & has(text, "grid_item") & has(text, "event")
    # of nested cards the innermost, which is the last on the path
    around = F.try_element_at(F.filter("path", lambda a: of_card(a["tag"], a["class"])), F.lit(-1))["node"]
    told = (tag.isin("h2", "img")) | attribute("data-date").isNotNull() | ((tag == "p") & (has(css, "date") | has(css, "location"))) | ((tag == "a") & has(css, "event_link"))
    texts = markup.with_text(nodes, told, CARD_TAGS).withColumn("card", F.when(of_card(tag, css), F.col("node")).otherwise(around)).filter("card is not null")
    said = {
        "title": F.when(tag == "h2", F.col("content")), "day": attribute("data-date"), "told": F.when((tag == "p") & has(css, "date"), F.col("content")), "venue": F.when((tag == "p") & has(css, "location"), F.col("content")),
        "ticket_url": F.when((tag == "a") & has(css, "event_link"), attribute("href")), "image_url": F.when(tag == "img", attribute("src")),
    }
    # what an element says is found once, then the first of each kind is taken
    parts = texts.select("id", "card", "node", *(value.alias(name) for name, value in said.items()))
    found = parts.groupBy("id", "card").agg(
        *(F.min_by(name, F.when(F.col(name).isNotNull(), F.col("node"))).alias(name) for name in said)
    ).filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("title") != ""))
    pattern = r"(?i)^(\d{1,2}):(\d{2})(AM|PM)\b"
    hour, half = told_number(F.regexp_extract("told", pattern, 1)), F.upper(F.regexp_extract("told", pattern, 3))
    clock = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    time = F.coalesce(F.concat(F.lpad(clock.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract("told", pattern, 2)), F.lit("19:00"))
    start = F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), F.try_to_timestamp(F.concat_ws(" ", "day", time), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))
    return found.select("id", F.col("card").alias("node"), "title", start.alias("start_at"), F.when(F.col("venue") != "", F.col("venue")).alias("venue"), "ticket_url", "image_url")
