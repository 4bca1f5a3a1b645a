"""Registered queries of what pages tell: capacities, facilities, events, coverage of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import capacities
from venuelake.operators import happenings
from venuelake.plans.catalog import pick, quoted, register, sql_pick
from venuelake.sources.tables import table

CELLS = ("Theatre", "cabaret style", "Banqueting", "seated dinner", "Drinks Reception", "U-shaped", "Hollow Square", "Max capacity:", "Lecture", "Main Hall", "size", "up to 1,200", "250 guests", "0", "123456789", "A room with far too many words in it", "Loft 2", "Room", "99 pax", "Sold out!")
_LAYOUT = ("theatre", "cabaret", "banquet", "dinner", "reception", "u-shape", "hollow-square", "unspecified", "theatre", *[None] * 11)
_COUNT = (*["NULL"] * 11, "1200", "250", "NULL", "NULL", "NULL", "NULL", "NULL", "99", "NULL")
_SPACE = (*[None] * 9, "Main Hall", None, "up to 1,200", "250 guests", None, None, None, "Loft 2", None, "99 pax", None)


@register(
    "table_cells",
    f"SELECT event_id, {sql_pick(_LAYOUT, 'event_id')} AS layout, CAST(([{', '.join(_COUNT)}])[CAST(1 + event_id % 20 AS INT)] AS INT) AS number, {sql_pick(_SPACE, 'event_id')} AS space FROM events",
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    rows = table(spark, sf_dir, "events").select("event_id", pick(CELLS, F.col("event_id")).alias("cell"))
    return rows.select("event_id", capacities.layout_of(c).alias("layout"), capacities.count_of(c).alias("number"), capacities.space_name(c).alias("space"))


@register(
    "capacity_tables",
    """WITH e AS (SELECT event_id, event_id % 3 AS form, 10 + user_id AS n FROM events), s AS (SELECT unnest([1, 2, 3, 4]) AS i)
      SELECT event_id, CASE WHEN form < 2 THEN CASE WHEN i <= 2 THEN 'Main Hall' ELSE 'Loft 2' END END AS space, CASE i % 2 WHEN 1 THEN 'theatre' ELSE 'standing' END AS layout, CAST(n + CASE i WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 1 ELSE 2 END AS INT) AS number
      FROM e, s WHERE i <= CASE WHEN form = 2 THEN 2 ELSE 4 END AND NOT (form < 2 AND i = 4 AND event_id % 2 = 0)""",
)
def capacity_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = F.col("event_id"), 10 + F.col("user_id")
    last = F.when(e % 2 == 0, "-").otherwise((n + 2).cast("string"))
    big = F.format_number(n + 1000, 0)
    normal = F.format_string("<p>x</p><table><tr><th>Room<th>Theatre<th>Size<th>Standing</tr><tr><td>Main <b>Hall</b><td>%s<td>9<td>%s</tr><tr><td>Loft 2</td><td>%s</td><td>8</td><td>%s</td></tr></table>", n.cast("string"), big, (n + 1).cast("string"), last)
    turned = F.format_string("<TABLE class='a'><tr><td>Capacity</td><td>Main Hall</td><td>Loft 2</td></tr><tr><td>Theatre</td><td>%s</td><td>%s</td></tr><tr><td>Standing</td><td>%s</td><td>%s</td></tr></TABLE>", n.cast("string"), (n + 1).cast("string"), big, last)
    plain = F.format_string("<table><tr><td>Theatre</td><td>%s</td></tr><tr><td>Standing</td><td>%s</td></tr><tr><td>Note</td><td>x</td></tr></table><table><tr><td>Theatre</td><td>7</td></tr></table>", n.cast("string"), big)
    dealt = table(spark, sf_dir, "events").select(e, "user_id").repartition(spark.sparkContext.defaultParallelism, e)  # keys only, so that all cores read pages
    pages = dealt.select(e, F.when(e % 3 == 0, normal).when(e % 3 == 1, turned).otherwise(plain).alias("html"))
    each = pages.select(e, F.explode_outer(capacities.table_rows(F.col("html"))).alias("rows"))
    return capacities.table_capacities(each).withColumnRenamed("count", "number")


@register(
    "definition_capacities",
    "SELECT user_id * 1000000 + event_id AS page, 'banquet' AS layout, CAST(20 + event_id % 90 AS INT) AS number FROM events UNION ALL SELECT user_id * 1000000 + event_id, 'unspecified', CAST(1500 AS INT) FROM events WHERE event_id % 2 = 0",
)
def definition_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    html = F.concat(F.lit("<dl><dt>Banquet</dt><dd><b>"), (20 + e % 90).cast("string"), F.lit("</b></dd><dt>Doors</dt><dd>7</dd>\n<dt>Capacity:</dt> <dd>"), F.when(e % 2 == 0, "1,500 people").otherwise("ask"), F.lit("</dd></dl>"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 1000000 + e).alias("page"), html.alias("html"))
    return rows.select("page", F.inline(capacities.definitions(F.col("html")))).withColumnRenamed("count", "number")


STATED = ("Theatre style capacity: {n} and standing {m}.", "Up to {n} guests, {m} seated.", "Capacity of {n} Banquet; 5 standing", "A reception for {n}", "It holds {n} standing or {m} seated, capacity {m}", "Larger reception sets up to {n}; seated 40 x 20", "We cater for 100 – {n} guests", "The cottages hold {n} guests")
_STATED = (  # for each text: (layout, which number, statement) in the order of the patterns
    (("theatre", "n", "Theatre style capacity: {n}"), ("standing", "m", "standing {m}")),
    (("unspecified", "n", "Up to {n} guests"), ("seated", "m", "{m} seated")),
    (("banquet", "n", "Capacity of {n} Banquet"),),
    (),
    (("unspecified", "m", "capacity {m}"), ("standing", "n", "{n} standing"), ("seated", "m", "{m} seated")),
    (("reception", "n", "reception sets up to {n}"),),
    (("unspecified", "n", "cater for 100 – {n} guests"),),
    (),
)


def _stated_sql() -> str:
    parts = []
    for k, facts in enumerate(_STATED):
        for layout, which, statement in facts:
            text = quoted(statement).replace("{n}", "' || n || '").replace("{m}", "' || m || '")
            parts.append(f"SELECT event_id, '{layout}' AS layout, CAST({which} AS INT) AS number, {text} AS statement FROM e WHERE k = {k}")
    return " UNION ALL ".join(parts)


@register("capacity_sentences", f"WITH e AS (SELECT event_id, event_id % 8 AS k, 30 + user_id AS n, 200 + event_id % 77 AS m FROM events) {_stated_sql()}")
def capacity_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.replace(F.replace(pick(STATED, e), F.lit("{n}"), (30 + F.col("user_id")).cast("string")), F.lit("{m}"), (200 + e % 77).cast("string"))
    return table(spark, sf_dir, "events").select(e, F.inline(capacities.sentences(text))).withColumnRenamed("count", "number")


PROSE = ("We have step-free access to all floors. Wi-Fi is fast.", "There is no on-site parking here. A car park", "Sorry, we do not have a raised stage", "The cloakroom is closed", "Licensed bar and PA system. Enjoy", "Nothing of note", "A train station, near; external catering. Kitchen facilities", "A projector and a loading bay. No bedrooms here; suitable for weddings", "Our sunny garden, stage lighting. Three-phase power")
_PROSE = (
    (("accessibility", "step-free access to all floors", "false"), ("wifi", "Wi-Fi is fast", "false")), (("parking", "There is no on-site parking here", "true"),), (("staging", "Sorry, we do not have a raised stage", "true"),),
    (("cloakroom", "The cloakroom is closed", "true"),), (("bar", "Licensed bar and PA system", "false"), ("sound", "PA system", "false")), (), (("publicTransport", "train station, near; external catering", "false"), ("catering", "external catering", "false"), ("kitchen", "Kitchen facilities", "false")),
    (("avProduction", "projector and a loading bay", "false"), ("loadingAccess", "loading bay", "false"), ("accommodation", "No bedrooms here; suitable for weddings", "true"), ("hireSuitability", "suitable for weddings", "false")),
    (("outdoorSpace", "sunny garden", "false"), ("lighting", "stage lighting", "false"), ("power", "Three-phase power", "false")),
)


@register(
    "facility_facts",
    " UNION ALL ".join(f"SELECT event_id, {quoted(f)} AS field, {quoted(s)} AS statement, {r} AS review FROM events WHERE event_id % {len(_PROSE)} = {k}" for k, facts in enumerate(_PROSE) for f, s, r in facts),
)
def facility_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", pick(PROSE, F.col("event_id")).alias("text"))
    return rows.select("event_id", F.inline(capacities.facilities(F.col("text"))))


@register(
    "structured_events",
    """WITH e AS (SELECT event_id, user_id, ts, event_id % 4 AS form FROM events), f AS (SELECT event_id, 'Night ' || user_id AS title, CASE WHEN form = 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS starts,
        CASE WHEN form = 0 THEN 'https://hall.org/' || event_id END AS url, CASE WHEN form <> 1 THEN 'Main Hall' END AS venue FROM e WHERE form < 3)
      SELECT event_id, title, starts, url, venue, sha256(title || '|' || strftime(starts, '%Y-%m-%d %H:%M:%S') || '|' || coalesce(url, '') || '|' || coalesce(venue, '')) AS fingerprint FROM f""",
)
def structured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name, at = F.concat(F.lit("Night "), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    node = F.concat(F.lit('{"@type":"https://schema.org/MusicEvent","name":" '), name, F.lit('","startDate":"'), at, F.lit('+02:00","location":{"name":"Main Hall"}'))
    one = F.concat(node, F.lit(',"url":"https://hall.org/'), e.cast("string"), F.lit('"}'))
    many = F.concat(F.lit('[{"@type":"Person","name":"Jo"},{"@type":"Festival","name":"'), name, F.lit('","startDate":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}]'))
    graph = F.concat(F.lit('{"@context":"x","@graph":['), node, F.lit('},{"@type":"Place"}]}'))
    body = F.when(e % 4 == 0, one).when(e % 4 == 1, many).when(e % 4 == 2, graph).otherwise('{"@type":"Event", broken')
    html = F.concat(F.lit("<p>x</p><script type='application/ld+json'>\n"), body, F.lit("\n</script><script>var a=1</script>"))
    found = happenings.structured_nodes(table(spark, sf_dir, "events").select(e, html.alias("html")), "event_id", "html")
    return found.select("event_id", "title", "starts", "url", "venue", "fingerprint")


@register(
    "calendar_entries",
    """SELECT event_id, 'Night of music, part ' || user_id AS title, date_trunc('second', ts) - CASE event_id % 3 WHEN 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS starts, CASE WHEN event_id % 2 = 0 THEN 'https://hall.org/' || event_id END AS url, 'Hall; side' AS venue FROM events WHERE event_id % 7 > 0""",
)
def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    start = F.when(e % 3 == 0, "DTSTART;VALUE=DATE-TIME;TZID=Africa/Johannesburg:").when(e % 3 == 1, "DTSTART;TZID=Europe/London:").otherwise("DTSTART:")
    stamp = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.when(e % 3 == 2, "Z").otherwise(""))
    title = F.when(e % 7 > 0, F.concat(F.lit("SUMMARY;LANGUAGE=en:Night of\r\n  music\\, part "), F.col("user_id").cast("string"), F.lit("\r\n"))).otherwise("")
    url = F.when(e % 2 == 0, F.concat(F.lit("URL:https://hall.org/"), e.cast("string"), F.lit("\r\n"))).otherwise("")
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), title, start, stamp, F.lit("\r\n"), url, F.lit("LOCATION:Hall\\; side\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    return happenings.calendar_entries(table(spark, sf_dir, "events").select(e, body.alias("body")), "event_id", "body")


@register(
    "merged_events",
    """WITH f AS (SELECT user_id AS site, event_id AS seen, event_id % 3 AS priority, CASE WHEN event_id % 2 = 0 THEN 'u' || event_id % 6 END AS url, CASE WHEN event_id % 5 > 0 THEN ['Big Night!', 'big  night', 'Talk'][1 + event_id // 2 % 3] END AS title, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS starts, CASE WHEN event_id % 4 > 0 THEN 'Hall' END AS venue FROM events),
      i AS (SELECT *, CASE WHEN url IS NOT NULL THEN url || '|' || strftime(starts, '%Y-%m-%d %H:%M:%S') ELSE coalesce(CASE title WHEN 'Talk' THEN 'talk|' WHEN 'Big Night!' THEN 'big night|' WHEN 'big  night' THEN 'big night|' END, '') || strftime(starts, '%Y-%m-%d %H:%M:%S') || '|' || lower(coalesce(venue, '')) END AS identity FROM f)
      SELECT site, identity, arg_min(title, struct_pack(a := priority, b := seen)) FILTER (WHERE title IS NOT NULL) AS title, arg_min(url, struct_pack(a := priority, b := seen)) FILTER (WHERE url IS NOT NULL) AS url, arg_min(venue, struct_pack(a := priority, b := seen)) FILTER (WHERE venue IS NOT NULL) AS venue, count(*) AS sources FROM i GROUP BY 1, 2""",
)
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), e.alias("seen"), (e % 3).alias("priority"), F.when(e % 2 == 0, F.concat(F.lit("u"), (e % 6).cast("string"))).alias("url"),
        F.when(e % 5 > 0, pick(("Big Night!", "big  night", "Talk"), F.floor(e / 2))).alias("title"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("starts"), F.when(e % 4 > 0, "Hall").alias("venue"),
    )
    return happenings.merged(rows, "site", ["title", "url", "venue"])


@register("evidence_refs", "SELECT c_custkey, 'source:' || sha256(c_mktsegment) || ':contact:' || left(sha256('EMAIL:' || c_name), 16) AS ref FROM customer")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", happenings.evidence_ref(F.sha2("c_mktsegment", 256), "contact", F.concat(F.lit("EMAIL:"), "c_name")).alias("ref"))


@register(
    "field_coverage",
    """WITH f AS (SELECT l_partkey AS venue, l_returnflag AS field, l_linenumber AS value, l_quantity > 25 AS review FROM lineitem), w AS (SELECT venue, field FROM (SELECT DISTINCT venue FROM f), (SELECT unnest(['A', 'N', 'R', 'X']) AS field)),
      c AS (SELECT venue, field, count(DISTINCT value) FILTER (WHERE NOT review) AS firm FROM f GROUP BY 1, 2)
      SELECT venue, field, CASE WHEN firm > 1 THEN 'CONFLICT' WHEN firm = 1 THEN 'CONFIRMED' WHEN firm = 0 THEN 'REVIEW' ELSE 'MISSING' END AS status FROM w LEFT JOIN c USING (venue, field)""",
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("venue"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("value"), (F.col("l_quantity") > 25).alias("review"))
    return happenings.coverage(facts, "venue", ["A", "N", "R", "X"])


PHRASES = ("the end", "ing", "onst", "er, th")


@register(
    "phrase_verification",
    f"""WITH p AS (SELECT conv_id, {" + ".join(f"CAST(bool_or(contains(lower(text), {quoted(p)})) AS INT)" for p in PHRASES)} AS n FROM conversations GROUP BY 1)
      SELECT conv_id, CAST(n AS BIGINT) AS phrases, CASE WHEN n >= 2 THEN 'CONFIRMED' WHEN n = 1 THEN 'OWNER_CONFIRMATION' ELSE 'UNVERIFIED' END AS state FROM p""",
)
def phrase_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.verified_by_phrases(table(spark, sf_dir, "conversations"), "conv_id", "text", list(PHRASES))


@register("recent_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")
