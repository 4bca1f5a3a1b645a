"""Readers of captured bodies: sitemaps, robots rules and search results as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: URLs of a sitemap that are read at most, as the format's consumer defines it.
SITEMAP_URLS = 5000


def sitemap_urls(bodies: DataFrame, id_col: str, body_col: str, most: int | None = SITEMAP_URLS) -> DataFrame:
    """(id, kind, position, url): of an index the maps, of a set its pages, of plain text its lines; the first `most` (None:
    all)."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    kind = F.when(body.rlike(r"(?i)<sitemapindex\b"), "INDEX").when(body.rlike(r"(?i)<urlset\b"), "URLSET").otherwise("TEXT")
    marked = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    plain = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^https?://"))
    found = bodies.select(F.col(id_col), kind.alias("kind"), _first(F.when(kind == "TEXT", plain).otherwise(marked), most).alias("urls"))
    return found.select(id_col, "kind", F.posexplode("urls").alias("position", "url"))


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def robots_rules(bodies: DataFrame, host_col: str, body_col: str) -> DataFrame:
    """(host, agent, allow, path): each rule under each agent of its group; an agent whose group has no rule has one row with
    a null path. A group begins with the agent line after a rule; rules without a value, and those before any agent, are none."""
    lines = bodies.select(F.col(host_col).alias("host"), F.posexplode(F.split(F.coalesce(F.col(body_col), F.lit("")), r"\r?\n")).alias("at", "line"))
    clean = F.trim(F.regexp_replace("line", r"#.*$", ""))
    parsed = lines.select("host", "at", F.lower(F.trim(F.regexp_extract(clean, r"^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value"))
    told = parsed.filter("name = 'user-agent' or name in ('allow', 'disallow') and value <> ''")
    order = Window.partitionBy("host").orderBy("at")
    opens = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("allow")) != "user-agent")
    grouped = told.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.filter("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    rules = grouped.filter("name <> 'user-agent'").select("host", "group", (F.col("name") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["host", "group"], "left").select("host", "agent", "allow", "path").distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(host, path, allowed): the longest rule decides, its stars not counted, and allow wins a tie; the groups of agents that
    the crawler's name holds go before those of *, even without a rule. A star stands for anything, a final $ for the end."""
    named = (F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent"))
    mine = rules.filter(named | (F.col("agent") == "*")).withColumn("named", named)
    own = mine.groupBy("host").agg(F.bool_or("named").alias("any_named"))
    used = mine.join(own, "host").filter("named = any_named and path is not null").select("host", F.col("path").alias("rule"), "allow")
    body = F.regexp_replace("rule", r"\$$", "")
    wild = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(body, r"([.+()\[\]{}^|\\?$])", r"\\$1"), r"\*", ".*"), F.when(F.col("rule").endswith("$"), "$").otherwise(""))
    asked = urls.select("host", "path").distinct().join(used, "host", "left")
    fits = F.col("rule").isNotNull() & F.expr("path rlike pattern")
    best = F.max_by("allow", F.when(F.col("fits"), F.struct(F.length(F.replace(F.col("rule"), F.lit("*"), F.lit(""))), "allow")))
    return asked.withColumn("pattern", wild).withColumn("fits", fits).groupBy("host", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def search_results(responses: DataFrame, id_col: str, body_col: str, most: int | None = 10) -> DataFrame:
    """(id, rank, title, link) of the organic rows of stored search responses, public web links only; the first `most` (None: all)."""
    parsed = F.from_json(body_col, "organic array<struct<title:string,link:string>>")
    rows = responses.select(F.col(id_col), F.posexplode(_first(parsed["organic"], most)).alias("rank", "r"))
    return rows.select(id_col, (F.col("rank") + 1).alias("rank"), "r.title", "r.link").filter(F.col("link").rlike(r"^https?://[^/@]+\.[a-z]{2,}"))


def content_kind(content_type: Column, body: Column) -> Column:
    """Kind by magic first, then by header."""
    head, kind = F.lower(F.substring(F.trim(F.coalesce(body, F.lit(""))), 1, 64)), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(head.startswith("%pdf-"), "PDF").when(head.startswith("begin:vcalendar"), "ICS")
        .when(head.startswith("<!doctype html") | head.startswith("<html") | kind.contains("html"), "HTML")
        .when(head.startswith("<?xml") | kind.contains("xml"), "XML").when(kind.contains("json") | head.startswith("{"), "JSON")
        .when(kind.startswith("text/"), "TEXT").otherwise("OTHER")
    )
