"""Links of pages: anchors, their scores, and what is known of a host by its domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders of events, and words that tell a date.
EVENT_FOLDERS = r"(?i)(?:^|/)(?:events?|gigs?|shows?|tour|live|whats[-_]?on|calendar|concerts?)(?:/|$)"
DATE_WORDS = r"(?i)\b(?:20\d{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)\b"


def by_domain(rows: DataFrame, domains: DataFrame, key: str, host: str, value: str) -> DataFrame:
    """(key, host, value): the value of the longest domain that is the host or a parent of it, null if none is.

    A host's parents are its suffixes, so the match is an equi-join; the domain table may be of any length.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).distinct()
    known = hosts.select(host, F.explode(suffixes).alias("domain")).join(domains, "domain").groupBy(host).agg(F.max_by(value, F.length("domain")).alias(value))
    return rows.select(key, host).join(known, host, "left")


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, label) of a page's links with plain labels."""
    each = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\b[^>]*?href="[^"]*"[^>]*>[^<]*</a>'), 0)
    a = pages.select(key, F.explode(each).alias("a"))
    return a.select(key, F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r"(?i)>([^<]*)</a>", 1).alias("label"))


#: Pages that serve no reader, and words of labels that tell of events.
NO_USE = r"(?i)\b(?:accessibility-statement|privacy-policy|cookie-policy|terms-of-use|search)\b"
EVENT_LABEL = r"(?i)\b(events?|gigs?|shows?|tour dates?|live dates?|what'?s on|calendar|concerts?)\b"


def ranked_links(links: DataFrame, key: str, terms: Sequence[str], events: bool = False) -> DataFrame:
    """(key, href, score, position): an address scores a point for each term in its label or path. Where events are asked for, a
    folder of events adds four, a label that tells of events three, and an /event/ or /events/ one more. The best of its
    labels counts; addresses without a point, and pages such as policies, are left out."""
    text = F.lower(F.concat_ws(" ", "label", "href"))
    score = sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    if events:
        score += F.when(F.col("href").rlike(EVENT_FOLDERS), 4).otherwise(0) + F.when(F.col("label").rlike(EVENT_LABEL), 3).otherwise(0) + F.when(F.col("href").rlike("(?i)/events?/"), 1).otherwise(0)
    best = links.filter(~F.col("href").rlike(NO_USE)).withColumn("score", score).filter("score > 0").groupBy(key, "href").agg(F.max("score").alias("score"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "href")))


def event_links(links: DataFrame, key: str, depth: Column) -> DataFrame:
    """(key, href, score) of the links in folders of events that lie deeper than `depth`, a point, or tell a date, two."""
    deeper = F.size(F.filter(F.split("href", "/"), lambda s: s != "")) > depth
    dated = F.concat_ws(" ", "label", "href").rlike(DATE_WORDS)
    score = deeper.cast("int") + 2 * dated.cast("int")
    return links.filter(F.col("href").rlike(EVENT_FOLDERS)).withColumn("score", score).filter("score > 0").groupBy(key, "href").agg(F.max("score").alias("score"))
