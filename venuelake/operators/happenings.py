"""Events told by pages and calendars: nodes of structured data, calendar entries, merging and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NODE = "struct<`@type`:string,name:string,startDate:string,endDate:string,url:string,location:struct<name:string>>"
_KIND = r"(?:[A-Za-z]+)?Event|Festival"


def structured_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, starts, ends, url, venue, fingerprint) of the event nodes in a page's blocks of linked data, alone, in a list or
    in a graph. Blocks that are no JSON are passed over; the fingerprint is a hash of what does not change with the page."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    block = pages.select(key, F.explode(blocks).alias("b")).withColumn("b", F.regexp_replace("b", r"^\s+", ""))
    graph = F.from_json(F.get_json_object("b", "$['@graph']"), f"array<{_NODE}>")
    nodes = F.when(F.startswith("b", F.lit("[")), F.from_json("b", f"array<{_NODE}>")).when(graph.isNotNull(), graph).otherwise(F.array(F.from_json("b", _NODE)))
    each = block.select(key, F.explode(nodes).alias("n")).filter(F.col("n.@type").rlike(f"(?:^|[/#])(?:{_KIND})$") & F.col("n.name").isNotNull())
    found = each.select(key, F.trim("n.name").alias("title"), instant(F.col("n.startDate")).alias("starts"), instant(F.col("n.endDate")).alias("ends"), F.col("n.url").alias("url"), F.col("n.location.name").alias("venue"))
    return found.withColumn("fingerprint", fingerprint("title", "starts", "url", "venue"))


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def instant(text: Column) -> Column:
    """An ISO date, or date and time with an offset or Z, as UTC; without an offset it counts as UTC."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def calendar_entries(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, title, starts, url, venue) of the entries of calendar files: folded lines are joined, texts unescaped, and local times
    with a zone turned to UTC; entries without a summary or a start are left out."""
    plain = F.regexp_replace(body, r"\r?\n[ \t]", "")
    entry = files.select(key, F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), 1)).alias("e"))
    value = lambda name: F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    text = lambda name: F.nullif(F.regexp_replace(F.replace(value(name), F.lit("\\n"), F.lit(" ")), r"\\([,;\\])", "$1"), F.lit(""))
    zone = F.regexp_extract("e", r"(?m)^DTSTART;(?:[^:\r\n]*;)?TZID=([^:;\r\n]+)", 1)
    raw = value("DTSTART")
    local = F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
    starts = F.when(zone != "", F.to_utc_timestamp(local, F.when(zone == "", "UTC").otherwise(zone))).otherwise(local).cast("timestamp_ntz")
    found = entry.select(key, text("SUMMARY").alias("title"), starts.alias("starts"), F.nullif(value("URL"), F.lit("")).alias("url"), text("LOCATION").alias("venue"))
    return found.filter("title is not null and starts is not null")


def merged(found: DataFrame, site: str, fields: list[str]) -> DataFrame:
    """One event for each (site, address and instant), or (site, title, instant, venue) where it has no address: every field from the
    first source, by `priority`, that tells it; `sources` counts the sightings."""
    name = F.lower(F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}]+", " ")))
    identity = F.when(F.col("url").isNotNull(), F.concat_ws("|", "url", F.col("starts").cast("string"))).otherwise(F.concat_ws("|", name, F.col("starts").cast("string"), F.lower(F.coalesce("venue", F.lit("")))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("priority", "seen"))).alias(c)
    return found.withColumn("identity", identity).groupBy(site, "identity").agg(*[first(c) for c in fields], F.count("*").alias("sources"))


def evidence_ref(source: Column, kind: str, value: Column) -> Column:
    """source:<hash of the source>:<kind>:<sixteen digits of the value's hash>."""
    return F.concat(F.lit("source:"), source, F.lit(f":{kind}:"), F.substr(F.sha2(value, 256), F.lit(1), F.lit(16)))


def coverage(facts: DataFrame, subject: str, fields: list[str]) -> DataFrame:
    """(subject, field, status) for every subject and each of the fields: CONFIRMED if a fact needs no review, REVIEW if all do,
    CONFLICT where two that need none differ, MISSING where there is none."""
    each = facts.groupBy(subject, "field").agg(F.count_distinct(F.when(~F.col("review"), F.col("value"))).alias("firm"))
    wanted = facts.select(subject).distinct().select(subject, F.explode(F.array(*map(F.lit, fields))).alias("field"))
    status = F.when(F.col("firm") > 1, "CONFLICT").when(F.col("firm") == 1, "CONFIRMED").when(F.col("firm") == 0, "REVIEW").otherwise("MISSING")
    return wanted.join(each, [subject, "field"], "left").select(subject, "field", status.alias("status"))


def verified_by_phrases(texts: DataFrame, subject: str, text: str, phrases: list[str]) -> DataFrame:
    """(subject, phrases, state): how many of the phrases a subject's texts hold: two confirm it, one is for its owner to say."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(p)), F.lit(p)) for p in phrases]))
    found = texts.select(subject, F.explode_outer(held).alias("p")).groupBy(subject).agg(F.count_distinct("p").alias("phrases"))
    return found.withColumn("state", F.when(F.col("phrases") >= 2, "CONFIRMED").when(F.col("phrases") == 1, "OWNER_CONFIRMATION").otherwise("UNVERIFIED"))


def last_n(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The newest `n` rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
