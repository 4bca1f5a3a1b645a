"""Registered queries of contacts: mail, phones, purposes, best and doubtful ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import contacts
from venuelake.operators import contact_rules
from venuelake.plans.catalog import pick, register, sql_pick
from venuelake.sources.tables import table

MAILS = (
    "mailto:Info@Hall.org?subject=x", "no-reply@hall.org", "events@example.com", "a@b", " jo.bloggs@hall.co.uk ", "x@cdn.wixpress.com", "logo@2x.png", "dpo@hall.org", "bookings@hall.org", "me@site", "sales@tickets.com", None,
    "weddings+may@hall.org", "postmaster@hall.org", "a b@hall.org", "hello@my.yourdomain.net",
)


@register(
    "mail_verdicts",
    f"""WITH m AS (SELECT event_id, split_part(regexp_replace(lower(trim({sql_pick(MAILS, "event_id")})), '^mailto:', ''), '?', 1) AS m FROM events), s AS (SELECT *, split_part(m, '@', 1) AS box, split_part(m, '@', 2) AS dom FROM m)
      SELECT event_id, m AS mail, CASE WHEN m IS NULL OR NOT regexp_full_match(m, '[a-z0-9._%+-]+@[a-z0-9-]+([.][a-z0-9-]+)+') OR regexp_matches(dom, '[.](png|jpe?g|gif|webp|svg|css|js)$') THEN 'INVALID_EMAIL'
        WHEN dom IN ('example.com', 'cdn.wixpress.com', 'my.yourdomain.net') THEN 'PLATFORM_RELAY_OR_PLACEHOLDER' WHEN dom = 'tickets.com' THEN 'THIRD_PARTY_PLATFORM_DOMAIN' WHEN box IN ('no-reply', 'dpo', 'postmaster') THEN 'NON_CONTACT_MAILBOX' ELSE 'ACCEPTED' END AS verdict,
        box IN ('info', 'events', 'bookings', 'sales', 'hello') AS role FROM s""",
)
def mail_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", pick(MAILS, F.col("event_id")).alias("raw"))
    platform = F.split_part(contacts.plain_mail(F.col("raw")), F.lit("@"), F.lit(2)) == "tickets.com"
    return rows.select("event_id", contacts.plain_mail(F.col("raw")).alias("mail"), contacts.mail_verdict(F.col("raw"), platform).alias("verdict"), contacts.role_mailbox(F.col("raw")).alias("role"))


PHONES = ("tel:+44 (0)20 7946 0018", "0044 20 7946 0018", "020 7946 0018", "(020) 7946-0018", "+27 21 555 0199", "7946 0018", "0800 11 11", "021 555 0199")


@register(
    "phone_numbers",
    f"""WITH p AS (SELECT event_id, {sql_pick(PHONES, "event_id")} AS raw, CASE WHEN event_id // 8 % 2 = 0 THEN 'hall.co.uk' ELSE 'hall.co.za' END AS host FROM events), d AS (SELECT *, regexp_replace(regexp_replace(raw, '^tel:|\\(0\\)', '', 'g'), '[^0-9]', '', 'g') AS d FROM p)
      SELECT event_id, host, CASE WHEN contains(raw, '+') THEN '+' || d WHEN starts_with(d, '00') THEN '+' || d[3:] WHEN host LIKE '%.uk' AND starts_with(d, '0') AND length(d) IN (10, 11) THEN '+44' || d[2:] ELSE d END AS number FROM d""",
)
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    host = F.when(F.floor(e / 8) % 2 == 0, "hall.co.uk").otherwise("hall.co.za")
    return table(spark, sf_dir, "events").select(e, host.alias("host"), contacts.phone(pick(PHONES, e), host).alias("number"))


CONTEXTS = (
    "For venue hire, write to us", "Business Support desk", "Larger groups: use our contact form", "Book now", "Box-Office opens at ten", "Main number of the hall", "All other enquiries", "Say hello", "events@hall.org", "tickets@hall.org",
    "Our events team", "reservations", "A wedding or a meeting", "reception desk",
)
KINDS = ("EMAIL", "PHONE", "EMAIL", "WHATSAPP", "CONTACT_FORM", "EMAIL", "PHONE")
_PURPOSE = f"""CASE {sql_pick(KINDS, "event_id // 14")} WHEN 'WHATSAPP' THEN 'MESSAGING' WHEN 'CONTACT_FORM' THEN 'FORM' ELSE {sql_pick(("SALES_HIRE", "CORPORATE_SUPPORT", "ENQUIRIES", "BOOKINGS", "BOX_OFFICE", "SWITCHBOARD", "ENQUIRIES", "GENERAL", "SALES_HIRE", "BOX_OFFICE", "SALES_HIRE", "BOOKINGS", "SALES_HIRE", "SWITCHBOARD"), "event_id")} END"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = pick(KINDS, F.floor(e / 14))
    return table(spark, sf_dir, "events").select(
        e, F.col("user_id").alias("site"), (e % 4).alias("page"), kind.alias("kind"), F.concat(F.lit("c"), (e % 6).cast("string")).alias("normalised"), (e % 3 == 0).alias("review"), (e % 11 / 10).alias("confidence"),
        contacts.purpose(kind, pick(CONTEXTS, e)).alias("purpose"), e.alias("seen"),
    )


@register("contact_purposes", f"SELECT event_id, {_PURPOSE} AS purpose FROM events")
def contact_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("event_id", "purpose")


_FOUND = f"SELECT event_id, user_id AS site, event_id % 4 AS page, {sql_pick(KINDS, 'event_id // 14')} AS kind, 'c' || event_id % 6 AS normalised, event_id % 3 = 0 AS review, event_id % 11 / 10 AS confidence, {_PURPOSE} AS purpose FROM events"


@register(
    "best_contacts",
    f"""WITH f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY site, kind, normalised ORDER BY review, confidence DESC, event_id) AS n, min(event_id) OVER (PARTITION BY site, kind, normalised) AS first_seen FROM f)
      SELECT site, kind, normalised, review, confidence, purpose, first_seen, row_number() OVER (PARTITION BY site ORDER BY list_position({list(contacts.PURPOSE_ORDER)}, purpose), first_seen) AS position FROM r WHERE n = 1""",
)
def best_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_rules.best_contacts(_found(spark, sf_dir), "site")


@register(
    "phone_conflicts",
    "WITH p AS (SELECT c_nationkey AS site, o_orderkey AS page, count(DISTINCT o_custkey % 5) AS n, min(o_custkey % 5) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT site, count(DISTINCT v) AS numbers FROM p WHERE n = 1 GROUP BY 1 HAVING count(DISTINCT v) > 1",
)
def phone_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return contact_rules.phone_conflicts(o.select(F.col("c_nationkey").alias("site"), F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 5).alias("normalised")), "site", "page")


BOXES = ("info@hall.org", "a@one.com", "b@two.co.uk", "c@three.net", "d@gmail.com", "e@events.hall.org", "f@one.com")


@register(
    "directory_mailboxes",
    f"""WITH m AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey % 7 AS k, {sql_pick(BOXES, "l_partkey")} AS mail FROM lineitem), f AS (SELECT *, k IN (1, 2, 3, 6) AS foreign_box FROM m),
      p AS (SELECT page, count(DISTINCT CASE k WHEN 6 THEN 1 ELSE k END) AS d, count(*) AS c FROM f WHERE foreign_box GROUP BY 1)
      SELECT page, n, mail, foreign_box AND coalesce(d >= 3 OR c >= 6, false) AS review FROM f LEFT JOIN p USING (page)""",
)
def directory_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), pick(BOXES, F.col("l_partkey")).alias("mail"), F.lit("www.hall.org").alias("host"))
    return contact_rules.directory_mailboxes(rows, "page", "mail", "host").select("page", "n", "mail", "review")


GLUED = ("bookings@hall.org", "s@hall.org", "emailinfo@hall.org", "info@hall.org", "jo@hall.org", "@hall.org")


@register(
    "label_fragments",
    f"""WITH m AS (SELECT event_id, user_id * 100 + event_id // 50 % 40 AS page, {sql_pick(GLUED, "event_id")} AS mail FROM events)
      SELECT event_id, page, mail, EXISTS (SELECT 1 FROM m o WHERE o.page = m.page AND o.mail <> m.mail AND ends_with(o.mail, m.mail) AND left(o.mail, length(o.mail) - length(m.mail)) IN ('email', 'e-mail', 'enquiries', 'booking', 'bookings')) AS fragment FROM m""",
)
def label_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, (F.col("user_id") * 100 + F.floor(e / 50) % 40).alias("page"), pick(GLUED, e).alias("mail"))
    return contact_rules.label_fragments(rows, "page", "mail").select("event_id", "page", "mail", "fragment")


LEADS = ("Write to ", "Press: press@paper.com. Hire: ", "x@y.zz and z@y.zz, then ", "Nothing ", "a" * 450 + " ")


@register(
    "mail_contexts",
    f"""WITH t AS (SELECT event_id, {sql_pick(LEADS, "event_id")} AS l FROM events), s AS (SELECT *, CASE WHEN event_id % 7 > 0 THEN l || 'Jo@hall.org today' ELSE l END AS body FROM t)
      SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE right(regexp_extract(l, '((?:[^@]*[a-z0-9]@[a-z]+[.][a-z]+)*)(.*)$', 2), 400) || 'Jo@hall.org' END AS context FROM s""",
)
def mail_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    lead = pick(LEADS, e)
    body = F.when(e % 7 > 0, F.concat(lead, F.lit("Jo@hall.org today"))).otherwise(lead)
    return table(spark, sf_dir, "events").select(e, contacts.before_mail(body, F.lit("jo@hall.org")).alias("context"))


@register(
    "hidden_mails",
    "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'u' || user_id || '@hall.org' END AS mail FROM events",
)
def hidden_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses are hidden by a key of their own and found again."""
    e = F.col("event_id")
    plain = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@hall.org"))
    key = (e % 200 + 1).cast("int")
    byte = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    code = F.concat(byte(key), F.array_join(F.transform(F.split(plain, ""), lambda c: byte(F.ascii(c).bitwiseXOR(key))), ""))
    return table(spark, sf_dir, "events").select(e, contacts.decoded_mail(F.when(e % 5 > 0, code).otherwise(F.concat(F.lit("zz"), plain))).alias("mail"))


@register(
    "image_rights",
    """WITH i AS (SELECT l_partkey AS image, l_partkey % 10 AS origin, ['UNKNOWN_RIGHTS', 'VERIFIED_REUSABLE', 'PERMISSION_REQUIRED', 'RIGHTS_RESERVED'][1 + l_orderkey % 3] AS rights, l_orderkey % 3 AS rank, l_partkey % 9 = 0 AS logo FROM lineitem),
      o AS (SELECT image, max(rank) AS rank, min(origin) AS origin, bool_or(logo) AS logo FROM i GROUP BY 1), p AS (SELECT s_suppkey % 10 AS origin, max(CASE WHEN s_suppkey % 4 = 0 THEN 3 WHEN s_suppkey % 4 = 1 THEN 2 END) AS site FROM supplier GROUP BY 1)
      SELECT image, origin, logo, ['UNKNOWN_RIGHTS', 'VERIFIED_REUSABLE', 'PERMISSION_REQUIRED', 'RIGHTS_RESERVED'][1 + CASE WHEN logo THEN rank ELSE greatest(rank, coalesce(site, 0)) END] AS rights FROM o LEFT JOIN p USING (origin)""",
)
def image_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("UNKNOWN_RIGHTS", "VERIFIED_REUSABLE", "PERMISSION_REQUIRED")
    role = F.when(F.col("l_partkey") % 9 == 0, "LOGO").otherwise("PHOTO")
    images = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image"), (F.col("l_partkey") % 10).alias("origin"), pick(states, F.col("l_orderkey")).alias("rights"), role.alias("role"))
    s = F.col("s_suppkey")
    notices = table(spark, sf_dir, "supplier").select((s % 10).alias("origin"), F.when(s % 4 == 0, "RIGHTS_RESERVED").when(s % 4 == 1, "PERMISSION_REQUIRED").alias("rights"))
    return contact_rules.escalated_rights(images, notices, "image", "origin")
