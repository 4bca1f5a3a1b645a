"""Contacts of a site: which of several is best, which belong to others, and which contradict one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelake.functions import contacts
from venuelake.functions.addresses import registrable_domain


def best_contacts(found: DataFrame, site: str) -> DataFrame:
    """One contact for each (site, kind, normalised): one that needs no review before one that does, then of more confidence,
    then seen first; with its `position` on the site by purpose and first sight."""
    order = F.struct(F.col("review").alias("r"), (-F.col("confidence")).alias("c"), F.col("seen").alias("s"))
    one = found.groupBy(site, "kind", "normalised").agg(F.min_by(F.struct("review", "confidence", "purpose"), order).alias("b"), F.min("seen").alias("first_seen"))
    place = F.row_number().over(Window.partitionBy(site).orderBy(contacts.purpose_rank(F.col("purpose")), "first_seen"))
    return one.select(site, "kind", "normalised", "b.*", "first_seen").withColumn("position", place)


def phone_conflicts(found: DataFrame, site: str, page: str) -> DataFrame:
    """Sites whose pages with a single number do not agree on it, with how many numbers there are."""
    per_page = found.groupBy(site, page).agg(F.count_distinct("normalised").alias("n"), F.min("normalised").alias("only")).filter("n = 1")
    return per_page.groupBy(site).agg(F.count_distinct("only").alias("numbers")).filter("numbers > 1")


def directory_mailboxes(found: DataFrame, page: str, mail: str, host: str) -> DataFrame:
    """Mailboxes with `review`: those of other domains than the page's, free mail apart, on a page that lists three such domains
    or six such mailboxes, which is a directory of other places or of staff."""
    domain = registrable_domain(F.split_part(F.lower(mail), F.lit("@"), F.lit(2)))
    foreign = ~domain.eqNullSafe(registrable_domain(F.col(host))) & ~F.split_part(F.lower(mail), F.lit("@"), F.lit(2)).isin(*contacts.FREE_MAIL_DOMAINS)
    marked = found.withColumn("__domain", F.when(foreign, domain)).withColumn("__foreign", foreign)
    per_page = marked.filter("__foreign").groupBy(page).agg(F.count_distinct("__domain").alias("__domains"), F.count("*").alias("__mails")).filter("__domains >= 3 or __mails >= 6")
    joined = marked.join(per_page.select(F.col(page), F.lit(True).alias("__listed")), page, "left")
    return joined.withColumn("review", F.col("__foreign") & F.coalesce("__listed", F.lit(False))).drop("__domain", "__foreign", "__listed")


def label_fragments(found: DataFrame, page: str, mail: str) -> DataFrame:
    """Mailboxes with `fragment`: whether the same page has it with a label run into it, so that it is no address itself."""
    pair = found.select(page, F.lower(mail).alias("m")).distinct()
    # a label is one of few words, so the longer address, cut by each, is joined by equality
    cut = pair.select(page, "m", F.explode(F.array(*map(F.lit, ("email", "e-mail", "enquiries", "booking", "bookings")))).alias("label"))
    held = cut.filter(F.startswith(F.col("m"), F.col("label"))).select(page, F.expr("substr(m, length(label) + 1)").alias("m")).distinct().withColumn("fragment", F.lit(True))
    out = found.withColumn("m", F.lower(mail)).join(held, [page, "m"], "left").drop("m")
    return out.withColumn("fragment", F.coalesce("fragment", F.lit(False)))


def escalated_rights(images: DataFrame, pages: DataFrame, image: str, origin: str) -> DataFrame:
    """Images with the strictest rights of all their sightings and of notices that hold for their whole site, logos apart."""
    ranks = F.create_map(*[F.lit(x) for pair in (("UNKNOWN_RIGHTS", 0), ("VERIFIED_REUSABLE", 1), ("PERMISSION_REQUIRED", 2), ("RIGHTS_RESERVED", 3)) for x in pair])
    names = F.array(*map(F.lit, ("UNKNOWN_RIGHTS", "VERIFIED_REUSABLE", "PERMISSION_REQUIRED", "RIGHTS_RESERVED")))
    one = images.groupBy(image).agg(F.max(ranks[F.col("rights")]).alias("__own"), F.min(origin).alias(origin), F.bool_or(F.col("role") == "LOGO").alias("logo"))
    notices = pages.filter("rights is not null").groupBy(origin).agg(F.max(ranks[F.col("rights")]).alias("__site"))
    rank = F.when(F.col("logo"), F.col("__own")).otherwise(F.greatest("__own", F.coalesce("__site", F.lit(0))))
    return one.join(notices, origin, "left").select(image, origin, "logo", F.element_at(names, rank + 1).alias("rights"))
