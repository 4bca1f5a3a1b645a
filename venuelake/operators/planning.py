"""A crawl's rounds and endings: what is read next, which hosts join, why it stops, what history says of an address."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.functions.text import visible_text

#: Pages that a dimension may be given before the planner leaves it.
MOST_ATTEMPTS = 4


def rounds(plan: DataFrame, site: str, page: str, dims: Sequence[str], budget: int, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(site, page, dim, turn): which page of its plan a site reads at each turn, and for which dimension.

    Dimensions take turns; each is given its best page not yet read (by `position`), `attempts` times at most, and a page serves
    all its dimensions (array `dims`). What a turn finds depends on those before, so a site's pages are folded in order: a
    site lies in one partition, sorted and streamed; its plan is a crawl's budget of pages, not a table.
    """
    whole = dict(plan.dtypes)[site] in ("tinyint", "smallint", "int", "bigint")
    rows = plan.select((F.col(site) if whole else F.col(site).cast("string")).alias("site"), F.col(page).cast("string").alias("page"), "dims", F.col("position").cast("long").alias("position"))
    sorted_plan = rows.repartition("site").sortWithinPartitions("site", "position", "page").select(F.col("site").cast("string").alias("site"), "page", "dims")
    names = list(dims)

    def settle(now: str, left: list[tuple[str, list[str]]], out: list[tuple[str, str, str, int]]) -> None:
        tried, turn = dict.fromkeys(names, 0), 0
        while left and turn < budget:
            before = turn
            for d in names:
                if tried[d] >= attempts or turn >= budget:
                    continue
                at = next((i for i, p in enumerate(left) if d in p[1]), None)
                if at is None:
                    continue
                found = left.pop(at)
                for other in found[1]:
                    if other in tried:
                        tried[other] += 1
                turn += 1
                out.append((now, found[0], d, turn))
            if turn == before:
                break

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            done = pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["site", "page", "dim", "turn"])
            out.clear()
            return done

        for batch in batches:  # one answer a batch, not one a site
            serves = batch.column("dims")
            each, ends = serves.flatten().to_pylist(), np.cumsum(pc.fill_null(pc.list_value_length(serves), 0).to_numpy(zero_copy_only=False)).tolist()
            start = 0
            for s, p, end in zip(batch.column("site").to_pylist(), batch.column("page").to_pylist(), ends, strict=True):
                if s != now:
                    settle(now, held, out)
                    now, held = s, []
                held.append((p, each[start:end]))
                start = end
            if out:
                yield given()
        settle(now, held, out)
        if out:
            yield given()

    return sorted_plan.mapInArrow(walk, "site string, page string, dim string, turn long")


def admitted_hosts(links: DataFrame, site: str, host: str, order: str, most: int = 2) -> DataFrame:
    """(site, host): the first `most` other hosts of a site's own domain that its pages link to."""
    first = links.filter("same_domain and not own_host").groupBy(site, host).agg(F.min(order).alias("seen"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(site).orderBy("seen", host))).filter(F.col("n") <= most).select(site, host)


def stop_reason(documents: Column, pages: Column, page_budget: Column, requests: Column, request_budget: Column, unsatisfied: Column, open_gaps: Column, candidates: Column, robots: Column, retryable: Column, blocked: Column) -> Column:
    """struct<reason, status>: why a crawl ended, by the first that holds, and what it is worth. `robots` is UNAVAILABLE, BLOCKED or
    null; `unsatisfied` counts the dimensions without evidence, `open_gaps` those that may still be tried, `candidates` the
    pages that would serve one. A crawl that a budget ended with gaps and candidates left, or one with a page that failed
    for the time being, is partial."""
    some = documents > 0
    reason = (
        F.when(robots == "UNAVAILABLE", "ROBOTS_UNAVAILABLE").when(robots == "BLOCKED", "ROBOTS_BLOCKED").when(some & (unsatisfied == 0), "DIMENSIONS_SATISFIED").when(some & (open_gaps == 0), "GAPS_EXHAUSTED")
        .when(pages >= page_budget, "PAGE_BUDGET").when(requests >= request_budget, "REQUEST_BUDGET").when((candidates == 0) & some, "NO_GAP_CANDIDATES").when(~some, "ENTRY_FAILED").otherwise("QUEUE_EXHAUSTED")
    )
    short = reason.isin("PAGE_BUDGET", "REQUEST_BUDGET") & (candidates > 0) & (unsatisfied > 0)
    status = F.when(~some, F.when(blocked > 0, "BLOCKED").otherwise("FAILED")).when(short | retryable, "PARTIAL").otherwise("COMPLETED")
    return F.struct(reason.alias("reason"), status.alias("status"))


def mail_outcome(wanted: Column, found: Column, held: Column, status: Column, retryable: Column, reason: Column, render_needed: Column, paths_left: Column) -> Column:
    """What a crawl has made of the search for a mail address, apart from whether it ran to its end: a crawl that completed has
    exhausted the search only if nothing was left to try."""
    return (
        F.when(~wanted, "EMAIL_NOT_REQUESTED").when(found, "EMAIL_FOUND").when(F.coalesce(held, F.lit(0)) > 0, "EMAIL_CANDIDATES_HELD")
        .when((status == "BLOCKED") | reason.isin("ROBOTS_BLOCKED", "ROBOTS_UNAVAILABLE"), "BLOCKED").when(status == "FAILED", F.when(retryable, "TRANSIENT_FAILURE").otherwise("BLOCKED"))
        .when(render_needed, "RENDER_NEEDED").when(reason == "PAGE_BUDGET", "PAGE_BUDGET_REACHED").when(reason == "REQUEST_BUDGET", "REQUEST_BUDGET_REACHED").when(paths_left > 0, "CONTACT_PATHS_REMAIN").otherwise("EMAIL_SEARCH_EXHAUSTED")
    )


def terminal_urls(answers: DataFrame, url: str, at: str) -> DataFrame:
    """(url, status, at): addresses that were gone (404, 410), each at its first such answer, which later answers of any kind
    do not take back; of two at one instant the lesser status."""
    gone = answers.filter(F.col("status").isin(404, 410) & F.col(at).isNotNull())
    return gone.groupBy(url).agg(F.min(F.struct(at, "status")).alias("s")).select(url, "s.status", f"s.{at}")


#: Pages that say these are no evidence about a site.
NOT_THE_SITE = r"(?i)access denied|forbidden|just a moment|verify you are human|captcha|under construction|coming soon|page not found|service unavailable"
_META = r"""(?i)<meta\b(?:[^"'<>]|"[^"]*"|'[^']*')*>"""


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, however it is quoted; '' if missing."""
    found = F.regexp_extract(tag, rf"""(?i)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""", 1)
    return F.regexp_replace(found, "^[\"']|[\"']$", "")


def improvements(url: Column, html: Column, longest: int = 1_500_000) -> Column:
    """What a page's static markup lacks, in fixed order: LEGACY_FRAMESET alone, or MISSING_TITLE, MISSING_META_DESCRIPTION and
    MISSING_DEVICE_WIDTH_VIEWPORT. Empty where the page is no evidence: not https, longer than `longest`, without whole html
    and head elements, an error or waiting page, a body of under 40 characters or one that asks for scripts, or a meta
    tag that cannot be read."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    head = F.regexp_extract(h, r"(?is)<head\b[^>]*>(.*?)</head\s*>", 1)
    title = visible_text(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    body = visible_text(F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1))
    metas = F.regexp_extract_all(head, F.lit(_META), 0)
    whole = url.rlike("(?i)^https:") & (F.length(html) <= longest) & h.rlike(r"(?is)<html\b.*</html\s*>") & h.rlike(r"(?is)<head\b.*</head\s*>") & ~F.concat_ws(" ", title, body).rlike(NOT_THE_SITE)
    readable = (F.length(body) >= 40) & ~body.rlike(r"(?i)enable javascript|javascript (?:is )?required") & (F.size(metas) == F.regexp_count(head, F.lit(r"(?i)<meta\b")))
    named = lambda name, told: F.exists(metas, lambda m: (F.lower(F.trim(_attribute(m, "name"))) == name) & told(_attribute(m, "content")))
    told = (
        ("MISSING_TITLE", title == ""),
        ("MISSING_META_DESCRIPTION", ~named("description", lambda c: F.trim(c) != "")),
        ("MISSING_DEVICE_WIDTH_VIEWPORT", ~named("viewport", lambda c: c.rlike(r"(?i)(?:^|[,;\s])width\s*=\s*device-width(?:$|[,;\s])"))),
    )
    none = F.array().cast("array<string>")
    listed = F.when(readable, F.array_compact(F.array(*[F.when(test, name) for name, test in told]))).otherwise(none)
    return F.when(F.coalesce(whole, F.lit(False)), F.when(h.rlike(r"(?i)<frameset\b"), F.array(F.lit("LEGACY_FRAMESET"))).otherwise(listed)).otherwise(none)


def authority(refusal: Column, failure: Column, cross_site: Column, redirect_refused: Column, status: Column, missing: Column, recovery: Column, robots: Column, mismatch: Column, shell: Column) -> Column:
    """Whether an address that was probed may be crawled as its place's own, in the order in which a probe learns of it.

    `refusal`: why the address is no target (NON_PUBLIC or another), `failure`: of the connection (DEAD_HOST, PRIVATE_NETWORK, CERTIFICATE
    or another), `missing`: the page is gone, or says so, `recovery`: how another page of the site was reached in its place,
    `robots`: UNAVAILABLE, DENIED, ALLOWED or ABSENT, `mismatch`: the page names another place. Flags are false where null.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    gone = flag(missing)
    return (
        F.when(refusal.isNotNull(), F.when(refusal == "NON_PUBLIC", "DEAD_HOST").otherwise("STALE_PATH_UNRECOVERED"))
        .when(failure.isNotNull(), F.when(failure.isin("DEAD_HOST", "PRIVATE_NETWORK"), "DEAD_HOST").when(failure == "CERTIFICATE", "STALE_PATH_UNRECOVERED").otherwise("TRANSIENT_NETWORK"))
        .when(flag(cross_site), "CROSS_DOMAIN_REVIEW").when(flag(redirect_refused), "STALE_PATH_UNRECOVERED").when((status >= 500) | (status == 429), "TRANSIENT_NETWORK").when(status.isin(401, 403), "ROBOTS_BLOCKED")
        .when(gone & recovery.isNull(), "STALE_PATH_UNRECOVERED").when(~gone & ~flag(status.between(200, 299)), "TRANSIENT_NETWORK").when(robots == "UNAVAILABLE", "TRANSIENT_NETWORK").when(robots == "DENIED", "ROBOTS_BLOCKED")
        .when(flag(mismatch), "AUTHORITY_MISMATCH").when(flag(shell), "STATIC_SHELL").when(recovery.isNotNull(), "SAFE_RECOVERY_AVAILABLE").otherwise("HEALTHY")
    )


def upgraded(url: Column) -> Column:
    """An http address as https; null where its host is an address, or it names a port."""
    rest = F.regexp_extract(url, r"(?i)^http://([^/?#]+)(.*)$", 1)
    plain = (rest != "") & ~rest.rlike(r"^[0-9.]+$") & ~F.contains(rest, F.lit(":")) & ~F.contains(rest, F.lit("@"))
    return F.when(url.rlike("(?i)^https://"), url).when(plain, F.regexp_replace(url, "(?i)^http://", "https://"))
