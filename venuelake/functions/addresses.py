"""Column functions over web addresses: sites, tracking, plan keys, page kinds, redirects and networks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosting platforms whose subdomains belong to unrelated sites.
PLATFORMS = (
    "github.io", "gitlab.io", "wixsite.com", "wix.com", "squarespace.com", "wordpress.com", "blogspot.com", "weebly.com",
    "webflow.io", "netlify.app", "vercel.app", "pages.dev", "workers.dev", "herokuapp.com", "azurewebsites.net",
    "cloudfront.net", "appspot.com", "firebaseapp.com", "web.app", "myshopify.com", "carrd.co", "godaddysites.com",
    "jimdosite.com", "site123.me", "strikingly.com", "tumblr.com", "ueniweb.com", "business.site", "square.site",
    "eventbrite.com", "eventbrite.co.uk", "hubspotpagebuilder.com", "framer.website", "notion.site",
)
#: Second levels under a country's two letters.
SECOND_LEVELS = (
    "co", "com", "net", "org", "ac", "gov", "edu", "ltd", "plc", "me", "sch", "nhs", "police", "mod", "nic", "or",
    "ne", "gr", "lg", "ad", "go", "mil", "gob", "nom", "info", "biz", "asn", "id", "judiciary",
)
#: Second levels of the simpler rule, which knows two countries.
MAIL_SECOND_LEVELS = r"^(?:co|org|ac|gov|net|com|ltd|plc|me|nic|web|nom|sch|police|mod|nhs)\.(?:uk|za)$"
#: Query parameters that only track, that pick a part of a page, and that must not be recorded.
TRACKING = r"tracking|utm_[a-z_]+|fbclid|gclid"
ITEM_PARAMETERS = r"item_?id|item|id|page|paged|pg|p|sort|order|filter|view|variant|image|img|photo|slide|utm_\w+"
#: What a crawl never plans.
UNPLANNED_FOLDERS = r"privacy|cookies?|cookie-policy|terms|legal|login|log-in|signin|sign-in|register|account|my-account|cart|basket|checkout|wp-admin|wp-login|feed|rss|tag|tags|category|categories|author|search|careers?|jobs|vacancies|newsletter|unsubscribe|sitemap"
UNPLANNED_FILES = r"jpe?g|png|gif|webp|avif|svg|ico|mp4|mov|webm|mp3|wav|zip|rar|7z|gz|tar|exe|dmg|docx?|xlsx?|pptx?|css|js|json|woff2?|ttf"
ARTICLE_FOLDERS = r"blogs?|news|newsroom|press-releases?|articles?|posts?|stories|inspiration|insights?|journal|magazine|updates?"
#: Words of a page's path and label, by tier.
CONTACT_WORDS = r"contact(?:[- ]us)?|get[- ]in[- ]touch|enquir\w*|inquir\w*|reach[- ]us|speak[- ]to|talk[- ]to[- ]us"
IDENTITY_WORDS = r"about(?:[- ]us)?|our[- ]story|the[- ]venue|who[- ]we[- ]are|find[- ]us|location|directions|address|visit(?:[- ]us)?|how[- ]to[- ]find"
MENU_WORDS = r"menus?|food|drinks?|wine[- ]list|wines|cocktails?|brunch|lunch|dinner|breakfast|a[- ]la[- ]carte|set[- ]menus?|tasting|prices?|pricing|tariffs?"
COMMERCE_WORDS = r"shop|store|cart|basket|checkout|products?|collections?|gift[- ]?(?:cards?|vouchers?)|vouchers?|offers?|deals?|promotions?|promo|sale|discounts?|memberships?|subscriptions?|whats?[- ]?on|tickets?|box[- ]?office|programme|reviews?|testimonials?|competitions?"
HIRE_WORDS = r"venue[- ]hire|hire|functions?|events?|weddings?|celebrations?|parties|party|birthdays?|corporate|conferences?|conferencing|meetings?|spaces?|rooms?|venues|halls?|suites?|studios?|ballrooms?|facilit\w*|amenit\w*|capacit\w*|accessib\w*|packages|exhibitions?|filming|accommodation|catering"
SUPPORT_WORDS = r"galler(?:y|ies)|photos?|images|pictures|virtual[- ]tour|floor[- ]?plans?|brochures?|downloads?|spec(?:ification)?s?|media|fact[- ]?sheets?|layouts?"
#: Networks that are not public, as first address and prefix.
PRIVATE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    """The path, `/` where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    """The query with its question mark, or nothing."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)


def _labels(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\."), lambda x: x != "")


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")


def registrable_domain(name: Column) -> Column:
    """The part of a host that one party registers: below a platform one label more, below a country's second level three
    labels, else two; null where the host is no longer than that."""
    labels = _labels(name)
    n, tld, second = F.size(labels), F.element_at(labels, -1), F.element_at(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(1)), 1)
    return (
        F.when(n < 2, None)
        .when((n >= 3) & _last(labels, 3).isin(*PLATFORMS), F.when(n > 3, _last(labels, 4)))
        .when(_last(labels, 2).isin(*PLATFORMS), F.when(n > 2, _last(labels, 3)))
        .when((F.length(tld) == 2) & second.isin(*SECOND_LEVELS), F.when(n >= 3, _last(labels, 3)))
        .otherwise(_last(labels, 2))
    )


def mail_domain(name: Column) -> Column:
    """The simpler rule for mail: two labels, three after a known second level of two countries; www. is left out."""
    labels = _labels(F.regexp_replace(F.lower(name), r"^www\.", ""))
    return F.when(_last(labels, 2).rlike(MAIL_SECOND_LEVELS), _last(labels, 3)).otherwise(_last(labels, 2))


def www_counterpart(name: Column) -> Column:
    return F.when(name.startswith("www."), F.substr(name, F.lit(5))).otherwise(F.concat(F.lit("www."), name))


def _parameters(url: Column) -> Column:
    return F.filter(F.split(F.substr(query(url), F.lit(2)), "&"), lambda p: p != "")


def _with_parameters(url: Column, kept: Column) -> Column:
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def without_tracking(url: Column, names: str = TRACKING) -> Column:
    """The URL without its fragment and without parameters of these names."""
    return _with_parameters(url, F.filter(_parameters(url), lambda p: ~p.rlike(rf"(?i)^(?:{names})(?:=|$)")))


def plan_key(url: Column) -> Column:
    """Addresses that are one page: no fragment, no slash at the end of the path, the path in lower case."""
    p = F.lower(path(url))
    p = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), p, query(url))


def locale_twin(url: Column) -> Column:
    """The plan key without a market's prefix; null without one."""
    own = r"(?i)^/(?:[a-z]{2}|[a-z]{2}-[a-z]{2})(?=/)"
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(path(url).rlike(own), plan_key(F.concat(base, F.regexp_replace(path(url), own, ""), query(url))))


def query_twin(url: Column) -> Column:
    """The plan key without a query that only picks an item, page or order; null otherwise."""
    names = _parameters(url)
    return F.when((F.size(names) > 0) & F.forall(names, lambda p: p.rlike(rf"(?i)^(?:{ITEM_PARAMETERS})(?:=|$)")), plan_key(F.regexp_extract(url, r"^([^?#]*)", 1)))


def plannable(url: Column) -> Column:
    p = path(url)
    return ~(p.rlike(rf"(?i)(?:^|/)(?:{UNPLANNED_FOLDERS})(?:/|$|\.)") | p.rlike(rf"(?i)\.(?:{UNPLANNED_FILES})$") | query(url).rlike(r"(?i)[?&](?:s|q|replytocom|share|print|add-to-cart)="))


def article_like(url: Column) -> Column:
    """A story or a file rather than the place: by folder, menu, gallery item, or a slug of eight words or a year."""
    folders = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    n, slug = F.size(folders), F.element_at(F.array_insert(folders, 1, F.lit("")), -1)
    before = F.element_at(F.concat(F.array(F.lit(""), F.lit("")), folders), -2)
    return (n > 0) & (
        F.exists(folders, lambda s: s.rlike(rf"^(?:{ARTICLE_FOLDERS})$") | s.rlike("(?:^|-)inspiration(?:-|$)") | s.rlike("^menus?$"))
        | slug.rlike("-menus?$") | ((n > 1) & before.rlike("^(?:gallery|galleries|portfolio|downloads?)$"))
        | (F.size(F.split(slug, "-")) >= 8) | slug.rlike(r"(?:^|-)20\d{2}(?:-|$)")
    )


def page_words(url: Column, label: Column) -> Column:
    words = F.concat_ws(" ", F.regexp_replace(path(url), r"[/_.-]+", " "), F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)\bnav\b", " "))
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def page_tier(url: Column, label: Column) -> Column:
    """1: the place itself and its contacts; 2: hire, events and spaces; 3: supporting; 4: menus, shops and articles."""
    text, p = page_words(url, label), path(url)
    has = lambda words: text.rlike(rf"(?i)\b(?:{words})\b")
    file = F.when(has(MENU_WORDS) | has(COMMERCE_WORDS), 4).when(has(HIRE_WORDS), 2).otherwise(3)
    return (
        F.when(p == "/", 1).when(has(CONTACT_WORDS), 1).when(p.rlike(r"(?i)\.pdf$"), file).when(has(MENU_WORDS) | has(COMMERCE_WORDS) | article_like(url), 4)
        .when(has(IDENTITY_WORDS), 1).when(has(HIRE_WORDS), 2).otherwise(3)
    )


def ipv4_number(address: Column) -> Column:
    """The address as a number; null if it is none."""
    parts = F.split(address, r"\.")
    shaped = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(shaped, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long")))


def public_ipv4(address: Column) -> Column:
    """Whether the address lies in no private or reserved network; null if it is none."""
    number, private = ipv4_number(address), F.lit(False)
    for first, prefix in PRIVATE_NETWORKS:
        base = sum(int(x) << shift for x, shift in zip(first.split("."), (24, 16, 8, 0), strict=True))
        private = private | F.shiftright(number, 32 - prefix).eqNullSafe(F.lit(base >> (32 - prefix)))
    return F.when(number.isNotNull(), ~private)


def redirect_reason(start: Column, location: Column, mode: Column, granted: Column) -> Column:
    """Why a redirect is followed or refused. `mode` is ENTRY, ROBOTS or PAGE; `granted` the origins a crawl may read."""
    scheme = F.lower(F.regexp_extract(location, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    origin = lambda u: F.regexp_extract(F.lower(u), r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    a, b = host(start), host(location)
    same_site = (a == b) | (www_counterpart(a) == b)
    closed = (b == "") | (b == "localhost") | b.rlike(r"\.(?:localhost|local|internal|onion)$") | ~F.coalesce(public_ipv4(b), F.lit(True)) | location.rlike(r"""["'\\]|%(?:22|27|5c)""")
    return (
        F.when(location.isNull() | (location == ""), "MISSING_LOCATION").when(scheme == "", "INVALID_LOCATION").when(scheme == "http", "HTTPS_DOWNGRADE").when(scheme != "https", "NON_HTTPS_SCHEME")
        .when(closed, "NON_PUBLIC_TARGET").when((mode == "ROBOTS") & (origin(start) == origin(location)), "SAME_ORIGIN").when((mode != "ROBOTS") & F.array_contains(granted, origin(location)), "GRANTED_ORIGIN")
        .when((mode == "ROBOTS") & same_site, "ROBOTS_WWW_APEX").when((mode == "ENTRY") & same_site, "WWW_APEX_CANONICAL")
        .when(registrable_domain(a).eqNullSafe(registrable_domain(b)) & registrable_domain(a).isNotNull(), "UNEVIDENCED_SUBDOMAIN").otherwise("CROSS_SITE")
    )


def retry_seconds(header: Column, now: Column) -> Column:
    """A Retry-After header as whole seconds from `now`: a number, or an HTTP date; null if neither or in the past."""
    number = F.when(header.rlike(r"^\s*\d{1,9}\s*$"), F.trim(header).try_cast("long"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\s*[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    late = F.unix_seconds(date) - F.unix_seconds(now.cast("timestamp"))
    return F.coalesce(number, F.when(late >= 0, late))
