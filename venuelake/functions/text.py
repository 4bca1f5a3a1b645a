"""Column functions over strings, names, addresses of mail and web, and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named entities that are decoded; the ampersand is decoded last.
ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("trade", "™"), ("pound", "£"), ("euro", "€"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("lsquo", "‘"), ("rsquo", "’"),
    ("ldquo", "“"), ("rdquo", "”"), ("bull", "•"), ("middot", "·"), ("times", "×"), ("deg", "°"), ("eacute", "é"), ("egrave", "è"), ("agrave", "à"), ("ccedil", "ç"), ("ouml", "ö"), ("uuml", "ü"), ("auml", "ä"), ("ntilde", "ñ"), ("frac12", "½"), ("amp", "&"),
)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def told_number(digits: Column, kind: str = "int") -> Column:
    """The number that digits tell, null for none: a cast of an empty text costs an exception, by far more than a match."""
    return F.when(digits != "", digits.try_cast(kind))


def escaped_ilike(c: Column, text: str) -> Column:
    """Case-insensitive containment with wildcards of the text taken literally."""
    literal = text.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.lower(c).like(f"%{literal}%")


def _numeric_decoded(text: Column) -> Column:
    """Decimal and hexadecimal references decoded; those of no character are left as they stand."""
    parts = F.split(text, "&#")
    known = r"(?s)^(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));(.*)$"
    code = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, known, 1), F.lit("")).try_cast("int"), F.conv(F.nullif(F.regexp_extract(p, known, 2), F.lit("")), 16, 10).try_cast("int"))
    valid = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    # UTF-32 has a character's code as its bytes
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    piece = lambda p, i: F.when(i == 0, p).when(F.coalesce(valid(code(p)), F.lit(False)), F.concat(char(code(p)), F.regexp_extract(p, known, 3))).otherwise(F.concat(F.lit("&#"), p))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, piece), "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles and tags, with references decoded and white space collapsed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    text = _numeric_decoded(F.regexp_replace(text, r"(?s)<[^>]*>", " "))
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), 1)


def slug_key(name: Column, domain: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.concat(slug, F.lit("|"), F.coalesce(domain, F.lit("")))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from the SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def shell_signals(html: Column) -> Column:
    """What tells that a script fills a page, in fixed order."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body>|$)", 1), F.lit("")), html)
    size = F.length(visible_text(body))
    told = (
        ("EMPTY_FRAMEWORK_MOUNT", html.rlike(r"(?is)<div\b[^>]*\bid=[\"'](?:__next|__nuxt|root|app|svelte|___gatsby|q-app)[\"'][^>]*>\s*(?:</div>|<noscript)")),
        ("NEXT_DATA", html.rlike(r"(?i)<script\b[^>]*id=[\"']__NEXT_DATA__[\"']")),
        ("NUXT_STATE", html.rlike(r"(?i)__NUXT__|__NUXT_DATA__")),
        ("NOSCRIPT_JS_REQUIRED", html.rlike(r"(?i)<noscript\b[^>]*>[^<]*(?:enable|requires?)\s+javascript")),
        ("METADATA_WITHOUT_BODY", html.rlike(r"(?i)<meta\b[^>]*(?:name|property)=[\"'](?:description|og:description)[\"'][^>]*content=[\"'][^\"']{40,}") & (size < 200)),
        ("SCRIPT_HEAVY_THIN_BODY", (F.regexp_count(html, F.lit(r"(?i)<script\b")) >= 8) & (size < 300)),
    )
    return F.array_compact(F.array(*[F.when(test, name) for name, test in told]))


def shell_page(html: Column) -> Column:
    """Whether a page is a thin shell that a script fills: under 400 characters to see, and a signal."""
    html = F.coalesce(html, F.lit(""))
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body>|$)", 1), F.lit("")), html)
    return (F.length(visible_text(body)) < 400) & (F.size(shell_signals(html)) > 0)


def looks_binary(sample: Column) -> Column:
    """A NUL, or over one control character in twenty, among the first 4096."""
    head = F.substring(sample, 1, 4096)
    controls = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0E-\x1F]"))
    return head.rlike(r"\x00") | (controls * 20 > F.length(head))
