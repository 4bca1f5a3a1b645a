"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule list is configuration that each task holds whole; a longer one is refused.
MAX_RULES = 100_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_TOKEN_JVM = "[A-Za-z0-9]+"

#: Words that mark a host as unwanted where no listed rule fits.
UNWANTED_HOST_WORDS = ("casino", "poker", "pills", "viagra", "lottery", "xxx", "porn", "torrent", "warez", "phishing", "malware")


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host + path. `tokens` are the runs of letters and digits that stand whole in every URL it
    matches; `name` is what the result reports (None: the method's own rules)."""

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_path_rule(verdict: str, rule: str) -> UrlRule:
    """`host/path`: fits the host and all its subdomains where the URL's path starts with the rule's. The last token of a
    path may go on in a URL, so it serves the index only if something closes it."""
    host, slash, rest = rule.partition("/")
    closed = rule if not _TOKEN.fullmatch(rule[-1:]) or not rest else rule[: len(rule) - len(_TOKEN.findall(rule)[-1])]
    end = "" if slash else r"(?:/|$)"
    return UrlRule(rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}{end}", verdict, tuple(_TOKEN.findall(closed)), rule)


def host_word_rule(verdict: str, word: str) -> UrlRule:
    """The word stands whole, between dots, hyphens or ends, in the host."""
    return UrlRule(rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.:/-]|$)", verdict, (word,))


#: The rules of the registered query.
LISTED_RULES = tuple(
    host_path_rule(verdict, rule)
    for verdict, rule in (
        ("block", "com/en/"),
        ("allow", "example.com/en/7"),
        ("allow", "net/de/"),
        ("block", "example.net/de/8"),
        ("block", "org/es/"),
    )
)
DEFAULT_RULES = tuple(host_word_rule("block", w) for w in UNWANTED_HOST_WORDS)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path follows up
    to `?`, `#` or the end. Null and no `://`: both empty."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    if not found:
        return "", ""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]


def index_rules(rules: Iterable[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list], list]:
    """Rules by their rarest token (of equally rare ones the longest, then the least), and those without a token."""
    by_token: dict[str, list] = {}
    always: list = []
    for rule in rules:
        entry = (re.compile(rule.pattern, re.S), rule)
        if rule.tokens:
            token = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            by_token.setdefault(token, []).append(entry)
        else:
            always.append(entry)
    return by_token, always


def _best(rule: UrlRule) -> tuple:
    """Listed rules go before the method's own; then the longest wins, and of equally long ones the first by name."""
    return (rule.name is None, -len(rule.name or rule.pattern), rule.name or rule.pattern, rule.verdict)


def judge(host: str, path: str, by_token: dict[str, list], always: list, default: str) -> tuple[str | None, str]:
    """(rule, verdict): only rules that a token of the URL fetches, and those without a token, run their expressions."""
    address = host + path
    candidates = [e for t in set(_TOKEN.findall(address)) if t in by_token for e in by_token[t]] + always
    fits = [rule for pattern, rule in candidates if pattern.match(address)]
    if not fits:
        return None, default
    rule = min(fits, key=_best)
    return rule.name, rule.verdict


def token_counts(urls: DataFrame, url_col: str, rules: Iterable[UrlRule]) -> dict[str, int]:
    """How many rows hold each token of the rules, by one grouped aggregation; at most one row a rule token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(url_col), F.lit("")), F.lit(f"({_TOKEN_JVM})")))
    kept = urls.select(F.explode(F.filter(tokens, lambda t: t.isin(wanted))).alias("t"))
    return {r["t"]: r["n"] for r in kept.groupBy("t").agg(F.count("*").alias("n")).collect()}


def url_verdict(url: Column, rules: Iterable[UrlRule], counts: dict[str, int], default: str = "allow") -> Column:
    """struct<host, path, rule, verdict> of a URL."""
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a list holds at most {MAX_RULES}")
    kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    built: list = []

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def verdicts(urls: pa.Array) -> pa.Array:
        if not built:
            built.append(index_rules(rules, counts))
        rows = []
        for u in urls.to_pylist():
            host, path = split_url(u)
            rule, verdict = judge(host, path, *built[0], default)
            rows.append({"host": host, "path": path, "rule": rule, "verdict": verdict})
        return pa.array(rows, kind)

    return verdicts(url)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[UrlRule] = LISTED_RULES,
    defaults: Iterable[UrlRule] = DEFAULT_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row, repeated rows included, without a shuffle of the pages.

    `rules` are decided first, the longest that fits; where none fits, the method's own rules (`defaults`) decide and
    `rule` is null; else the verdict is allow. A null or empty URL, or one without `://`, has an empty host and path and is
    allowed. An empty table gives an empty result; other columns are ignored.
    """
    rules = (*rules, *defaults)
    counts = token_counts(pages, url_col, rules)
    return pages.select(F.col(id_col), url_verdict(F.col(url_col), rules, counts).alias("v")).select(id_col, "v.host", "v.path", "v.rule", "v.verdict")
