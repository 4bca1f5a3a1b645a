"""Column functions over JSON documents, ids and names."""

from __future__ import annotations

import gzip
import json
import unicodedata
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words of two digits.
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
ONES = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
#: Legal forms and words that are left out of names of organisations, by the rule that leaves them out.
LEGAL_FORMS = r"\b(?:ltd|limited|plc|llp|inc|pty|cc|npc|gmbh)\b"
GENERIC_NAMES = r"\b(?:the|venue|hall|centre|center|hotel|club|events?)\b"
#: Parameters that must not be recorded.
SECRETS = r"token|key|api_?key|secret|signature|sig|password|auth|session(?:id)?"


def has_keys(document: Column, keys: Sequence[str]) -> Column:
    """Whether a JSON object has all of the keys; false for other texts and null."""
    return F.coalesce(F.size(F.array_intersect(F.json_object_keys(document), F.array(*map(F.lit, keys)))) == len(keys), F.lit(False))


def shape(document: Column) -> Column:
    """object, array, scalar, or null where the text is no JSON."""
    parsed = F.try_parse_json(document)
    kind = F.schema_of_variant(parsed)
    return F.when(parsed.isNull(), None).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("scalar")


def without_keys(document: Column, keys: Sequence[str]) -> Column:
    """A JSON object of texts and numbers without the keys, the rest in order of their names."""
    values = F.from_json(document, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(values, lambda k, v: ~k.isin(*keys) & v.isNotNull())))))


def stable_json(document: Column) -> Column:
    """The document with its keys sorted at every depth and no spaces, so that equal documents are equal texts; null for no JSON."""

    def stable(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(stable, "string")(document)


def search_fingerprint(query: Column) -> Column:
    """SHA-256 of a search as {"query": ...}: compatibility forms unified, white space collapsed, lower case."""

    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps({"query": " ".join(unicodedata.normalize("NFKC", t).split()).lower()}, ensure_ascii=False, separators=(",", ":")) for t in texts.to_pylist()], pa.string())

    return F.sha2(F.arrow_udf(folded, "string")(query), 256)


def inflated(body: Column, most: int = 5_000_000) -> Column:
    """A body that was sent as it is, in gzip or deflate, as text; null where it is damaged or longer than `most`."""

    def opened(bodies: pa.Array) -> pa.Array:
        out = []
        for b in bodies.to_pylist():
            try:
                if b is None:
                    data = None
                elif b[:2] == b"\x1f\x8b" or b[:1] == b"\x78":
                    reader = zlib.decompressobj(47)
                    data = reader.decompress(b, most + 1)
                    data = data if reader.eof or len(data) > most else None
                else:
                    data = b
                out.append(None if data is None or len(data) > most else data.decode("utf-8", "replace"))
            except zlib.error:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(opened, "string")(body)


def deflated(text: Column, kind: str) -> Column:
    """The text as sent in gzip or deflate: the inverse of `inflated`."""
    pack = (lambda b: gzip.compress(b, mtime=0)) if kind == "gzip" else zlib.compress
    return F.arrow_udf(lambda texts: pa.array([None if t is None else pack(t.encode()) for t in texts.to_pylist()], pa.binary()), "binary")(text)


def cursor(filters: Column, page: Column, place: Column) -> Column:
    """A page's cursor: URL-safe Base64 of its place, bound to a hash of the filters and to the page."""
    body = F.concat_ws("\n", F.sha2(filters, 256), page.cast("string"), place)
    return F.regexp_replace(F.translate(F.base64(F.encode(body, "UTF-8")), "+/", "-_"), r"[=\r\n]", "")


def cursor_place(code: Column, filters: Column, page: Column) -> Column:
    """The place of a cursor made for these filters and this page; null for any other, or a damaged one."""
    shaped = code.rlike("^[A-Za-z0-9_-]+$") & (F.length(code) % 4 != 1)
    padded = F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    body = F.split(F.decode(F.unbase64(F.when(shaped, padded)), "UTF-8"), "\n", 3)
    return F.when((F.size(body) == 3) & (F.get(body, F.lit(0)) == F.sha2(filters, 256)) & (F.get(body, F.lit(1)) == page.cast("string")), F.get(body, F.lit(2)))


def digits_of_words(text: Column) -> Column:
    """Number words from twenty to ninety-nine as digits, in lower case."""
    out = F.lower(text)
    for tens, n in TENS.items():
        for ones, m in ONES.items():
            out = F.regexp_replace(out, rf"\b{tens}[ -]{ones}\b", str(n + m))
        out = F.regexp_replace(out, rf"\b{tens}\b", str(n))
    return out


def company_name(name: Column) -> Column:
    """A name for comparison with a register: & as and, without its legal form."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, LEGAL_FORMS, " "), r"\s+", " "))


def distinctive_words(name: Column) -> Column:
    """The words of a name over two letters that are not generic."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.rlike(f"^{GENERIC_NAMES}$"))


def without_secrets(url: Column) -> Column:
    """The URL without parameters that must not be recorded."""
    from venuelake.functions.addresses import without_tracking

    return without_tracking(url, SECRETS)
