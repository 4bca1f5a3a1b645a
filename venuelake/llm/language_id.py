"""Language identification of pages by Bayesian evidence fusion."""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import checkpointed, small_batches, spread_join

#: Hash buckets of the character trigrams, as a power of two.
BUCKET_BITS = 15
#: Languages a model may have at most: its table, of 128 KB a language, is sent to every task. More labels than languages
#: exist are a fault of the table, which is refused.
MAX_LANGUAGES = 1024
#: Neighbouring trigrams share characters, so each counts as this part of an independent observation.
TEMPER = 0.3
#: Pages' worth of evidence that a parent level lends to its child's prior.
PRIOR_WEIGHT = 4.0
_LANG_ATTR = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def trigram_buckets(text: str) -> np.ndarray:
    """A hash bucket for each three characters of the lower-cased text; runs of digits and signs count as one space."""
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def visible_text(html: str | None) -> str:
    return html_entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html or "")))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from all documents: each task counts into one table a language, so at most
    languages x buckets rows a task are shuffled. Null languages and texts are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in tables and len(tables) >= MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                tables[lang] = tables.get(lang, 0) + np.bincount(trigram_buckets("\n".join(texts)), minlength=1 << BUCKET_BITS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(table[at])], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    counts = checkpointed(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
    got = counts.toPandas()  # at most languages x buckets rows
    np.add.at(table, (got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)), got["n"].to_numpy(float))
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _sum_columns(n: int, name: str) -> list[Column]:
    return [F.sum(f"p{i}").alias(f"{name}{i}") for i in range(n)]


def identify(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(id, lang, probability, text_lang, declared, host) for every page, repeated rows included.

    The posterior of a language is the product of the text's likelihood, the likelihoods of the declared markup language and
    of the address (its last label and a two-letter first folder), and the host's prior. A host's prior is smoothed by its
    domain's, that by the whole table's; each leaves the page itself out. All are grouped sums of the texts' posteriors, so
    a hot host costs one row a task. A page without text rests on the other evidence; one without any on the whole table's
    prior; ties go to the first language by name. Without labelled documents lang is null and probability 0. Null addresses
    and pages have empty hosts and texts; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    languages, table = train(docs, text_col, lang_col)
    if not languages:
        return pages.select(F.col(id_col), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), _host(F.col(url_col)).alias("host"))
    n = len(languages)
    sent = pages.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("declared string, logs array<double>")
    def read(htmls: pa.Array) -> pa.Array:
        declared, logs = [], []
        for page in htmls.to_pylist():
            found = _LANG_ATTR.search(page or "")
            declared.append(found[1].lower() if found else None)
            total = sent.value @ np.bincount(trigram_buckets(visible_text(page)), minlength=1 << BUCKET_BITS).astype(float)
            logs.append(TEMPER * (total - total.max()))
        return pa.StructArray.from_arrays([pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))], names=["declared", "logs"])

    host = _host(F.col(url_col))
    labels = F.split("host", r"\.")
    text_sum = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x))
    seen = (
        pages.select(F.col(id_col).alias("id"), host.alias("host"), F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1).alias("folder"), read(F.col(html_col)).alias("r"))
        .select("id", "host", "folder", "r.declared", "r.logs")
        .withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
        .withColumn("address", F.concat_ws("/", F.element_at(labels, -1), F.lower("folder")))
        .withColumn("total", text_sum)
        .select("id", "host", "domain", "address", F.coalesce("declared", F.lit("")).alias("declared"), "logs", *[(F.exp(F.col("logs")[i]) / F.col("total")).alias(f"p{i}") for i in range(n)])
    )
    seen = checkpointed(seen)
    hosts = checkpointed(seen.groupBy("host").agg(*_sum_columns(n, "h"), F.first("domain").alias("domain"), F.count("*").alias("n")))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in range(n)], F.sum("n").alias("n"))
    whole = [float(v or 0.0) for v in seen.agg(*_sum_columns(n, "a")).first()]
    base = [(v + 1.0) / (sum(whole) + n) for v in whole]
    kinds = {}
    for name in ("declared", "address"):
        kinds[name] = seen.groupBy(name).agg(*_sum_columns(n, name[0] * 2), F.count("*").alias("n"))
    # pages of a hot host, domain or kind stay where they are
    joined = seen
    for name, counted in {"host": hosts.drop("domain"), "domain": domains, **kinds}.items():
        joined = spread_join(joined, checkpointed(counted), [name]).drop("n")
    # the page's own share is taken out of every sum before it serves as evidence on the page
    logs = []
    for i in range(n):
        less = lambda c, i=i: F.greatest(F.col(f"{c}{i}") - F.col(f"p{i}"), F.lit(0.0))
        every = lambda c: sum((F.col(f"{c}{j}") for j in range(n)), F.lit(-1.0))
        domain = (less("d") + PRIOR_WEIGHT * base[i]) / (every("d") + PRIOR_WEIGHT)
        prior = (less("h") + PRIOR_WEIGHT * domain) / (every("h") + PRIOR_WEIGHT)
        of = max(whole[i], 1.0)
        declared = F.when(F.col("declared") == "", F.lit(1.0)).otherwise((less("dd") + 0.5) / (of + 1.0))
        address = F.when(F.col("host") == "", F.lit(1.0)).otherwise((less("aa") + 0.5) / (of + 1.0))
        logs.append(F.log(prior) + F.col("logs")[i] + F.log(declared) + F.log(address))
    most = F.greatest(*logs) if n > 1 else logs[0]
    fused = joined.select("id", "host", "declared", "logs", F.array(*logs).alias("fused"), most.alias("most"))
    at = lambda c: F.element_at(F.array(*map(F.lit, languages)), F.array_position(F.col(c), F.array_max(c)).cast("int"))
    share = F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return fused.select(F.col("id").alias(id_col), at("fused").alias("lang"), share.alias("probability"), at("logs").alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host")
