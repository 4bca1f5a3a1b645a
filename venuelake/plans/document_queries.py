"""Registered queries of predicates, documents, ids and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import documents
from venuelake.plans.catalog import pick, register, sql_pick
from venuelake.sources.tables import table

VIEWS = {
    "needs-work": "o_orderstatus = 'O' AND o_orderpriority LIKE '1%'",
    "high-value": "o_totalprice > 300000",
    "old": "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
}


@register("saved_views", " UNION ALL ".join(f"SELECT '{v}' AS view, o_orderkey FROM orders WHERE {test}" for v, test in VIEWS.items()))
def saved_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"needs-work": (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1"), "high-value": F.col("o_totalprice") > 300000, "old": F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")}
    named = F.array_compact(F.array(*[F.when(test, F.lit(v)) for v, test in tests.items()]))  # all views in one scan
    return table(spark, sf_dir, "orders").select(F.explode(named).alias("view"), "o_orderkey")


@register("date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-05-31 23:59:59.999'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(at("1996-03-01 00:00:00"), at("1996-05-31 23:59:59.999"))).select("o_orderkey", "o_orderdate")


@register("parameterised_scan", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal >= 1000")
def parameterised_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT c_custkey, c_name FROM {customers} WHERE c_mktsegment = :segment AND c_acctbal >= :least"
    return spark.sql(text, args={"segment": "FURNITURE", "least": 1000}, customers=table(spark, sf_dir, "customer"))


NOTES = ("More research needed", "call the owner", "Find evidence first", "RESEARCH MORE", "ok", None)


@register(
    "format_predicates",
    f"""WITH n AS (SELECT event_id, {sql_pick(NOTES, "event_id")} AS note, CASE WHEN event_id % 3 = 0 THEN sha256(CAST(event_id AS VARCHAR)) ELSE upper(left(sha256(CAST(event_id AS VARCHAR)), 64)) END AS h FROM events)
      SELECT event_id, coalesce(NOT regexp_matches(note, '(more research|find evidence|research more)', 'i'), false) AS actionable, regexp_full_match(h, '[a-f0-9]{{64}}') AS is_hash FROM n""",
)
def format_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    h = F.sha2(e.cast("string"), 256)
    note = pick(NOTES, e)
    return table(spark, sf_dir, "events").select(
        e, F.coalesce(~note.rlike("(?i)(more research|find evidence|research more)"), F.lit(False)).alias("actionable"), F.when(e % 3 == 0, h).otherwise(F.upper(h)).rlike("^[a-f0-9]{64}$").alias("is_hash")
    )


DOCS = ('{"b":1,"a":{"d":[2,1],"c":"é"},"z":null}', "[1,2,3]", "7", "{broken", '{"x":"y","b":"2","a":"k"}', None, "{}")
_SHAPES = ("object", "array", "scalar", None, "object", None, "object")
_STABLE = ('{"a":{"c":"é","d":[2,1]},"b":1,"z":null}', "[1,2,3]", "7", None, '{"a":"k","b":"2","x":"y"}', None, "{}")


@register(
    "json_documents",
    f"SELECT event_id, {sql_pick(_SHAPES, 'event_id')} AS shape, event_id % 7 IN (0, 4) AS has_keys, sha256({sql_pick(_STABLE, 'event_id')}) AS stable_hash, CASE WHEN event_id % 7 = 1 THEN 3 END AS entries FROM events",
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    rows = table(spark, sf_dir, "events").select("event_id", pick(DOCS, F.col("event_id")).alias("d"))
    return rows.select("event_id", documents.shape(d).alias("shape"), documents.has_keys(d, ["a", "b"]).alias("has_keys"), F.sha2(documents.stable_json(d), 256).alias("stable_hash"), F.json_array_length(d).alias("entries"))


@register(
    "plain_documents",
    """SELECT c_custkey, '{' || CASE WHEN c_custkey % 3 > 0 THEN '"city":"' || c_mktsegment || '",' ELSE '' END || '"name":"' || c_name || '"}' AS document FROM customer""",
)
def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a value and two named ones are left out of a row's document."""
    whole = F.to_json(F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("city"), F.col("c_nationkey").alias("k1"), F.col("c_acctbal").alias("k2")))
    return table(spark, sf_dir, "customer").select("c_custkey", documents.without_keys(whole, ["k1", "k2"]).alias("document"))


@register(
    "fact_exists",
    "SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity > 40) AS found, list_distinct(list_sort(list(l_linenumber) FILTER (WHERE l_returnflag = 'A'))) IS NOT NULL AS any_a FROM lineitem GROUP BY 1",
)
def fact_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("facts"))  # an order's lines are few
    return facts.select("l_orderkey", F.exists("facts", lambda f: (f["l_returnflag"] == "R") & (f["l_quantity"] > 40)).alias("found"), F.exists("facts", lambda f: f["l_returnflag"] == "A").alias("any_a"))


@register("distinct_with_filter", "SELECT user_id, count(DISTINCT event_type) FILTER (WHERE value > 50) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def distinct_with_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))


@register(
    "page_cursors",
    "SELECT event_id, CASE WHEN event_id % 5 NOT IN (1, 2, 3) THEN event_type || '/' || event_id END AS place FROM events",
)
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors made for a page are read back; those for other filters, another page, or damaged ones are refused."""
    e = F.col("event_id")
    filters, page = F.concat(F.lit("user="), F.col("user_id").cast("string")), e % 9
    code = documents.cursor(filters, page, F.concat_ws("/", "event_type", e.cast("string")))
    code = F.when(e % 5 == 3, F.concat(F.lit("!"), code)).otherwise(code)
    rows = table(spark, sf_dir, "events").select(e, code.alias("code"), F.when(e % 5 == 1, "other").otherwise(filters).alias("f"), F.when(e % 5 == 2, page + 1).otherwise(page).alias("p"))
    return rows.select(e, documents.cursor_place(F.col("code"), F.col("f"), F.col("p")).alias("place"))


@register("inflated_bodies", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 < 3 THEN text END AS body FROM conversations")
def inflated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 4
    plain = F.col("text").cast("binary")
    cut = F.expr("substring(g, 1, length(g) - 9)")
    rows = table(spark, sf_dir, "conversations").withColumn("g", documents.deflated(F.col("text"), "gzip")).withColumn("z", documents.deflated(F.col("text"), "deflate"))
    body = F.when(k == 0, plain).when(k == 1, F.col("g")).when(k == 2, F.col("z")).otherwise(cut)
    return rows.select("conv_id", "turn", documents.inflated(body).alias("body"))


SEARCHES = ("  Grand   Hall ", "ＧＲＡＮＤ hall", "ﬁne Café", "x\ty")
_FOLDED = ("grand hall", "grand hall", "fine café", "x y")


@register("search_fingerprints", f"""SELECT event_id, sha256('{{"query":"' || {sql_pick(_FOLDED, "event_id")} || '"}}') AS fingerprint FROM events""")
def search_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", documents.search_fingerprint(pick(SEARCHES, F.col("event_id"))).alias("fingerprint"))


WORDED = ("Studio Twenty-One", "fifty people or ninety nine", "Thirty", "twentyone", "The Seventy Two Club")
_DIGITS = ("studio 21", "50 people or 99", "30", "twentyone", "the 72 club")
COMPANIES = ("Hall & Sons Ltd.", "The Venue Company (Pty) Ltd", "Lakeside Events plc", "AB Hotel Club", "Grand-Hall Centre")
_COMPANIES = ("hall and sons", "the venue company", "lakeside events", "ab hotel club", "grand hall centre")
_DISTINCT = ("sons,ltd", "company,pty,ltd", "lakeside,plc", "", "grand")


@register("name_variants", f"SELECT event_id, {sql_pick(_DIGITS, 'event_id')} AS digits, {sql_pick(_COMPANIES, 'event_id')} AS company, {sql_pick(_DISTINCT, 'event_id')} AS words FROM events")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e, documents.digits_of_words(pick(WORDED, e)).alias("digits"), documents.company_name(pick(COMPANIES, e)).alias("company"), F.array_join(documents.distinctive_words(pick(COMPANIES, e)), ",").alias("words")
    )


LINKS = ("https://a.org/x?token=1&id=2", "https://a.org/x?API_KEY=1", "https://a.org/x?id=1&sig=2#top", "https://a.org/x")
_CLEAN = ("https://a.org/x?id=2", "https://a.org/x", "https://a.org/x?id=1", "https://a.org/x")


@register("manifest_urls", f"SELECT event_id, {sql_pick(_CLEAN, 'event_id')} AS url FROM events")
def manifest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", documents.without_secrets(pick(LINKS, F.col("event_id"))).alias("url"))


@register(
    "calendar_facts",
    """WITH f AS (SELECT event_id, 'u' || event_id % 9 AS url, 'p' || user_id AS page, CAST(ts AS DATE) AS day FROM events), c AS (SELECT o_orderkey AS candidate, 'u' || o_orderkey % 40 AS url, 'p' || o_custkey % 50 AS page, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS DATE) AS day FROM orders)
      SELECT candidate, count(*) AS facts FROM c JOIN f ON f.day = c.day AND (f.url = c.url OR f.page = c.page) GROUP BY 1""",
)
def calendar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the same day and address or page: those of the address and those of the page, less those of both. Facts are counted
    by what they are sought by, so no pair of a candidate and a fact is made."""
    e, o = F.col("event_id"), F.col("o_orderkey")
    f = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (e % 9).cast("string")).alias("url"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("page"), F.to_date("ts").alias("day"))
    c = table(spark, sf_dir, "orders").select(o.alias("candidate"), F.concat(F.lit("u"), (o % 40).cast("string")).alias("url"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("page"), F.date_add(F.lit("2024-01-01").cast("date"), (o % 30).cast("int")).alias("day"))
    kinds = c.groupBy("day", "url", "page").agg(F.count("*"))
    for keys, name in ((["day", "url"], "by_url"), (["day", "page"], "by_page"), (["day", "url", "page"], "by_both")):
        kinds = kinds.join(f.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    found = kinds.select(*[F.col(k).alias(f"c_{k}") for k in ("day", "url", "page")], (zero("by_url") + zero("by_page") - zero("by_both")).alias("facts")).filter("facts > 0")
    same = F.col("day").eqNullSafe(F.col("c_day")) & F.col("url").eqNullSafe(F.col("c_url")) & F.col("page").eqNullSafe(F.col("c_page"))
    return c.join(found, same).groupBy("candidate").agg(F.sum("facts").alias("facts"))


@register(
    "best_tier_only",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1",
)
def best_tier_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    best = lines.groupBy("l_partkey").agg(F.max("l_quantity").alias("l_quantity"))
    return lines.join(best, ["l_partkey", "l_quantity"]).select("l_partkey", "l_orderkey", "l_linenumber")


CONTEXT = ('{"template":"t1","booking_date":"5 May","token":"x"}', '{"resource":"r","guests":"80"}', "{}", None)
_CONTEXT = ("template:date=5 May", "resource:guests=80", "none:", "none:")


@register("source_context", f"SELECT event_id, {sql_pick(_CONTEXT, 'event_id')} AS context FROM events")
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a submission came from, and its selections by a list of allowed keys, prefixes dropped."""
    values = F.from_json(pick(CONTEXT, F.col("event_id")), "map<string,string>")
    kept = F.map_filter(values, lambda k, v: k.rlike("^(?:booking_)?(?:date|guests|layout)$"))
    names = F.transform(F.array_sort(F.map_entries(kept)), lambda x: F.concat(F.regexp_replace(x["key"], "^booking_", ""), F.lit("="), x["value"]))
    kind = F.when(F.map_contains_key(values, "template"), "template").when(F.map_contains_key(values, "resource"), "resource").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", F.concat(kind, F.lit(":"), F.coalesce(F.array_join(names, ";"), F.lit(""))).alias("context"))


SUFFIXES = ("hall.org", "hall.invalidtld", "co.uk", "my.hall.co.uk", "localhost")
_PUBLIC = ("true", "false", "false", "true", "false")


@register("mail_suffixes", f"SELECT event_id, CAST({sql_pick(_PUBLIC, 'event_id')} AS BOOLEAN) AS recognised FROM events")
def mail_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail domain is recognised if a suffix in a table of public ones, of any length, has a name before it."""
    suffixes = spark.createDataFrame([("org",), ("com",), ("uk",), ("co.uk",), ("za",)], "suffix string")
    d = F.col("d")
    rows = table(spark, sf_dir, "events").select("event_id", pick(SUFFIXES, F.col("event_id")).alias("d"))
    names = rows.select("d").distinct()
    labels = F.split(d, r"\.")
    every = names.select("d", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at", "suffix"))
    longest = every.join(suffixes, "suffix").groupBy("d").agg(F.min("at").alias("at"))
    return rows.join(longest, "d", "left").select("event_id", (F.coalesce("at", F.lit(0)) > 0).alias("recognised"))


