"""The registered queries of the numbered operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.llm import chat_format, decontaminate, fill_in_middle, html_text, language_id, merkle, mixing, quality, simhash, substring_dedup, token_store, topk_search, url_filters
from venuelake.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_documents(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["b"] - r["a"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), substring_dedup.digest(F.col("kept")).alias("kept_sha256"), "n_passages")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    rebuilt = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_chats(chats.unionByName(planted)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    found = merkle.manifest(docs, carried=F.when(tampered, claimed)).withColumn("folded_root", merkle.fold(F.coalesce("carried", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_token_ids": op7_token_ids,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_topk_search": op10_topk_search,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_format": op12_chat_format,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _site(host: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}'))"


def _windows(table: str, key: str, at: str) -> str:
    """The windows of a table's texts, m words at each place."""
    return f"SELECT {key}, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM {table}{at})"


#: The template's marks as SQL: code points that a turn of a role has beside its text, and texts with control strings escaped.
_MARKED = "CASE role WHEN 'system' THEN 31 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 17 + length({0}) END"
_ESCAPED = r"regexp_replace({0}, '([<\[]\\*)(/?(?:s>|(?:INST|SYSTEM_PROMPT|ROLE)\]))', '\1\\\2', 'g')"
#: A number's bits one by one: CRC-32 of a decimal.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256]))),
        lambda a, b: CASE WHEN xor(a, b % 256) % 2 = 1 THEN xor(xor(a, b % 256) >> 1, 3988292384) ELSE xor(a, b % 256) >> 1 END))"""


def _hashed(n_chars: str) -> str:
    fields = "CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"
    return f"sha256({' || '.join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields)})"


_CLIMB = "list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1:i + 2], '')))"

#: SQL for the operators that it can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_url_filters": f"""WITH s AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
      r AS (SELECT *, CASE WHEN {_site("example.com")} AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN {_site("example.net")} AND starts_with(path, '/de/8') THEN 'example.net/de/8' WHEN {_site("com")} AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN {_site("net")} AND starts_with(path, '/de/') THEN 'net/de/' WHEN {_site("org")} AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM s)
      SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN regexp_matches(host || path, '^([^/]*[.-])?({"|".join(url_filters.UNWANTED_HOST_WORDS)})([.:/-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
      b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM benchmark) WHERE len(w) > 0),
      bw AS (SELECT DISTINCT item_id, m, win FROM ({_windows("b", "item_id", "")})),
      h AS (SELECT doc_id, i, x.m, item_id FROM ({_windows("d", "doc_id", ", (SELECT DISTINCT m FROM b)")}) x JOIN bw ON bw.m = x.m AND bw.win = x.win),
      n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
      t AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS items FROM h GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_fill_in_middle": r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
      d AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS h1, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS h2, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS h4 FROM u),
      f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:], '') AS s FROM d)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM f""",
    "op12_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
      e AS (SELECT *, length({_ESCAPED.format("text")}) + {_MARKED.format(_ESCAPED.format("role"))} AS n FROM c)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_merkle_manifest": f"""WITH RECURSIVE l AS (SELECT doc_id, lang, {_hashed("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 AND n_chars IS NOT NULL THEN {_hashed("n_chars + 1")} END AS claimed FROM documents),
      p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
      t AS (SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang UNION ALL SELECT lang, k + 1, {_CLIMB} FROM t WHERE len(nodes) > 1),
      s AS (SELECT lang, k AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t WHERE len(nodes) = 1),
      c AS (SELECT 0 AS k, list(subroot ORDER BY g) AS nodes FROM s UNION ALL SELECT k + 1, {_CLIMB} FROM c WHERE len(nodes) > 1),
      r AS (SELECT k AS depth, nodes[1] AS root FROM c WHERE len(nodes) = 1),
      steps AS (SELECT p.lang, p.pos, t.k, (p.pos >> t.k) % 2 AS side, t.nodes[xor(p.pos >> t.k, 1) + 1] AS other FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND len(t.nodes) > 1
        UNION ALL SELECT p.lang, p.pos, s.depth + c.k, (s.g >> c.k) % 2, c.nodes[xor(s.g >> c.k, 1) + 1] FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN c ON len(c.nodes) > 1),
      proofs AS (SELECT lang, pos, list(struct_pack(k := k, side := side, other := coalesce(other, '')) ORDER BY k) AS steps FROM steps GROUP BY lang, pos),
      x AS (SELECT p.*, s.subroot, r.root, coalesce(q.steps, []) AS steps FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN r ON true LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos),
      f AS (SELECT lang, pos, 0 AS k, coalesce(claimed, leaf) AS h, steps FROM x UNION ALL SELECT lang, pos, k + 1, sha256(CASE WHEN steps[k + 1].side = 1 THEN steps[k + 1].other || h ELSE h || steps[k + 1].other END), steps FROM f WHERE k < len(steps))
      SELECT x.doc_id, x.leaf, x.subroot, x.root, sha256(array_to_string(list_transform(x.steps, lambda z: z.other), '')) AS proof_sha256, f.h AS folded_root, f.h = x.root AS verified
      FROM x JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.pos = x.pos AND f.k = len(x.steps)""",
}
