"""Benchmark decontamination with DataFrame functions only: windows of benchmark words are looked up in training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import ascii_lower, checkpointed, nested, spread_join

#: Words of a window.
WINDOW = 10
#: Longs of a screen: a set of hashes kept as bits, of one size for every benchmark, which each task holds.
SCREEN_LONGS = 1 << 17
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_CHARS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))


def _trimmed(text: Column) -> Column:
    return F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_BREAK_CHARS))


def _split(trimmed: Column) -> Column:
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BREAKS))


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters outside ASCII, after A-Z is lower-cased; null has none."""
    return _split(_trimmed(text))


def _window_at(w: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, start, length), " ")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id as string, m, win): the windows of each item, of m = `window` words, or all words of a shorter item."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    return (
        w.select("item", "w", m.alias("m"), F.explode(F.sequence(F.lit(1), F.size("w") - m + 1)).alias("i"))
        .select("item", "m", _window_at(F.col("w"), F.col("i"), F.col("m")).alias("win"))
        .distinct()
    )


def _screen(hashes: DataFrame, longs: int) -> str:
    """The bits of a set of 64-bit hashes `h` as SQL of an array of longs. Only rows with a bit come back, at most `longs`."""
    at = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(longs - 1)).cast("int")
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    held = [0] * longs
    for r in hashes.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        held[r["at"]] = r["bits"]
    return f"CAST(split('{','.join(map(str, held))}', ',') AS ARRAY<BIGINT>)"


def _in(screen: str, h: str, longs: int) -> str:
    return f"getbit(get({screen}, CAST((shiftrightunsigned({h}, 6) & {longs - 1}L) AS INT)), CAST({h} & 63 AS INT)) = 1"


def _gram(m: int) -> int:
    """Words of a gram such that each window of `m` words holds a whole one of those a text is cut into."""
    return (m + 1) // 2


def _places(lengths: list[int], known_grams: str, known_windows: str, longs: int) -> Column:
    """Window places (i, m) that may hold a benchmark window, in a text whose words are `w`.

    The text is cut into grams of half a window, side by side, and only where one of them may be the benchmark's are the
    windows around it hashed as a whole.
    """
    found = []
    for m in lengths:
        g = _gram(m)
        grams = f"filter(sequence(1, size(w) - {g - 1}, {g}), p -> exists(array(xxhash64(slice(w, p, {g}))), h -> {_in(known_grams, 'h', longs)}))"
        around = f"flatten(transform({grams}, p -> transform(sequence(greatest(1, p - {g - 1}), p), i -> struct(i AS i, {m} AS m))))"
        windows = f"filter({around}, q -> q.i <= size(w) - {m - 1} AND exists(array(xxhash64(slice(w, q.i, {m}))), h -> {_in(known_windows, 'h', longs)}))"
        found.append(f"if(size(w) < {m}, array(), {windows})")
    return F.expr(f"flatten(array({', '.join(found)}))")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    screen_longs: int = SCREEN_LONGS,
) -> DataFrame:
    """(id, h, n_words, n_hit, items, spans) for every row: h is the text's hash, n_hit the words inside any
    occurrence of a benchmark window, items the sorted ids of the items with an occurring window, spans the occurrences as
    (first word, words). Texts and items without words have no hits; null texts have no words; null ids are kept.

    The benchmark's grams and windows are two sets of hashes, each a broadcast array of bits of one size; a larger benchmark
    only lets more false candidates through (`screen_longs` is a power of two). The candidate windows of all texts are then
    joined with the benchmark's by content, which decides; a row's own number keys its hits, so no text's rows gather, and
    the rows of a window that very many texts hold stay where they are. An empty table of either kind gives no hits.
    """
    windows = checkpointed(benchmark_windows(benchmark, item_col, item_text_col, window))
    key, h = F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("h")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most `window` numbers
    if not lengths:
        none = F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<i:int,m:int>>").alias("spans")
        return docs.select(key, h, F.size(words(F.col(text_col))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *none)
    split = windows.select(F.split("win", " ").alias("v"))
    g = F.floor((F.size("v") + 1) / 2).cast("int")
    grams = F.transform(F.sequence(F.lit(1), F.size("v") - g + 1), lambda i: F.xxhash64(F.slice("v", i, g)))
    known_grams = _screen(split.select(F.explode(grams).alias("h")), screen_longs)
    known_windows = _screen(split.select(F.xxhash64("v").alias("h")), screen_longs)
    trimmed = docs.select(key, h, _trimmed(F.col(text_col)).alias("t"))
    scanned = trimmed.select("id", "h", _split(F.col("t")).alias("w"))
    places = scanned.select("id", "h", F.size("w").cast("long").alias("n_words"), "w", _places(lengths, known_grams, known_windows, screen_longs).alias("p"))
    found = places.select("id", "h", "n_words", F.expr("transform(p, q -> struct(q.i AS i, q.m AS m, array_join(slice(w, q.i, q.m), ' ') AS win))").alias("p"))
    kept = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    # a window that very many texts hold, or very many items, is one row a text: its rows stay where they are, its items are one list
    places_found = kept.select("row", F.inline("p"))
    held = places_found.groupBy("m", "win").agg(F.count("*").alias("n"))
    items_of = checkpointed(windows.groupBy("m", "win").agg(F.collect_set("item").alias("members")).join(held, ["m", "win"]))
    hits = spread_join(places_found, items_of, ["m", "win"])
    # the covered words of a text: its places in order, each adding what the ones before it left uncovered
    covered = F.expr(
        "aggregate(spans, struct(0 AS upto, 0L AS total), (a, s) -> struct(greatest(a.upto, s.i + s.m - 1) AS upto, "
        "a.total + greatest(0, s.i + s.m - 1 - greatest(a.upto, s.i - 1)) AS total), a -> a.total)"
    )
    of_row = (
        hits.groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("i", "m"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("members")))).alias("items"))
        .select("row", "items", "spans", covered.alias("n_hit"))
    )
    return kept.select("row", "id", "h", "n_words").join(of_row, "row", "left").select(
        "id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<i:int,m:int>>")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "documents") -> DataFrame:
    """`docs` without contaminated rows (mode "documents"), or with the words of each occurrence removed (mode "spans": such
    a text becomes its remaining words, lower-cased, joined by one space). Clean rows are unchanged, repeated rows included."""
    text, h = F.col(text_col), F.xxhash64(F.col(text_col), F.length(F.col(text_col)))
    hits = find_hits(docs, benchmark, id_col, text_col).filter("n_hit > 0").select(F.col("id").alias("hit_id"), F.col("h").alias("hit_h"), "spans").dropDuplicates(["hit_id", "hit_h"])
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h"))
    if mode == "documents":
        return docs.select(nested(docs), F.col(id_col).alias("id"), h.alias("h")).join(hits, same, "left_anti").select("doc.*")
    if mode != "spans":
        raise ValueError(f"no such mode: {mode}")
    joined = docs.select(nested(docs), F.col(id_col).alias("id"), h.alias("h"), text.alias("text")).join(hits, same, "left").withColumn("w", F.when(F.col("spans").isNotNull(), words(F.col("text"))))
    rest = F.expr("array_join(transform(filter(transform(w, (x, k) -> struct(x AS x, k + 1 AS k)), t -> not exists(spans, s -> t.k between s.i and s.i + s.m - 1)), t -> t.x), ' ')")
    kept = F.when(F.col("spans").isNotNull(), rest).otherwise(F.col("text")).alias(text_col)
    return joined.select(*[kept if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
