"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.llm.common import checkpointed, content_hash, nested, stored

#: No document is taken more often than this.
MAX_COPIES = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of one rounding group at most, so that ranking its rows stays a small task.
GROUP_ROWS = 50_000
#: So many rounds take Newton's steps; those after them halve the bracket, which ends within 51.
_NEWTON_ROUNDS = 20
_ROUNDS = 75
_TOLERANCE = 1e-7
_FIX_ROUNDS = 6


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight) to the same with `target`: shares of the whole by weight, at most MAX_COPIES times the
    source's own size, the excess dealt out again by weight until no target is above its bound.

    Filled by the order of source_size / weight: with the sources of the least ratio at their bound, the rest share what
    remains by weight, which is a running sum instead of repeated rounds.
    """
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(filled), F.lit(0)) * MAX_COPIES)
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    )
    # what a unit of weight gets if this source and those after it are below their bounds
    level = (F.col("total") - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    opened = ranked.withColumn("level", level).withColumn("open", F.col("level") <= MAX_COPIES * F.col("ratio"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("weight") * F.coalesce(first, F.lit(float("inf"))), MAX_COPIES * F.col("source_size").cast("double"))
    return opened.select("source", "source_size", "weight", target.cast("double").alias("target"))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): one row a source, in code point order with null last. This window is over sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", cycle)


def _solve(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, scale, tilt): rates exp(tilt * size / scale), at most MAX_COPIES, whose words sum to the target.

    The convex dual of the entropy problem has one unknown a source. Each Newton round is one grouped sum over the size
    histogram for all sources at once; a bracket holds each step, and halves where Newton leaves it.
    """
    scale = groups.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"))
    state = (
        targets.join(scale, targets.source.eqNullSafe(scale.source)).drop(scale.source)
        .select("source", "target", "source_size", F.greatest("scale", F.lit(1e-9)).alias("scale"), F.lit(0.0).alias("tilt"), F.lit(-800.0).alias("low"), F.lit(800.0).alias("high"), F.lit(False).alias("done"))
    )
    state = checkpointed(state)
    for k in range(_ROUNDS):
        g, s = groups.alias("g"), state.alias("s")
        x = F.col("g.size") / F.col("s.scale")
        rate = F.exp(F.least(F.col("s.tilt") * x, F.lit(700.0)))
        words = F.col("g.n") * F.col("g.size")
        sums = (
            g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("key"))
            .agg(
                F.sum(words * F.least(rate, F.lit(float(MAX_COPIES)))).alias("value"),
                F.sum(F.when(rate < MAX_COPIES, words * rate * x).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("value") - F.col("target")
        done = (F.abs(gap) <= _TOLERANCE * F.greatest("target", F.lit(1.0))) | (F.col("target") >= MAX_COPIES * F.col("source_size")) | (F.col("high") - F.col("low") < 1e-12)
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when((F.col("slope") > 0) & F.lit(k < _NEWTON_ROUNDS), F.col("tilt") - gap / F.col("slope"))
        state = checkpointed(
            state.join(sums, state.source.eqNullSafe(sums.key))
            .select("source", "target", "source_size", "scale", "tilt", low.alias("low"), high.alias("high"), done.alias("done"), step.alias("step"))
            .select(
                "source", "target", "source_size", "scale",
                F.when(F.col("done"), F.col("tilt")).when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
                "low", "high", "done",
            )
        )
        if state.filter(~F.col("done")).limit(1).count() == 0:
            return state
    raise RuntimeError(f"rates did not settle in {_ROUNDS} rounds")


def _round(groups: DataFrame, state: DataFrame) -> DataFrame:
    """(source, size, bucket, n, copies): whole copies of each group, from the rates of its rows.

    Systematic rounding in size order carries each group's fraction to the next, so a source misses its target by at most
    about one document; a few rounds of moving one copy of the best-fitting size take up what is left. Groups are
    histogram entries, so these windows are over distinct sizes, not rows.
    """
    g, s = groups.alias("g"), state.alias("s")
    full = F.col("s.target") >= MAX_COPIES * F.col("s.source_size")
    rate = F.when(full, F.lit(float(MAX_COPIES))).otherwise(F.least(F.exp(F.least(F.col("s.tilt") * F.col("g.size") / F.col("s.scale"), F.lit(700.0))), F.lit(float(MAX_COPIES))))
    rated = g.join(s, F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "g.size", "g.bucket", "g.n", "s.target", (rate * F.col("g.n")).alias("want"))
    before = Window.partitionBy("source").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("want").over(before), F.lit(0.0))
    whole = F.floor(start + F.col("want") + 0.5) - F.floor(start + 0.5)
    out = checkpointed(
        rated.withColumn("copies", F.greatest(F.lit(0), F.least(whole, F.col("n") * MAX_COPIES)).cast("long"))
        .select("source", "size", "bucket", "n", "target", "copies")
    )
    for _ in range(_FIX_ROUNDS):
        taken = out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        t, o = taken.alias("t"), out.alias("o")
        gap, size = F.col("t.gap"), F.col("o.size")
        can = (size > 0) & F.when(gap > 0, F.col("o.copies") < F.col("o.n") * MAX_COPIES).otherwise(F.col("o.copies") > 0)
        left = F.abs(F.abs(gap) - size)
        moves = (
            o.join(t, F.col("o.source").eqNullSafe(F.col("t.source")))
            .filter(can & (left < F.abs(gap)))
            .groupBy(F.col("o.source").alias("m_source"))
            .agg(F.min(F.struct(left.alias("left"), size.alias("size"), F.col("o.bucket").alias("bucket"), F.signum(gap).cast("long").alias("sign"))).alias("m"))
            .select("m_source", F.col("m.size").alias("m_size"), F.col("m.bucket").alias("m_bucket"), "m.sign")
        )
        moves = checkpointed(moves)
        if moves.limit(1).count() == 0:
            break
        same = out.source.eqNullSafe(F.col("m_source")) & (out["size"] == F.col("m_size")) & (out["bucket"] == F.col("m_bucket"))
        out = checkpointed(out.join(moves, same, "left").select("source", "size", "bucket", "n", "target", (F.col("copies") + F.coalesce("sign", F.lit(0))).alias("copies")))
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row, repeated rows included.

    size: words of the text; target: of the row's source, in words; copies: 0 to 3; taken: copies times size. Rows of one
    source and size have one rate; which of them get the extra copy is decided by a hash of their id, so reruns agree. A
    null source is a source of its own, last in order. Texts without words are taken as often as their rate says and add
    nothing; sources without words have target 0. An empty table gives an empty result.
    """
    rows = checkpointed(docs.select(*_facts(id_col, text_col, source_col)))
    return _dealt(rows, weights, group_rows).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _facts(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col)).alias("h")]


def _dealt(rows: DataFrame, weights: tuple[int, ...], group_rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows (id, source, size, h and others) with `source_size`, `target` and `copies`; `ties` order rows of one id."""
    totals = rows.groupBy("source", "size").agg(F.count("*").alias("m")).filter(F.col("m") > group_rows)
    crowded = checkpointed(totals.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.ceil(F.col("m") / (group_rows / 2)).alias("parts")))
    if crowded.limit(1).count():
        rows = rows.join(crowded, rows.source.eqNullSafe(crowded.c_source) & (rows["size"] == crowded.c_size), "left").drop("c_source", "c_size")
        rows = rows.withColumn("bucket", F.coalesce(F.pmod("h", "parts"), F.lit(0)).cast("long")).drop("parts")
    else:
        rows = rows.withColumn("bucket", F.lit(0).cast("long"))
    groups = checkpointed(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    sources = weighted_sources(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights)
    targets = checkpointed(source_targets(sources))
    state = _solve(groups, targets.select("source", "source_size", "target"))
    rounded = _round(groups, state).select(F.col("source").alias("r_source"), F.col("size").alias("r_size"), F.col("bucket").alias("r_bucket"), "n", F.col("copies").alias("total"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "id", *ties)) - 1)
    joined = ranked.join(rounded, ranked.source.eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")) & (F.col("bucket") == F.col("r_bucket")))
    joined = joined.join(t, joined.source.eqNullSafe(F.col("t_source")))
    copies = (F.expr("total div n") + F.when(F.col("k") < F.expr("total % n"), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = GROUP_ROWS) -> DataFrame:
    """`docs` with each row as often as the mix takes it. Copies are dealt to rows, not ids: rows that share an id, null
    included, may differ in text and source. Among rows of one id, source and size a hash of their columns decides."""
    # a place is a row's own only once the rows are written
    facts = F.struct(*_facts(id_col, text_col, source_col), content_hash(docs).alias("content"))
    marked = stored(docs.select(nested(docs), facts.alias("facts"), F.monotonically_increasing_id().alias("row")), "marked")
    rows = checkpointed(marked.select("facts.*", "row"))
    dealt = _dealt(rows, weights, group_rows, ("content", "row")).filter("copies > 0").select("row", F.col("copies").cast("int"))
    taken = marked.select("doc", "row").join(dealt, "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
