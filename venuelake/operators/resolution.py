"""Entity resolution: names by shared tokens, sites by domain, chains of successors, conflicts between sources."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and the letters they are without them, by their decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) == 2]
    kept = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def canonical_name(name: Column) -> Column:
    """Lower case, without marks, everything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.translate(name, *_plain_letters())), r"[^a-z0-9]+", " "))


def _grams(name: Column) -> Column:
    """The three-letter strings of a name, or the name itself if it is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substr(name, i, F.lit(3))))


#: Left rows of a key that one share takes, the most shares of a key, and the tasks that pairs are dealt to, whose work is not told
#: by their bytes.
SHARE_ROWS, MOST_SHARES, PAIR_TASKS = 4_000, 64, 128
#: Tokens that have a bit of their own.
COMMON = 64


def _as_set(tokens: Column, numbers: Column) -> Column:
    """A set of tokens for quick overlaps: the bits of common ones, the others, and a sketch of these (a bit of 64 each)."""
    bits = F.aggregate(tokens, F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(F.coalesce(F.try_element_at(numbers, t), F.lit(0).cast("long"))))
    rest = F.filter(tokens, lambda t: ~F.map_contains_key(numbers, t))
    sketch = F.aggregate(rest, F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    return F.struct(bits.alias("bits"), sketch.alias("sketch"), rest.alias("rest"))


def _overlap(a: str, b: str) -> Column:
    """How many tokens two such sets share: their arrays are read only where their sketches meet."""
    apart = F.col(f"{a}.sketch").bitwiseAND(F.col(f"{b}.sketch")) == 0
    return F.bit_count(F.col(f"{a}.bits").bitwiseAND(F.col(f"{b}.bits"))) + F.when(apart, 0).otherwise(F.size(F.array_intersect(f"{a}.rest", f"{b}.rest")))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """(left id, right id, overlap, score) of rows whose canonical names share at least `least` tokens and `share` of the larger
    name's, or one of whose names contains the other as a string.

    Two blockings, each by what is rare: names that share a part of their tokens share one of the rarest of either, and a
    name within another has there that of its three-letter strings which fewest names of the other side have (one of under three
    letters its own). So very common words and letters seldom open pairs, but a name that consists of them meets all that
    hold it, as each is a result. A pair is judged where the join makes it, and kept in one place only: under the rarest token
    that the sides share, or, where tokens do not make it a result, under the letters of the shorter name. So pairs are not
    moved or stored; a frequent key is dealt to several tasks by shares of the left rows. The sides are merged, never broadcast:
    a name is as many rows as it has words or letters, more where shares are many, which no estimate tells. Only tables that
    cannot grow beyond the strings of three letters, or a row a share, are broadcast.
    """
    sides = []
    for d, i, n in ((left, left_id, left_name), (right, right_id, right_name)):
        one = d.select(F.col(i).alias("id"), canonical_name(F.col(n)).alias("name")).filter("name <> ''").distinct()
        sides.append(one.withColumn("t", F.array_distinct(F.split("name", " "))))
    frequent = sides[0].select(F.explode("t").alias("token")).unionByName(sides[1].select(F.explode("t").alias("token"))).groupBy("token").agg(F.count("*").alias("n"))
    # the common tokens' bits, a row in all
    common = frequent.orderBy(F.desc("n"), "token").limit(COMMON).agg(F.sort_array(F.collect_list("token")).alias("c"))
    numbers = common.select(F.map_from_arrays("c", F.transform("c", lambda t, i: F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("numbers"))
    l, r = (d.crossJoin(F.broadcast(numbers)).withColumn("s", _as_set(F.col("t"), F.col("numbers"))).withColumn("size", F.size("t")) for d in sides)

    def met(of_left: DataFrame, of_right: DataFrame) -> DataFrame:
        """Left and right rows of one key, the left ones of a frequent key in shares."""
        kept = of_left.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SHARE_ROWS)
        shares = F.least(F.lit(MOST_SHARES), F.ceil(F.coalesce("n", F.lit(1)) / SHARE_ROWS)).cast("int")
        lefts = of_left.join(F.broadcast(kept), "key", "left").withColumn("share", F.pmod(F.xxhash64("lid"), shares).cast("int")).drop("n")
        rights = of_right.join(F.broadcast(kept), "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
        lefts, rights = (d.repartition(PAIR_TASKS, "key", "share") for d in (lefts, rights))
        return lefts.join(rights.hint("merge"), ["key", "share"])

    name = lambda d, side, key, *more: d.select(F.col(key).alias("key"), *(F.col(c).alias(f"{side}{c}") for c in ("id", *more)), F.col("s").alias(f"{side}s"), F.col("size").alias(f"{side}size"))
    overlap = _overlap("ls", "rs")
    score = overlap / F.greatest("lsize", "rsize")
    by_tokens = (overlap >= least) & (score >= share)
    rarest_first = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    needed = F.greatest(F.lit(least), F.ceil(F.size("t") * share - 1e-9))
    tokens = sides[0].select("id", "name", F.size("t").alias("size"), F.explode("t").alias("token")).join(frequent.hint("merge"), "token")
    ranked = tokens.groupBy("id", "name").agg(rarest_first.alias("t")).filter(F.size("t") >= needed).crossJoin(F.broadcast(numbers)).withColumn("s", _as_set(F.col("t"), F.col("numbers"))).withColumn("size", F.size("t"))
    prefix = ranked.select("id", "s", "size", "t", "numbers", F.posexplode(F.slice("t", F.lit(1), (F.size("t") - needed + 1).cast("int"))).alias("at", "token"))
    prefix = prefix.withColumn("before", _as_set(F.slice("t", F.lit(1), F.col("at")), F.col("numbers")))  # rarer tokens, under which the pair is kept if shared
    pairs = met(name(prefix, "l", "token", "before"), name(r.withColumn("token", F.explode("t")), "r", "token"))
    pairs = pairs.filter(by_tokens & (_overlap("lbefore", "rs") == 0))
    # the strings of one to three letters that a name has, for those that it contains
    letters = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - w + 1, F.lit(1))), lambda i: F.substr("name", i, w)))))

    def contained(inner: DataFrame, outer: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both by a three-letter string: inner names by that which fewest outer names have, outer ones by all that are one of
        these. Names are of letters, digits and spaces, so there are at most 37 + 37² + 37³ such strings."""
        parts = outer.withColumn("gram", F.explode(letters))
        counted = parts.groupBy("gram").agg(F.count("*").alias("n"))
        grams = inner.select("id", "name", F.explode(_grams(F.col("name"))).alias("gram")).join(F.broadcast(counted), "gram", "left")
        rarest = grams.groupBy("id", "name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent")).filter("absent = 0")
        owned = rarest.crossJoin(F.broadcast(numbers)).withColumn("t", F.array_distinct(F.split("name", " "))).withColumn("s", _as_set(F.col("t"), F.col("numbers"))).withColumn("size", F.size("t"))
        return owned, parts.join(F.broadcast(rarest.select("gram").distinct()), "gram", "left_semi")

    inner, outer = contained(sides[0], r)
    within = met(name(inner, "l", "gram", "name"), name(outer, "r", "gram", "name")).filter(F.contains("rname", "lname") & ~by_tokens)
    inner, outer = contained(sides[1], l)
    around = met(name(outer, "l", "gram", "name"), name(inner, "r", "gram", "name")).filter(F.contains("lname", "rname") & (F.col("lname") != F.col("rname")) & ~by_tokens)
    out = (F.col("lid").alias(f"left_{left_id}"), F.col("rid").alias(f"right_{right_id}"), overlap.alias("overlap"), score.alias("score"))
    return pairs.select(*out).unionByName(within.select(*out)).unionByName(around.select(*out))


def agreed_site(claims: DataFrame, key: str) -> DataFrame:
    """(key, host, agreed): the host of the claim of best priority, and whether all claims name one host."""
    return claims.groupBy(key).agg(F.min_by("host", F.struct("priority", "host")).alias("host"), (F.count_distinct("host") == 1).alias("agreed"))


def conflicts(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys for which sources differ, with how many values there are."""
    return values.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def successors(moves: DataFrame, most: int = 5) -> DataFrame:
    """(start, last, hops, state) along moves (place, successor), at most `most` ids a chain: ENDED, CYCLE or LIMIT."""
    step = moves.select("place", "successor").dropDuplicates(["place"])
    chain = step.select(F.col("place").alias("start"), F.array("place", "successor").alias("ids"))
    for _ in range(most - 1):
        last = F.element_at("ids", -1)
        seen = F.array_contains(F.slice("ids", 1, F.size("ids") - 1), last)
        grown = chain.join(step, (last == step.place) & ~seen & (F.size("ids") <= most), "left")
        chain = grown.select("start", F.when(F.col("successor").isNotNull(), F.array_append("ids", F.col("successor"))).otherwise(F.col("ids")).alias("ids"))
    last = F.element_at("ids", -1)
    cycle = F.array_contains(F.slice("ids", 1, F.size("ids") - 1), last)
    state = F.when(cycle, "CYCLE").when(F.size("ids") > most, "LIMIT").otherwise("ENDED")
    return chain.select("start", last.alias("last"), (F.size("ids") - 1).alias("hops"), state.alias("state"))
