"""Merkle manifest of a dataset: digests of rows built bottom-up to one root, proofs pushed top-down to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelake.llm.common import checkpointed, stored

#: Nodes of a run, which become one node of the level above.
ARITY = 2
#: Levels that one stored table holds: its rows are blocks of ARITY ** LEVELS consecutive nodes with the levels above them.
LEVELS = 4
#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value; so no two rows give one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    """The leaf of a row: the digest of its fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`rows` sorted by ranges and stored, with `part` and `at`, the place in the part; and the runs (part, group, n, shift):
    at + shift is a row's place (from 0) in its group. Runs are as many as parts and groups together, whatever the rows,
    so a group of any size is ranked by all tasks."""
    keys = [*group, *order]
    sorted_rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("place", _PLACE_BITS).alias("part"), F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1).alias("at")
    placed = sorted_rows.select(*rows.columns, part, at)
    runs = placed.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, runs.select("part", *group, "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))


def _above(nodes: Column, arity: int) -> Column:
    """The level above an array of nodes: every `arity` consecutive ones, or what the last run has, become their digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, arity), ""), 256))


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, size, pos, digest) of a level's nodes to the same of the level `levels` above, with the block's nodes and the
    levels between in `inner`. `size` counts the nodes of the tree's level; the tree ends where one is left."""
    span = arity**levels
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / span).alias("pos")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
    height = sum((F.when(F.col("size") > arity**j, 1).otherwise(0) for j in range(levels)), F.lit(0))
    own = F.array(F.col("own.digest"))
    climbed = F.when(height == 0, own).otherwise(F.aggregate(F.sequence(F.lit(1), height), own, lambda acc, _: F.concat(acc, F.array(_above(F.element_at(acc, -1), arity)))))
    inner = grouped.select("tree", "pos", F.ceil(F.col("size") / span).alias("size"), climbed.alias("inner"))
    return inner.withColumn("digest", F.element_at(F.element_at("inner", -1), 1))


def build(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The stored tables of blocks above the nodes (tree, size, pos, digest), lowest first; each row of the last is the root
    of a tree (pos 0). A block gathers arity ** levels nodes and no more, whatever the size of its tree."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tables: list[DataFrame] = []
    while not tables or largest > 1:
        nodes = stored(_blocks(nodes.select("tree", "size", "pos", "digest"), arity, levels), "merkle-level")
        tables.append(nodes)
        largest = -(-largest // arity**levels)
    return tables


def _steps(inner: Column, place: Column, arity: int) -> Column:
    """The siblings of the node at `place` of a block, one step a level: the digests before and after it in its run."""

    def step(nodes: Column, j: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(arity), j)).cast("int")
        first = (F.floor(at / arity) * arity).cast("int")
        before, after = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, arity - 1 - (at - first))
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(F.slice(inner, F.lit(1), F.size(inner) - 1), step)


_NO_PROOF = "array<struct<before:string,after:string>>"


def push(tables: list[DataFrame], suffixes: DataFrame | None, leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """`leaves` (tree, pos and others) with `proof` and `subroot`. From the last table down, children join their block: each
    puts its siblings there before the proof that the block inherited. `suffixes` (tree, proof) has what lies above the trees; None: nothing."""
    span = arity**levels
    top = tables[-1].select("tree", "pos", "inner", F.col("digest").alias("subroot"))
    top = top.withColumn("proof", F.array().cast(_NO_PROOF)) if suffixes is None else top.join(suffixes, "tree")
    for children in [*reversed([t.select("tree", "pos", "inner") for t in tables[:-1]]), leaves]:
        above = top.select("tree", F.col("pos").alias("block"), F.col("inner").alias("around"), F.col("proof").alias("suffix"), "subroot")
        joined = children.withColumn("block", F.floor(F.col("pos") / span)).join(above, ["tree", "block"])
        place = (F.col("pos") - F.col("block") * span).cast("int")
        top = joined.select(*children.columns, F.concat(_steps(F.col("around"), place, arity), F.col("suffix")).alias("proof"), "subroot")
    return top


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", carried: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(id, carried, leaf, subroot, root, proof) for every row, repeated rows included.

    leaf: digest of the row's `fields`, nulls told from empty texts. The leaves of each group, by id (null first, rows of one
    id by leaf), are a tree whose root is subroot; the subroots by group (null, a group of its own, first) are a tree with
    root `root`. proof: for each level from the leaf to `root` the digests before and after the node in its run, empty where
    it stands alone. `carried` is any further column of the row to keep. Digests are lowercase hex sha256. An empty table
    gives an empty result; other columns are ignored. Only leaves are sorted and joined, never texts; the root and the
    height are all that reaches the driver.
    """
    kept = F.lit(None).cast("string") if carried is None else carried
    digests = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), row_digest([F.col(f) for f in fields]).alias("leaf"), kept.alias("carried"))
    placed, runs = _placed(stored(digests, "merkle-leaves"), ["grp"], ["id", "leaf"], "merkle-sorted")
    runs = checkpointed(runs)
    sizes, of_parts = _placed(runs.groupBy("grp").agg(F.sum("n").alias("size")), [], ["grp"], "merkle-groups")
    groups = checkpointed(sizes.join(of_parts.select("part", "shift"), "part").select(F.col("grp").alias("g"), (F.col("at") + F.col("shift")).alias("tree"), "size"))
    # a table whose size Spark knows, so it is broadcast only where it is small
    known = stored(runs.join(groups, F.col("grp").eqNullSafe(F.col("g"))).select(F.col("part").alias("p"), "g", "shift", "tree", "size"), "merkle-runs")
    whole = placed.join(known, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    leaves = stored(whole.select("tree", "size", (F.col("at") + F.col("shift")).alias("pos"), "id", "carried", "leaf"), "merkle-placed")
    trees = build(leaves.select("tree", "size", "pos", F.col("leaf").alias("digest")), arity, levels)
    n_groups = groups.count()
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    crown = build(subroots.withColumn("size", F.lit(n_groups).cast("long")), arity, levels)
    root = crown[-1].select("digest").first()
    suffixes = push(crown, None, subroots.select("tree", "pos"), arity, levels).select(F.col("pos").alias("tree"), "proof")
    found = push(trees, suffixes, leaves.select("tree", "pos", "id", "carried", "leaf"), arity, levels)
    return found.select(F.col("id").alias(id_col), "carried", "leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")
