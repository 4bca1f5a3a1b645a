"""Near-duplicate grouping by SimHash: segment-popcount embedding, grid range-join, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import checkpointed, content_hash, nested, small_batches, spread_join, stored
from venuelake.llm.components import components

#: Links join fingerprints at this many differing bits or fewer.
MAX_DISTANCE = 3
#: The 64 bits in six groups of two-bit segments. Three differing bits leave at least three groups alike.
GROUP_BITS = (10, 12, 10, 10, 12, 10)
#: Cells with more fingerprints than this are linked through their neighbourhoods, at a cost linear in their size.
CELL_PAIRS = 512
_CHUNK = 1 << 16


def fingerprint_bytes(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed integer: see `fingerprint`."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        part = words[start : min(n, start + _CHUNK) + words_per_shingle - 1]
        if len(words) < words_per_shingle:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words_per_shingle)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_bytes(t) for t in texts.to_pylist()], pa.int64())


def fingerprint(text: Column) -> Column:
    """A bit is 1 if set in over half of the XXH64 hashes (seed 42) of the text's three-word shingles, repeats included.
    Fewer words make one shingle; null, empty and blank texts have fingerprint zero."""
    return F.arrow_udf(_fingerprints, "long")(text.cast("binary"))


def _popcounts(fp: Column) -> Column:
    """The embedding: 32 two-bit fields, each the number of ones of its segment. |difference| summed over the fields is
    at most the number of differing bits."""
    low = F.lit(0x5555555555555555)
    x, y = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))


def _cells(points: DataFrame) -> DataFrame:
    """Each point in 20 grid cells, one for each choice of three groups. Within Manhattan distance 3, at least three of the
    six groups have distance 0, so two such points share a cell."""
    starts = [sum(GROUP_BITS[:i]) for i in range(len(GROUP_BITS))]
    masks = [((1 << width) - 1) << start for start, width in zip(starts, GROUP_BITS, strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keep = len(GROUP_BITS) - MAX_DISTANCE
    cells = [
        F.struct(F.lit(i).cast("byte").alias("c"), F.col("e").bitwiseAND(F.lit(signed(sum(masks[g] for g in groups)))).alias("k"))
        for i, groups in enumerate(combinations(range(len(GROUP_BITS)), keep))
    ]
    return points.withColumn("e", _popcounts(F.col("fp"))).select("fp", "e", F.inline(F.array(*cells)))


def _neighbours(fps: DataFrame) -> DataFrame:
    """Links among the fingerprints of crowded cells without pairing them: each goes to all values within one bit and
    within two. Those within one bit of a value link to its least such member, and so do those at two bits: distance 1 + 2
    is at most 3, and every pair at distance 3 or less meets at such a value."""
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    zero = F.array(F.lit(0).cast("long"))
    with_zero = F.concat(zero, bits)
    once = fps.select("fp", F.explode(with_zero).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"))
    pairs = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    twice = fps.select("fp", F.explode(F.concat(zero, bits, pairs)).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"))
    centre = once.groupBy("v").agg(F.min("fp").alias("b"))
    return twice.join(centre, "v").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`, such that their components are those of all links.

    The grid range-join pairs points of a cell, drops those whose Manhattan distance exceeds 3 and verifies the rest on the
    fingerprints themselves.
    """
    cells = _cells(fps)
    crowded = checkpointed(cells.groupBy("c", "k").count().filter(F.col("count") > cell_pairs).select("c", "k"))
    some = len(crowded.take(1)) > 0
    sparse = cells.join(crowded, ["c", "k"], "left_anti") if some else cells
    left, right = sparse.select("c", "k", F.col("fp").alias("a"), F.col("e").alias("ea")), sparse.select("c", "k", F.col("fp").alias("b"), F.col("e").alias("eb"))
    # per two-bit field, |x - y| = max - min; fields never borrow as each maximum is at least its minimum
    manhattan = sum((F.abs(F.shiftrightunsigned("ea", 2 * i).bitwiseAND(F.lit(3)) - F.shiftrightunsigned("eb", 2 * i).bitwiseAND(F.lit(3))) for i in range(32)), F.lit(0))
    near = F.when(manhattan <= MAX_DISTANCE, F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    found = left.join(right, ["c", "k"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    if some:
        found = found.union(_neighbours(cells.join(crowded, ["c", "k"], "left_semi").select("fp").distinct()))
    return found.distinct()


def _grouped(points: DataFrame, cell_pairs: int) -> DataFrame:
    """`points`, of distinct fingerprints `fp`, with the `component` of each: its least fingerprint, never null."""
    groups = components(links(points.select("fp"), cell_pairs))
    return points.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`, repeated rows included.

    component_id is the smallest id reachable over links of at most 3 differing bits, the row's own included. Equal
    fingerprints are one point of the search, so copies are never paired. Null ids take part; a component of null ids only
    has a null component_id. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    points = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    named = _grouped(points, cell_pairs)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = checkpointed(named.join(least, "component").select("fp", "component_id", "n"))
    return spread_join(marked, resolved, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest id, null last. Rows are judged each by its own
    text, so rows that share an id, null included, may belong to different groups; of those with the smallest id of their
    group one stays, the same on reruns."""
    small_batches(docs.sparkSession)
    # a place is a row's own only once the rows are written
    rows = stored(docs.select(nested(docs), F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"), content_hash(docs).alias("hash"), F.monotonically_increasing_id().alias("row")), "fingerprinted")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "row")
    points = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("first")))
    kept = _grouped(points, cell_pairs).groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    return rows.select("doc", "row").join(kept, "row", "left_semi").select("doc.*")
