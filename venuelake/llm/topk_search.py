"""Exact top-k search by inner product: paged M-trees searched best-first under stored triangle-inequality bounds."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelake.llm.common import checkpointed

#: Vectors become floor(SCALE * x).
SCALE = 256
#: Results of a query.
TOP = 5
#: Vectors of one tree, of one leaf page, and children of an inner node; trees that one task builds and searches in turn.
TREE_ROWS, PAGE_ROWS, FAN_OUT, TASK_TREES = 4096, 128, 12, 16
#: Distinct query vectors broadcast at once; more are searched block by block.
QUERY_BLOCK = 16_384
#: Vectors sampled as pivots, by which near vectors are put into one tree. Every vector is indexed.
PIVOTS = 128
#: Slack of a bound against rounding, in parts.
_SLACK = 1e-9
#: Bits of a row's place in its tree, under the score in a sort key; scores beyond the rest take the slow exact way.
_ROW_BITS = 13
_LARGEST = float(2 ** (62 - _ROW_BITS))


class _Node:
    """A page. pivot: its routing vector; to_parent: the pivot's distance to the parent's; radius: covers every vector below.
    A leaf holds `rows` and their distances to the pivot; an inner node holds the numbers of its children."""

    __slots__ = ("pivot", "radius", "to_parent", "children", "rows", "distances")

    def __init__(self, pivot: np.ndarray):
        self.pivot, self.radius, self.to_parent = pivot, 0.0, 0.0
        self.children: list[int] = []
        self.rows = self.distances = None


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def _grow(points: np.ndarray, rows: np.ndarray, nodes: list[_Node]) -> int:
    """Bulk load: pivots by farthest-first choice, every vector to its nearest; equal vectors fill leaves of any size."""
    own = points[rows]
    pivot = own[_distances(own, own.mean(axis=0)).argmin()]
    node = _Node(pivot)
    number = len(nodes)
    nodes.append(node)
    to_pivot = _distances(own, pivot)
    node.radius = float(to_pivot.max())
    if len(rows) <= PAGE_ROWS or node.radius == 0:
        node.rows, node.distances = rows, to_pivot
        return number
    at, nearest, best = int(to_pivot.argmax()), np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for k in range(FAN_OUT):
        d = _distances(own, own[at])
        nearest[d < best] = k
        best = np.minimum(best, d)
        if not best.max():
            break
        at = int(best.argmax())
    for k in np.unique(nearest):
        child = _grow(points, rows[nearest == k], nodes)
        nodes[child].to_parent = float(_distances(nodes[child].pivot[None], pivot)[0])
        node.children.append(child)
    return number


class MTree:
    """Integer vectors under the Euclidean metric, each lengthened by one component to a common norm, so that a larger inner
    product with a query is a smaller distance to it. copies: how many equal rows each vector stands for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        if len(ids) > 1 << _ROW_BITS:
            raise ValueError("too many vectors for a tree")
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        squares = (self.vectors**2).sum(axis=1)
        self.norm2, self.largest = float(squares.max(initial=0.0)), float(np.abs(self.vectors).max(initial=0.0))
        points = np.hstack([self.vectors, np.sqrt(np.maximum(self.norm2 - squares, 0.0))[:, None]])
        self.nodes: list[_Node] = []
        if len(ids):
            _grow(points, np.arange(len(ids)), self.nodes)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, score) of the k best vectors of each query, ties to the smaller id."""
        which, rows, scores = self.find(queries, k)
        return which, self.ids[rows], scores

    def find(self, queries: np.ndarray, k: int, own: np.ma.MaskedArray | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, vector's row, score) of the k best vectors of each query, ties to the smaller id. Vectors with the
        id that `own` has for a query are passed over, and so may be those that score less than the query's `floor`.

        Each query goes best page first: it opens the page of its frontier with the least bound, until that lies beyond the
        distance of its k-th result. Queries that open the same page do so together. Pages and vectors are left out without
        a computation where the distance to the parent, stored with them, shows that they lie beyond.
        """
        m = len(queries)
        if not m or not self.nodes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.largest * float(np.abs(queries).max(initial=0.0)) * max(queries.shape[1], 1) >= _LARGEST:
            return self._exact(queries, k, own)
        q2 = (queries**2).sum(axis=1)
        none = np.iinfo(np.int64).min
        best, reach = np.full((m, k), none), np.full(m, np.inf)

        def reaching(asked: np.ndarray, score: np.ndarray) -> np.ndarray:
            # the slack outweighs the rounding of distances; it may open a page too many, never one too few
            return np.sqrt(np.maximum(q2[asked] + self.norm2 - 2.0 * score, 0.0) + _SLACK * (q2[asked] + self.norm2 + 1.0)) + 1e-3

        if floor is not None:
            known = np.flatnonzero(floor != none)
            reach[known] = reaching(known, floor[known].astype(np.float64))

        def distances(asked: np.ndarray, pivots: np.ndarray) -> np.ndarray:
            squares = q2[asked][:, None] + (pivots**2).sum(axis=1) - 2.0 * (queries[asked] @ pivots[:, :-1].T)
            return np.sqrt(np.maximum(squares, 0.0))

        every = np.arange(m)
        bound, to_pivot = np.full((m, len(self.nodes)), np.inf), np.zeros((m, len(self.nodes)))
        to_pivot[:, 0] = distances(every, self.nodes[0].pivot[None])[:, 0]
        bound[:, 0] = np.maximum(to_pivot[:, 0] - self.nodes[0].radius, 0.0)
        active = every
        while len(active):
            page = bound[active].argmin(axis=1)
            low = bound[active, page]
            go = np.isfinite(low) & (low <= reach[active])
            active, page = active[go], page[go]
            bound[active, page] = np.inf
            order = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.diff(page[order])) + 1
            for asked in np.split(active[order], cuts) if len(active) else ():
                number = int(page[np.searchsorted(active, asked[0])])
                node = self.nodes[number]
                if node.rows is None:
                    children = [self.nodes[c] for c in node.children]
                    apart, radius = np.array([c.to_parent for c in children]), np.array([c.radius for c in children])
                    near = np.abs(to_pivot[asked, number][:, None] - apart) - radius <= reach[asked][:, None]
                    some = near.any(axis=0)
                    numbers, near, radius = np.array(node.children)[some], near[:, some], radius[some]
                    if len(numbers):
                        d = distances(asked, np.stack([self.nodes[c].pivot for c in numbers]))
                        to_pivot[asked[:, None], numbers] = d
                        bound[asked[:, None], numbers] = np.where(near, np.maximum(d - radius, 0.0), np.inf)
                    continue
                near = (np.abs(node.distances - to_pivot[asked, number][:, None]) <= reach[asked][:, None]).any(axis=0)
                rows = node.rows[near]
                if not len(rows):
                    continue
                scores = (queries[asked] @ self.vectors[rows].T).astype(np.int64)
                keys = (scores << _ROW_BITS) + ((1 << _ROW_BITS) - 1 - rows)
                if own is not None:
                    keys[(self.ids[rows] == own.data[asked][:, None]) & ~np.ma.getmaskarray(own)[asked][:, None]] = none
                keys = np.concatenate([best[asked], keys], axis=1)
                best[asked] = np.partition(keys, -k, axis=1)[:, -k:]
                least = best[asked].min(axis=1)
                reach[asked] = np.minimum(reach[asked], np.where(least == none, np.inf, reaching(asked, least >> _ROW_BITS)))
        which, column = np.nonzero(best != none)
        found = best[which, column]
        return which, (1 << _ROW_BITS) - 1 - (found & ((1 << _ROW_BITS) - 1)), found >> _ROW_BITS

    def _exact(self, queries: np.ndarray, k: int, own: np.ma.MaskedArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For components so large that sums leave what a double holds: whole numbers of any size, held to a long at the end."""
        out: list[tuple[int, int, int]] = []
        held = [[int(x) for x in v] for v in self.vectors]
        for q, query in enumerate(queries):
            numbers = [int(x) for x in query]
            skipped = None if own is None or own[q] is np.ma.masked else int(own[q])
            # rows stand in the order of their ids
            scored = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, numbers, strict=True)))), r) for r, v in enumerate(held) if int(self.ids[r]) != skipped)
            out += [(q, r, s) for s, r in sorted(scored, key=lambda e: (-e[0], e[1]))[:k]]
        return tuple(np.array([o[c] for o in out], np.int64) for c in range(3))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, n): v is floor(256 * x) of each component. Rows without id, null vectors and those that hold a null or
    non-finite component are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~broken)
    # adding 0.0 makes -0.0 and 0.0 one value
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double") + F.lit(0.0)).alias("v"), F.size(vector_col).alias("n"))


def _trees(points: DataFrame, n_rows: int) -> DataFrame:
    """One row a tree: (part, n, tree), part being the task that holds it. Near vectors meet in a tree: rows are dealt by their nearest of a few sampled pivots; a
    crowded pivot spreads over several trees by a hash."""
    sample = points.orderBy(F.xxhash64("v", "id"), "id").limit(PIVOTS).select("n", "v").toPandas()
    by_n = {int(n): np.stack(g["v"].to_list()) for n, g in sample.groupby("n")}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            widths = batch.column("n").to_numpy()
            for n in np.unique(widths):
                if n and int(n) in by_n:
                    own = np.flatnonzero(widths == n)
                    x, p = _matrix(batch.column("v").take(pa.array(own))), by_n[int(n)]
                    at[own] = ((p * p).sum(axis=1) - 2.0 * (x @ p.T)).argmin(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(at)], names=[*batch.schema.names, "pivot"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        widths = table.column("n").to_numpy()
        pivots = table.column("pivot").to_numpy()
        for n in np.unique(widths):
            own = np.flatnonzero(widths == n)
            own = own[np.argsort(pivots[own], kind="stable")]
            for start in range(0, len(own), TREE_ROWS):
                part = table.take(pa.array(own[start : start + TREE_ROWS]))
                vectors = _matrix(part.column("v")) if n else np.zeros((part.num_rows, 0))
                tree = MTree(part.column("id").to_numpy(), vectors, part.column("copies").to_numpy())
                columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([int(n)], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())]
                yield pa.record_batch(columns, names=["part", "n", "tree"])

    dealt = points.mapInArrow(nearest, "id long, v array<double>, n int, copies long, pivot long")
    # a tree a task until every core has one, then up to TASK_TREES of them
    n_trees = max(1, -(-n_rows // TREE_ROWS))
    tasks = max(-(-n_trees // TASK_TREES), min(n_trees, points.sparkSession.sparkContext.defaultParallelism))
    return dealt.repartitionByRange(tasks, "n", "pivot", F.xxhash64("v", "id")).mapInArrow(build, "part int, n int, tree binary")


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _merged(parts: list[Found], k: int) -> Found:
    """(query, id, score, copies) of the k best of each query."""
    which, ids, scores, copies = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, ~scores, which))  # ~x falls as x rises, without overflow
    which = which[order]
    first = np.searchsorted(which, which)
    kept = order[np.arange(len(which)) - first < k]
    return tuple(c[kept] for c in (np.concatenate([p[0] for p in parts]), ids, scores, copies))


def _searched(trees: DataFrame, asking: dict, k: int) -> DataFrame:
    """(q, id, score, copies): the k best vectors of each task's trees for the queries `asking`, n -> (q, vectors, own ids,
    floors). A task's trees raise the floors for one another, and what lies below the floor is not returned."""
    none = np.iinfo(np.int64).min

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Found] = {}
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, stored in zip(batch.column("n").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                if n not in sent.value:
                    continue
                tree: MTree = pickle.loads(stored)
                _, vectors, skipped, floor = sent.value[n]
                floor = floors.setdefault(n, floor.copy())
                which, at, scores = tree.find(vectors, k, skipped, floor)
                good = scores >= floor[which]
                parts = [best[n]] if n in best else []
                best[n] = _merged([*parts, (which[good], tree.ids[at[good]], scores[good], tree.copies[at[good]])], k)
                which, _, scores, _ = best[n]
                full = np.flatnonzero(np.bincount(which, minlength=len(floor)) == k)
                floor[full] = np.maximum(floor[full], scores[np.searchsorted(which, full, side="right") - 1])
        for n, (which, ids, scores, copies) in best.items():
            good = scores >= floors[n][which]
            yield pa.record_batch([pa.array(sent.value[n][0][which[good]]), pa.array(ids[good]), pa.array(scores[good]), pa.array(copies[good])], names=["q", "id", "score", "copies"])

    asking = {n: (q, v, own, np.full(len(q), none) if floor is None else floor) for n, (q, v, own, floor) in asking.items()}
    sent = trees.sparkSession.sparkContext.broadcast(asking)
    found = checkpointed(trees.select("n", "tree").mapInArrow(search, "q long, id long, score long, copies long"))
    sent.destroy()
    return found


def _asking(block: DataFrame) -> dict[int, list]:
    """n -> [q, vectors, own ids, no floors] of a block of queries, whose number is bounded."""
    got = block.select("q", "v", "n", "own").toArrow()
    widths = got.column("n").to_numpy()
    asking = {}
    for n in np.unique(widths):
        part = got.take(pa.array(np.flatnonzero(widths == n)))
        own = part.column("own")
        vectors = _matrix(part.column("v")) if n else np.zeros((part.num_rows, 0))
        skipped = np.ma.masked_array(own.fill_null(0).to_numpy(), own.is_null().to_numpy()) if own.null_count < len(own) else None
        asking[int(n)] = [part.column("q").to_numpy(), vectors, skipped, None]
    return asking


def _search_block(trees: DataFrame, tasks: int, asking: dict[int, list], k: int) -> DataFrame:
    """The k best vectors of each task's trees for one block of queries. Some tasks, about the root of all, go first; the
    k-th score that they find is a floor for the others, which then return hardly more than what is above it."""
    stride = max(1, round(tasks**0.5))
    first = _searched(trees.filter(F.col("part") % stride == 0), asking, k)
    if tasks == 1:
        return first
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    known = top.groupBy("q").agg(F.count("*").alias("c"), F.min("score").alias("floor")).filter(F.col("c") == k).select("q", "floor").toArrow()
    floors = dict(zip(known.column("q").to_pylist(), known.column("floor").to_pylist(), strict=True))
    for entry in asking.values():
        entry[3] = np.array([floors.get(q, np.iinfo(np.int64).min) for q in entry[0].tolist()], np.int64)
    return first.unionByName(_searched(trees.filter(F.col("part") % stride != 0), asking, k))


def top_k(rows: DataFrame, every: int = 50, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score) for the rows whose id is divisible by `every`, against every row but the query's own.

    Exact: scores are integer inner products (held to the range of a long), ties go to the smaller id. Vectors are compared
    with those of their own length. Equal rows are one point with a count, given back once the query's own rows are out. Of
    equal vectors only the k + 1 smallest ids are searched, as no others can be returned; equal queries are searched once,
    but an id with several vectors asks by itself, and its own points are passed over in the trees: the answers to all its
    vectors are ranked together. Rows with the query's id never answer it; other repeated rows count each. An empty table,
    or one without usable queries, gives an empty result; other columns are ignored.

    The queries reach the tasks in blocks of `query_block` at most.
    """
    usable = checkpointed(quantised(rows, id_col, vector_col).groupBy("id", "v", "n").agg(F.count("*").alias("copies")))
    ranked = usable.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    asked = usable.filter(F.col("id") % every == 0).select("id", "v", "n")
    several = asked.groupBy("id").count().filter("count > 1").select("id", F.col("id").alias("own"))
    asked = checkpointed(asked.join(several, "id", "left"))
    points = checkpointed(ranked.filter(F.col("r") <= k + 1).drop("r"))
    trees = checkpointed(_trees(points, points.count()))
    tasks = (trees.agg(F.max("part")).first()[0] or 0) + 1
    queries = checkpointed(asked.groupBy("v", "n", "own").agg(F.count("*")).withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-queries.count() // query_block))
    parts = [_search_block(trees, tasks, _asking(queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)), k + 1) for b in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    same = (asked.v == queries.v) & asked.own.eqNullSafe(queries.own)
    named = asked.join(queries, same).select(asked.id.alias("query_id"), "q")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    each = named.join(best, "q").filter("id <> query_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return (
        each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
