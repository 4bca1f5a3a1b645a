import numpy as np
import pytest

from venuelake.llm import topk_search


def brute(rows, every=50, k=5):
    usable = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in usable if i % every == 0}):
        for query in [v for i, v in usable if i == q][:1]:
            scored = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(query))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("block", "tree", "per_task"), [(16384, 4096, 16), (3, 4096, 16), (16384, 40, 2), (5, 25, 1)])
def test_equals_brute_force(spark, monkeypatch, block, tree, per_task):
    monkeypatch.setattr(topk_search, "TREE_ROWS", tree)
    monkeypatch.setattr(topk_search, "TASK_TREES", per_task)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(450)]
    for i in range(0, 450, 9):  # ties: one hot vector
        rows[i] = (i, rows[0][1])
    rows += [(1000, None), (1050, [None] * 6), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (1200, [1.0, 2.0]), (1201, [2.0, -1.0]), (1250, []), (None, [0.0] * 6), (1300, [0.0] * 6), (1301, [-0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS id")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(frame, query_block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_components_and_small_tables(spark):
    rng = np.random.default_rng(4)
    for big in (1.0, 1e7, 1e13):
        v = np.floor(rng.normal(size=(400, 5)) * big)
        tree = topk_search.MTree(rng.permutation(1000)[:400], v)
        which, ids, scores = tree.search(v[:20], 3)
        for q in range(20):
            want = sorted((-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v[q], x, strict=True)))), int(i)) for x, i in zip(tree.vectors, tree.ids, strict=True))[:3]
            assert sorted((-int(s), int(i)) for s, i in zip(scores[which == q], ids[which == q], strict=True)) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("big", [1.0, 1e13])
def test_repeated_rows(spark, big):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) * big for x in rng.normal(size=4)]) for i in range(1, 60) if i != 50]
    hot = [4.0 * big] * 4
    rows += [(50, hot)] * 7 + [(100, hot)] * 2 + [(i, hot) for i in range(101, 104)] + [(33, rows[2][1])] * 3  # own rows fill the top
    rows += [(150, [float(np.float32(x)) * big for x in rng.normal(size=4)]) for _ in range(9)]  # an id with several vectors
    got = [tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    whole = lambda v: [int(np.floor(256.0 * x)) for x in v]
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (50, 100, 150):
        asked = {tuple(whole(v)) for i, v in rows if i == q}
        scored = sorted((-held(sum(a * b for a, b in zip(query, whole(v), strict=True))), i) for query in asked for i, v in rows if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted(got) == sorted(want)
