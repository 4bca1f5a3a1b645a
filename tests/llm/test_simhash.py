import random

import pytest
import xxhash

from venuelake.llm import simhash
from venuelake.llm.components import components

SCHEMA = "doc_id long, text string, fp long, component_id string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """id -> least id reachable over links of at most three differing bits."""
    ids = list(range(len(fps)))
    group = ids[:]
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(25)]
    near = [b.replace("w7", "w8", 1) for b in base] + [b + " Extra" for b in base]
    odd = [None, "", " \t\n", "One", "one", "TWO words", "é É\x85x y", "same " * 3000, "x" * 50_000, base[0], base[0]]
    return base + near + odd


def test_whole_operator_against_brute_force(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = brute_groups(fps)
    assert len(got) == len(rows)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == groups[i]


@pytest.mark.parametrize("cell_pairs", [1, 512])
def test_links_of_crowded_and_sparse_cells(spark, cell_pairs):
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), cell_pairs)).collect()
    names = {r.node: r.component for r in found}
    groups = brute_groups(fps)
    mine = [names.get(s, s) for s in signed]
    for i in range(len(fps)):
        for j in range(len(fps)):
            assert (mine[i] == mine[j]) == (groups[i] == groups[j])


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "quite another text here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (7, "entirely other words stand here", "z")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(kept.collect()) == [(1, "a b c d", "y"), (7, "entirely other words stand here", "z")]


def test_deduplicate_judges_rows_that_share_an_id_or_have_none_each_by_its_text(spark):
    clean = [f"{w} stands quite alone in {w} words of its {w} kind" for w in ("amber", "birch", "cedar", "delta", "ember")]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (None, clean[2]), (8, clean[2]), (5, clean[3]), (9, clean[3]), (5, clean[4]), (2, clean[4])]
    fps = [brute_fingerprint(t) for t in clean]
    assert brute_groups(fps) == list(range(5))
    want = [(-1, clean[0]), (-1, clean[1]), (2, clean[4]), (5, clean[3]), (8, clean[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, docs.repartition(5)):
        got = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.deduplicate(frame).collect()]
        assert sorted(got) == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = spark.createDataFrame([*path, *star, (5, 5), (5, 6)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1300)}}
