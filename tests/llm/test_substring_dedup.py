import random
from time import process_time

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuelake.llm import bwt, substring_dedup


def _total(r):
    return sum(x["b"] - x["a"] for x in r)


@pytest.mark.parametrize("seed", range(20))
def test_interval_expansion_equals_counting(seed):
    rng = random.Random(seed)
    least = rng.choice([1, 2, 3, 5, 9])
    texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
    seen = [t[i : i + least] for t in texts for i in range(len(t) - least + 1)]
    want = [[seen.count(t[i : i + least]) > 1 for i in range(len(t) - least + 1)] for t in texts]
    shorter = [[sum(u[j : j + 1] == t[i : i + 1] for u in texts for j in range(len(u))) > 1 for i in range(len(t))] for t in texts]
    assert [[g.tolist() for g in of] for of in bwt.repeated_starts(texts, least, 1)] == [want, shorter]


def test_strings_that_start_beyond_their_room_are_no_partners():
    full, short = bwt.repeated_starts([b"abcdef", b"xxcdef"], 4, 2, rooms=[2, 3])
    assert [f.tolist() for f in full] == [[False] * 3] * 2 and not any(short[0])
    assert bwt.repeated_starts([b"abcdef", b"xxcdef"], 4, rooms=[3, 3])[0][0].tolist() == [False, False, True]


def test_keys_too_wide_for_their_place_sort_alike():
    """Past 2 ** 21 suffixes a key of two ranks leaves no room for the place below it."""
    keys = np.random.default_rng(5).integers(0, 50, 300).astype(np.uint64)
    assert [a.tolist() for a in bwt._by(keys, 6)] == [a.tolist() for a in bwt._by(keys, 64)] == [sorted(range(300), key=lambda i: keys[i]), (np.diff(np.sort(keys)) == 0).tolist()]


def test_texts_that_repeat_much_cost_little_more_than_random_ones():
    """An interval that most rows are in is extended by its runs; row by row, each of 400 levels read them all."""

    def seconds(texts):
        took = []
        for _ in range(3):
            since = process_time()
            flags = bwt.repeated_starts(texts, 400)[0]
            took.append(process_time() - since)
        return min(took), flags

    plain, flags = seconds([random.Random(1).randbytes(100_000)])
    assert not flags[0].any()
    repeated, flags = seconds([b"a" * 99_999 + b"b"])
    assert flags[0].sum() == len(flags[0]) - 1 and repeated < 5 * plain


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(90), text(75)
    out = [text(60) + passage + text(50) for _ in range(6)] + [text(30) + other[:400], other[5:] + text(40), text(100)] + ["é" * 900, "x" * 1200, None, "", "short"]
    brief = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(4, 6))) for _ in range(55))
    out += [text(20) + " " + brief + " " + text(30) for _ in range(3)] + [brief[:250] + text(20)]
    out += [out[0]] * 4 + [out[0][:300] + "#" + out[0][301:], passage + " " + passage, passage[:399], passage[:400]]
    return out


@pytest.mark.parametrize("max_spans", [4096, 1])
def test_removed_bytes_equal_brute_force(spark, max_spans):
    texts = _texts()
    docs = spark.createDataFrame([(i if i % 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    got = substring_dedup.remove_repeats(docs, max_spans=max_spans).select("doc_id", "n_bytes", "removed", "n_passages", substring_dedup.digest(F.col("kept")).alias("h")).collect()
    want = substring_dedup.brute_force([(t or "").encode() for t in texts])
    assert sorted((len(r.removed), _total(r.removed), r.h, r.n_passages) for r in got) == sorted((n, m, h, p) for m, n, h, p in want)
    assert any(m for m, *_ in want) and any(p and not m for m, _, _, p in want) and sum(r.n_bytes for r in got) == sum(len((t or "").encode()) for t in texts)


def test_chunks_and_empty_tables(spark, monkeypatch):
    data = bytes(random.Random(1).choice(b"ab") for _ in range(3000))
    whole = substring_dedup.spans(data, 400)
    monkeypatch.setattr(substring_dedup, "CHUNK", 500)
    split = substring_dedup.spans(data, 400)
    anchor = lambda found: {s: (at, a) for first, last, at, a in found for s in range(first, last + 1)}
    assert anchor(split) == anchor(whole) and len(anchor(whole)) == 3000 - 400 + 1
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_covered_at_once_as_one_by_one():
    """`covers` handles the runs of a whole batch together; `cover` one text's."""
    rng = random.Random(8)
    for n_texts in (0, 1, 40):
        sizes = [rng.choice([0, 5, 30, 200]) for _ in range(n_texts)]
        starts = [(rng.randrange(n_texts), *sorted(rng.choices(range(210), k=2))) for _ in range(4 * n_texts)]
        starts = [(k, a, b) for k, a, b in starts if a < max(sizes[k], 1)]
        column = lambda c: np.array([s[c] for s in starts], np.int64)  # noqa: B023, E731
        places, low, high = substring_dedup.covers(np.array(sizes, np.int64), column(0), column(1), column(2), 7)
        got = [list(zip(low[i:j].tolist(), high[i:j].tolist(), strict=True)) for i, j in zip(places[:-1], places[1:], strict=True)]
        assert got == [substring_dedup.cover(size, [(a, b) for k, a, b in starts if k == i], 7) for i, size in enumerate(sizes)]
