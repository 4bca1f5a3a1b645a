"""Quality classifier: a generalised additive model with pairwise interactions over style features of whole texts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import small_batches

#: Labelled rows that the model is fitted on, at most: those of the least hash of their id.
MAX_TRAINING_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_chars", "word_chars_sd", "long_words", "short_words", "distinct_words", "top_word", "top_pair", "repeated_fives",
    "upper", "digits", "symbols", "marks", "other_letters", "breaks", "log_lines", "line_words", "repeated_lines", "closed_lines", "one_word_lines",
    "sentence_words", "capital_words", "marked_words", "signless_ends",
)
_BINS = 48
_PAIR_BINS = 8
_PAIRS = 8
_ROUNDS = 250
_PAIR_ROUNDS = 80
_RATE = 0.08
_ENDS = frozenset(".!?…:;\"'”»)")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-…“”«»’]")
_MARKS = re.compile(r"[.,;:!?]")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_SENTENCE_ENDS = re.compile(r"[.!?]+(?:\s|$)")


def features(text: str | None) -> list[float]:
    """Style features of a whole text, none of them a word's meaning or a language; null counts as empty."""
    text = text or ""
    words = text.split()
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    n, c, k = len(words), max(len(text), 1), max(len(lines), 1)
    m = max(n, 1)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    fives = len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    letters = np.array([w[0].isupper() for w in words]) if n else np.zeros(1)
    return [
        np.log1p(len(text)), np.log1p(n), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()), float((lengths <= 3).mean()),
        len(counts) / m**0.8, max(counts.values(), default=0) / m, max(pairs.values(), default=0) / m, 1 - fives / max(n - 4, 1) if n > 4 else 0.0,
        len(_UPPER.findall(text)) / c, sum(map(text.count, "0123456789")) / c, len(_SYMBOLS.findall(text)) / c, len(_MARKS.findall(text)) / c,
        1 - len(text.encode("ascii", "ignore")) / c, text.count("\n") / c, np.log1p(len(lines)), n / k, 1 - len(set(lines)) / k if lines else 0.0,
        sum(x[-1] in _ENDS for x in lines) / k, sum(" " not in x for x in lines) / k, min(n / max(len(_SENTENCE_ENDS.findall(text)), 1), 500.0),
        float(letters.mean()), sum(not w[-1].isalnum() for w in words) / m, sum(not w[0].isalnum() for w in words) / m,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features; a score is the sum of one entry of each."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles, without repeats."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 4.0) -> np.ndarray:
    """Newton steps by bin, constant over at most `leaves` runs of bins: the best split of any run, one after another."""
    spans, gain_of = [(0, len(g))], lambda a, b: a * a / (b + 1.0)
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for s, (lo, hi) in enumerate(spans):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            lg, lh, rg, rh = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
            gain = gain_of(lg, lh) + gain_of(rg, rh) - gain_of(cg[hi] - cg[lo], ch[hi] - ch[lo])
            gain[(lh < least) | (rh < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (s, int(at[gain.argmax()])))
        if best[1] is None:
            break
        s, cut = best[1]
        lo, hi = spans[s]
        spans[s : s + 1] = [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round visits every feature once and adds a small step of a shallow tree to its table; then the
    pairs with the most left to explain get small two-way tables. No rows, or rows of one label, give a constant."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if len(y) < 20 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_cuts(x[:, j], _BINS) for j in range(d)]
    model.pair_edges = [_cuts(x[:, j], _PAIR_BINS) for j in range(d)]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        return y - p, p * (1 - p)

    for _ in range(_ROUNDS):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = _RATE * _shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(d)]
    widths = [len(e) + 1 for e in model.pair_edges]
    g, h = slopes()
    strength = []
    for a in range(d):
        for b in range(a + 1, d):
            cell, n = coarse[a] * widths[b] + coarse[b], widths[a] * widths[b]
            cg, ch = np.bincount(cell, g, n), np.bincount(cell, h, n)
            strength.append((float((cg * cg / (ch + 5.0)).sum()) - 2.0 * np.sqrt(n), a, b))
    for _, a, b in sorted(strength, reverse=True)[:_PAIRS]:
        model.pairs.append((a, b, np.zeros((widths[a], widths[b]))))
    for _ in range(_PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            cell, n = coarse[a] * widths[b] + coarse[b], widths[a] * widths[b]
            step = _RATE * np.bincount(cell, g, n) / (np.bincount(cell, h, n) + 5.0)
            table += step.reshape(table.shape)
            total += step[cell]
    return model


def _features_of(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.to_pylist()], float).reshape(-1, len(FEATURES))


def _feature_rows(texts: pa.Array) -> pa.Array:
    return pa.array(list(_features_of(texts)), pa.list_(pa.float64()))


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most `max_rows` labelled rows outside the held-out part; a document with several labels takes their
    majority, a tie counting as 0. Null and other labels are left out."""
    small_batches(docs.sparkSession)
    known = labels.filter(~is_held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sample = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # of rows that share an id, all of whose texts have its label, one is learnt from: at most `max_rows` come back
    single = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = single.select("id", "y", F.arrow_udf(_feature_rows, "array<double>")("text").alias("x")).toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(text: Column, model: AdditiveModel) -> Column:
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features_of(texts)), pa.float64())

    return F.arrow_udf(scores, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row, repeated rows included; empty and null texts are scored too. Only the
    text is an input of a score. An empty table gives an empty result; without usable labels the score is 0.5."""
    model = train(docs, labels, id_col, text_col, label_col, max_rows)
    out = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """`docs` without the rows that the classifier rejects (predicted 0); each row is judged by its text alone, so null ids and
    repeated rows do not matter, and null texts count as empty."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.filter(score(F.col(text_col), model) >= 0.5)
