"""Fill-in-the-middle: a text is cut at two boundaries of its units and its pieces are reordered for infilling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import small_batches

#: What marks the prefix, the suffix and the middle. A text that holds one of them stays as it is.
SENTINELS = ("<P>", "<S>", "<M>")
#: Classes of code points: other, white space, line feed.
_OTHER, _BLANK, _FEED = range(3)
_BLANKS = np.array([0x09, 0x0B, 0x0C, 0x0D, 0x20], "<u4")
#: Whether a unit ends between a code point of one class (row) and its right neighbour's (column).
ENDS = {
    "line": np.array([[0, 0, 0], [0, 0, 0], [1, 1, 1]], bool),  # each line with its line feed
    "word": np.array([[0, 0, 0], [1, 0, 0], [1, 0, 0]], bool),  # each word with the white space behind it
}
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """The ends of the units of a text, given as its code points; the last is the text's length. No text, no unit."""
    if not len(points):
        return np.zeros(0, np.int64)
    classes = np.zeros(len(points), np.uint8)
    classes[np.isin(points, _BLANKS)] = _BLANK
    classes[points == 0x0A] = _FEED
    return np.append(np.flatnonzero(ENDS[unit][classes[:-1], classes[1:]]) + 1, len(points))


def rearranged(text: str, digest: str, unit: str, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text; see `fill_in_middle`."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = unit_ends(points, unit)
    n = len(ends)
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or any(s in text for s in SENTINELS) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    ranks = np.sort([h1 % (n + 1), h2 % (n + 1)])
    a, b = np.append(0, ends)[ranks].tolist()
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = SENTINELS
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def restored(output: str, form: str) -> str:
    """The text that `output` was made of. A sentinel cannot arise where pieces meet, as it starts with its only '<'."""
    if form == "plain":
        return output
    p, s, m = SENTINELS
    first, second = (p, s) if form == "psm" else (s, p)
    head, _, middle = output.rpartition(m)
    left, _, right = head.removeprefix(first).partition(second)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return "".join((prefix, middle, suffix))


def restore(output: Column, form: Column) -> Column:
    """`restored` of columns."""

    def texts(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restored(o, f) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(texts, "string")(output, form)


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row, repeated rows included, without a shuffle.

    n counts the text's units (lines or words). Four numbers drawn from a hash of seed and id choose the two boundaries and
    the form, so reruns agree and rows that share an id are cut by the same draws. form is plain (the text as it is), psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle). Empty texts, null ones too, and texts that hold a sentinel are
    plain; their two lengths are null. A null id draws as the seed alone. An empty table gives an empty result; other columns
    are ignored.
    """
    if unit not in ENDS:
        raise ValueError(f"no such unit: {unit}")
    small_batches(docs.sparkSession)

    def pieces(texts: pa.Array, digests: pa.Array) -> pa.Array:
        found = [rearranged(t, d, unit, fim_percent, spm_percent) for t, d in zip(texts.to_pylist(), digests.to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    made = F.arrow_udf(pieces, _RESULT)(F.coalesce(F.col(text_col), F.lit("")), digest)
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.*")
