"""Chat formatting: the turns of a conversation become one marked text with a loss mask, assembled as columns of bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import small_batches

#: The template: a conversation begins with BEGIN; a turn stands between the two marks of its role.
BEGIN = "<s>"
TURNS = {"system": ("[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
#: Any other role is named: between the first two marks; the third closes its turn.
NAMED = ("[ROLE]", "[/ROLE]", "</s>")
#: Roles whose texts a model is trained on.
LOSS_ROLES = ("assistant",)
#: Inside texts, a control string gets a backslash behind its first character, one more if it has some already. So no text
#: holds a control string, and taking one backslash away restores it. Marks begin with a control string's first character
#: or hold none, so none arises where a text meets a mark.
CONTROL = r"/?(?:s>|(?:INST|SYSTEM_PROMPT|ROLE)\])"
_ESCAPED = re.compile(rf"([<\[]\\*)\\({CONTROL})")
#: A conversation whose turns hold more bytes than this is given as several pieces, whose texts follow each other.
PIECE_BYTES = 1 << 24
#: Longer texts are copied as a whole, not through an index of their bytes.
_LONG = 1 << 14


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)({CONTROL})", r"$1\\$2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def marks(role: str) -> tuple[str, str]:
    """What opens and closes a turn of a role, which is escaped already."""
    return TURNS.get(role) or (NAMED[0] + role + NAMED[1], NAMED[2])


def assemble(first: np.ndarray, roles: pa.StringArray, texts: pa.StringArray, loss_roles: tuple[str, ...], begin: np.ndarray) -> tuple[pa.StringArray, pa.ListArray]:
    """The formatted texts and loss spans of rows in order: `first` is true where a result starts, `begin` where it also
    starts a conversation. Spans are (start, end) in code points of their result.

    Each row is four segments: BEGIN, opening mark, text, closing mark. Their lengths summed give each segment its place in one buffer;
    marks are scattered there by role, contents by an index of their bytes.
    """
    n = len(roles)
    named = roles.dictionary_encode()
    codes, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()
    opened, closed = zip(*map(marks, names), strict=True)
    as_bytes = lambda values: [np.frombuffer(v.encode(), np.uint8) for v in values]
    heads, tails, start = as_bytes(opened), as_bytes(closed), np.frombuffer(BEGIN.encode(), np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    sizes = np.diff(at)
    of = lambda values: np.array([len(v) for v in values], np.int64)[codes]
    lengths = np.stack([len(start) * begin, of(heads), sizes, of(tails)], axis=1)
    ends = np.cumsum(lengths).reshape(n, 4)
    places = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]))
    out = np.frombuffer(buffer, np.uint8)
    scatter = lambda where, value: out.__setitem__(where[:, None] + np.arange(len(value)), value)
    scatter(places[begin, 0], start)
    for code, (head, tail) in enumerate(zip(heads, tails, strict=True)):
        rows = codes == code
        scatter(places[rows, 1], head)
        scatter(places[rows, 3], tail)
    if texts.buffers()[2] is not None:
        data, short = np.frombuffer(texts.buffers()[2], np.uint8), sizes <= _LONG
        step = np.arange(sizes[short].sum())
        back = np.cumsum(sizes[short]) - sizes[short]
        out[np.repeat(places[short, 2] - back, sizes[short]) + step] = data[np.repeat(at[:-1][short] - back, sizes[short]) + step]
        for r in np.flatnonzero(~short).tolist():
            out[places[r, 2] : ends[r, 2]] = data[at[r] : at[r + 1]]
    begins = np.flatnonzero(first)
    offsets = np.append(places[begins, 0], ends[-1, -1]).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), buffer)
    chars = lengths.copy()
    chars[:, 1], chars[:, 3] = of(opened), of(closed)
    chars[:, 2] = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    upto = np.cumsum(chars).reshape(n, 4)
    result = np.cumsum(first) - 1  # of each row
    base = (upto - chars)[begins, 0][result]
    masked = np.isin(codes, [k for k, name in enumerate(names) if unescape(name) in loss_roles])
    spans = pa.StructArray.from_arrays([pa.array((upto - chars)[masked, 2] - base[masked]), pa.array(upto[masked, 2] - base[masked])], ["start", "end"])
    counts = np.bincount(result[masked], minlength=len(begins))
    return formatted, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)


def _formatter(loss_roles: tuple[str, ...], piece_bytes: int):
    """Batches of rows (conv, role, text) in order to batches of pieces."""

    def columns(table: pa.Table, piece: int) -> pa.RecordBatch:
        conv, roles, texts = (table.column(i).combine_chunks() for i in range(3))
        codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.append(True, codes[1:] != codes[:-1])
        begin = first.copy()
        begin[0] = piece == 0
        formatted, loss = assemble(first, roles, texts, loss_roles, begin)
        pieces = np.zeros(first.sum(), np.int32)
        pieces[0] = piece
        return pa.record_batch([conv.take(pa.array(np.flatnonzero(first))), pa.array(pieces), formatted, loss], names=["conv", "piece", "formatted", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one conversation
        now, piece, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            head, last = conv[0].as_py(), int(turns[-1]) if len(turns) else 0
            if (held or piece) and head != now:  # the conversation held so far ended with its batch
                if held:
                    yield columns(pa.Table.from_batches(held), piece)
                held, piece, size = [], 0, 0
            if last:
                yield columns(pa.Table.from_batches([*held, batch.slice(0, last)]), piece)
                held, piece, size = [], 0, 0
            rest = batch.slice(last)
            now = rest.column(0)[0].as_py()
            held.append(rest)
            size += rest.nbytes
            if size > piece_bytes:
                yield columns(pa.Table.from_batches(held), piece)
                held, piece, size = [], piece + 1, 0
        if held:
            yield columns(pa.Table.from_batches(held), piece)

    return run


def format_chats(chats: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, piece, formatted, loss): each conversation as one marked text; loss holds the (start, end) in code points of the
    texts of `loss_roles`, each text by itself, marks left out.

    Rows go by turn, null first; those of one turn by role and text, repeated rows all stay. A null text or role is an empty
    one; any role is allowed. Rows with a null id are one conversation. A conversation of more than `piece_bytes` comes as
    pieces 0, 1, ... of whole turns, in order within one partition, so no task holds more than a piece and a batch; its
    rows meet in one task, as its text is one sequence. An empty table gives an empty result; other columns are ignored.
    """
    spark = chats.sparkSession
    small_batches(spark)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = chats.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = f"conv {dict(rows.dtypes)['conv']}, piece int, formatted string, loss array<struct<start:bigint,end:bigint>>"
    made = ordered.select("conv", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    return made.mapInArrow(_formatter(loss_roles, piece_bytes), schema).withColumnRenamed("conv", id_col)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text or piece."""
    at = len(BEGIN) if formatted.startswith(BEGIN) else 0
    while at < len(formatted):
        if formatted.startswith(NAMED[0], at):
            end = formatted.index(NAMED[1], at)
            role = unescape(formatted[at + len(NAMED[0]) : end])
            at, close = end + len(NAMED[1]), NAMED[2]
        else:
            role, (opening, close) = next((r, m) for r, m in TURNS.items() if formatted.startswith(m[0], at))
            at += len(opening)
        end = formatted.index(close, at)
        yield role, unescape(formatted[at:end])
        at = end + len(close)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read from the pieces that
    `format_chats` gives, in their order: the turns' digest is over role, line feed, text, line feed; the loss is what the
    mask covers, unescaped. Texts are digested as they pass; none is held beyond its piece."""
    small_batches(formatted.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = conv = None
        state: list | None = None  # turns, their digest, loss characters, their digest, formatted characters

        def settle() -> pa.RecordBatch:
            n, told, chars, loss, whole = state
            values = (conv, kind), (n, pa.int64()), (told.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (whole, pa.int64())
            return pa.record_batch([pa.array([v], k) for v, k in values], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

        for batch in batches:
            kind, ready = batch.schema.field(0).type, []
            for key, piece, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    if state is not None:
                        ready.append(settle())
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield from done(ready)
        if state is not None:
            yield settle()

    rows = formatted.select(F.col(id_col).alias("conv"), "piece", "formatted", "loss")
    schema = f"conv {dict(rows.dtypes)['conv']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(digests, schema).withColumnRenamed("conv", id_col)
