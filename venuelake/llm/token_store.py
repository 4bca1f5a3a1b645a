"""Token-id output: documents become compressed segments of ids in document order, and are read back from them."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuelake.llm import range_coder
from venuelake.llm.common import shared_folder, small_batches, stored

#: The id that ends each document.
END_ID = 2
#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 1 << 22
#: Bytes of text that are tokenized at once, unless one batch has more.
TEXT_BYTES = 1 << 24
#: Words whose ids a task remembers; it forgets them all beyond.
CACHED_WORDS = 1_100_000
MAGIC = b"VLTS"
_HEAD = struct.Struct("<4sII")  # magic, documents, bytes of their table


def default_tokenizer() -> str:
    """The tokenizer file of the registered query, read on the driver; its text is sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


class WordTokenizer:
    """Ids of texts. Where the tokenizer drops white space and joins nothing across it, a text's ids are those of its words
    one after another, so words seen before are looked up; this is tried on texts first, and where it does not hold each
    text goes through the whole tokenizer. Ids are 16-bit numbers; a tokenizer with larger ones is refused.

    A new word of Latin letters, perhaps with ASCII marks after them, is lower-cased, taken apart and given to the
    tokenizer's model at once; it comes back in many such forms, so the letters are remembered by themselves. All other
    words go through the whole tokenizer.
    """

    _SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.:;?|]*)")
    _LETTERS = _byte_letters()

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # only for tokenizers that split letters from marks and lower-case: as the whole tokenizer would do it
        probe = ["Straße,", "L'été", "na|ïve", "ÀÖ?!", "a&*#$%.;:"]
        self.simple = True
        self.simple = all(self._word(w) == self._whole(w) for w in probe)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids beyond 16 bits")
        self.by_words = all(self._holds(t) for t in ("A few words, then more.", " two  gaps\tand\n\nbreaks \n", "l'été | été 12.5 a_b (x) don't", "\u65e5\u672c\u8a9e \u0645\u0631\u062d\u0628\u0627 \U0001f642 \u00a0z"))

    def _holds(self, text: str) -> bool:
        return b"".join(self._word(w) for w in re.split("[ \n\t]", text)) == self._whole(text)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self._LETTERS)
            ids = [t.id for t in self.model.tokenize(mapped)]
            found = self.parts[part] = struct.pack(f"<{len(ids)}H", *ids)
        return found

    def _word(self, word: str) -> bytes:
        simple = self._SIMPLE.fullmatch(word) if self.simple else None
        if simple is None:
            return self._whole(word)
        letters, marks = simple.groups()
        return self._part(letters.lower()) + (self._part(marks) if marks else b"")

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, 16-bit numbers. Each different word of the batch is looked up once."""
        plain = pc.fill_null(texts, "")
        self.by_words = self.by_words and (not len(plain) or self._holds(plain[0].as_py()))
        if not self.by_words:
            return [np.frombuffer(self._whole(t), "<u2") for t in plain.to_pylist()]
        for gap in "\n\t":
            plain = pc.replace_substring(plain, gap, " ")
        split = pc.split_pattern(plain, " ")
        words = split.flatten().dictionary_encode()
        for table in (self.known, self.parts):
            if len(table) > CACHED_WORDS:
                table.clear()
        found = []
        for word in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            data = self.known.get(word)
            if data is None:
                data = self.known[word] = self._word(word)
            found.append(data)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        which = words.indices.to_numpy()
        counts = sizes.take(which)
        ends = np.concatenate([[0], np.cumsum(counts)])
        # an id stands as far behind its word's first one as in the words' own list
        at = np.repeat((np.cumsum(sizes) - sizes).take(which) - ends[:-1], counts)
        at += np.arange(ends[-1])
        every = np.frombuffer(b"".join(found), "<u2").take(at)
        texts_at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.split(every, texts_at[1:-1])


_ready: dict[str, WordTokenizer] = {}


def _tokenizer(tokenizer_json: str) -> WordTokenizer:
    """One a worker process, which keeps what it has learnt from task to task."""
    if tokenizer_json not in _ready:
        _ready.clear()
        _ready[tokenizer_json] = WordTokenizer(tokenizer_json)
    return _ready[tokenizer_json]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches put together, about `TEXT_BYTES` at a time; none is empty."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TEXT_BYTES:
            yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of whole documents: header, compressed table of (known id, id, ids), and the coded ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(x) for x in ids], "<i8")
    table = zlib.compress(known.tobytes() + numbers.tobytes() + sizes.tobytes())
    return _HEAD.pack(MAGIC, len(doc_ids), len(table)) + table + range_coder.encode(np.concatenate(ids) if ids else np.zeros(0, np.int64))


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, n, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    table = zlib.decompress(data[_HEAD.size : _HEAD.size + size])
    known, numbers, sizes = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<i8", n, 9 * n)
    ids = range_coder.decode(data[_HEAD.size + size :])
    if sizes.sum() != len(ids):
        raise ValueError("the document table does not fit the ids")
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if n else []


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write every document's ids, each followed by `end_id`, to `path` in ascending order of id.

    The table there has a row a segment: (part, segment, first, payload). Parts are ranges of ids in order; `first` counts
    the ids of the part before the segment; a payload is a file of its own (see `pack_segment`). Null texts have only the
    end id; null ids come first; rows that share an id are kept, ordered by their texts' hashes.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(sent.value), np.array([end_id], "<u2")
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def settle() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in (part, segment, first)]
            return pa.record_batch([*columns, pa.array([pack_segment(doc_ids, ids)], pa.binary())], names=["part", "segment", "first", "payload"])

        for docs_at, texts in _gathered(batches):
            for doc, data in zip(docs_at.to_pylist(), tokenizer.ids(texts), strict=True):
                doc_ids.append(doc)
                ids.append(np.concatenate([data, end]))
                held += len(ids[-1])
                if held >= segment_ids:
                    yield settle()
                    segment, first, held = segment + 1, first + held, 0
                    doc_ids, ids = [], []
        if doc_ids:
            yield settle()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(encode, "part long, segment long, first long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every document of a table that `write_tokens` wrote: start counts the ids of all
    documents before it; the checksum is over the ids as little-endian unsigned 32-bit numbers."""
    small_batches(spark)
    segments = spark.read.schema("part long, segment long, first long, payload binary").parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "payload")), strict=True):
                doc_ids, ids = unpack_segment(payload)
                sizes = np.array([len(x) for x in ids], np.int64)
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                columns = [pa.array(doc_ids, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.record_batch(columns, names=["id", "part", "at", "n_tokens", "ids_crc32"])

    read = segments.select("part", "first", "payload").mapInArrow(decode, "id long, part long, at long, n_tokens long, ids_crc32 long")
    return read.select(F.col("id").alias(id_col), "part", "at", "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_json: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents to `path` (a new folder beside the checkpoints if None) and read them back: (id, start, n_tokens,
    ids_crc32), one row a document, repeated rows included. An empty table gives an empty result."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer_json or default_tokenizer(), id_col, text_col)
    found = stored(read_tokens(spark, path, id_col), "token-index")
    # a row a part: the part before it ends where it starts
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return found.join(offsets, "part").select(id_col, (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
