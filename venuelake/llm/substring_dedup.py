"""Removal of long repeated substrings: anchors bring equal strings together, interval expansion on a BWT decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.bwt import repeated_starts
from venuelake.llm.common import small_batches, spread_join, stored

#: Bytes of a string that may not occur twice.
LEAST = 400
#: Bytes of the strings that make up a repeated passage, and the words that a passage holds more of. Words of the common
#: languages take over five bytes with their space, so a passage of over 50 words holds such strings.
SCREEN, PASSAGE_WORDS = 256, 50
#: Bytes of an anchor.
GRAM = 16
#: Windows of a text handled at once.
CHUNK = 1 << 22
#: Classes of a span's strings by their place about the anchor; the strings of a class share a core.
CLASSES = 8
#: Bytes that one transform holds, unless a single anchor has more.
BATCH_BYTES = 1_500_000
#: Distinct spans of an anchor up to which one transform holds them; beyond, those with a common core are counted window by
#: window.
MAX_SPANS = 4096
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PLACE = np.uint64((1 << 24) - 1)


def spans(data: bytes, least: int = SCREEN, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(first, last, at, anchor): every string of `least` bytes has one anchor, its least-hashed gram, the first of equal ones.
    Strings that start from `first` to `last` share one, which stands at `at`. Equal strings have equal anchors, wherever they
    stand; so have equal longer strings, by the anchor of their first `least` bytes."""
    out: list[tuple[int, int, int, int]] = []
    for begin in range(0, len(data) - least + 1, CHUNK):
        part = data[begin : begin + CHUNK + least - 1]
        n, width = len(part), least - gram + 1
        grams = n - gram + 1
        eight = np.ndarray((n - 7,), "<u8", part, 0, (1,))
        h = (eight[:grams] * _K[0]) ^ ((eight[gram - 8 : gram - 8 + grams] * _K[1]) >> np.uint64(7))
        h ^= h >> np.uint64(32)
        h *= _K[2]
        h ^= h >> np.uint64(29)
        placed = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
        placed[:grams] = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        blocks = placed.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - least + 1
        best = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        cuts = np.flatnonzero(best[1:] != best[:-1]) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [windows - 1]])
        at = (best[first] & _PLACE).astype(np.int64)
        anchors = h[at].view(np.int64)
        out.extend(zip((first + begin).tolist(), (last + begin).tolist(), (at + begin).tolist(), anchors.tolist(), strict=True))
    return out


def _all_spans(rows: DataFrame, least: int, screen: int) -> DataFrame:
    """(key, id, first, last, at, anchor, span) for the rows (key, id, data): span is a 64-bit hash of the bytes up to the end
    of the longest string that starts in it, at most `least` bytes after its last place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for key, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := spans(data, screen):
                    hashes = [xxhash.xxh3_64_intdigest(data[first : last + least]) - (1 << 63) for first, last, _, _ in found]
                    for column, values in zip(out, ([key] * len(found), [doc] * len(found), *zip(*found, strict=True), hashes), strict=True):
                        column.extend(values)
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "id", "first", "last", "at", "anchor", "span"])

    return rows.mapInArrow(find, "key binary, id long, first int, last int, at int, anchor long, span long")


def _packed(data: Column) -> Column:
    """The bytes compressed: whole texts are shuffled in this form."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([zstandard.compress(t, 1) for t in texts.to_pylist()], pa.binary())

    return pack(data)


def _lengths(lists: pa.Array) -> np.ndarray:
    """How many elements each list has; null has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(lists: pa.Array) -> dict[str, pa.Array]:
    """The columns of the structs in all lists, one list after another."""
    structs = lists.flatten()
    return dict(zip((f.name for f in structs.type), structs.flatten(), strict=True))


def _cut_out(held: DataFrame, least: int) -> DataFrame:
    """(anchor, span, at, room, data) for the rows (packed, wanted), wanted being an array of (first, last, at, anchor, span);
    `at` now counts from the span's start, `room` counts the places from which its strings start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, wanted = batch.columns
            each = _fields(wanted)
            places = zip(each["first"].to_pylist(), each["last"].to_pylist(), strict=True)
            pieces = []
            for text, n in zip(packed.to_pylist(), _lengths(wanted).tolist(), strict=True):
                data = zstandard.decompress(text)
                pieces += [data[first : last + least] for first, last in islice(places, n)]
            room = pc.add(pc.subtract(each["last"], each["first"]), pa.scalar(1, pa.int32()))
            yield pa.record_batch([each["anchor"], each["span"], pc.subtract(each["at"], each["first"]), room, pa.array(pieces, pa.binary())], names=["anchor", "span", "at", "room", "data"])

    return held.mapInArrow(cut, "anchor long, span long, at int, room int, data binary")


def _cores(at: int, room: int, data: bytes, screen: int) -> Iterator[tuple[int, bytes]]:
    """(class, core): a string of `screen` bytes that two spans share has the same place about their anchor, so both have the
    core of its class, which all strings of the class contain."""
    width = -(-screen // CLASSES)
    for c in range(CLASSES):
        start, end = at - c * width, at - (c + 1) * width + 1 + screen
        # a string of the class starts in [end - screen, start]; some does within this span
        if start >= 0 and end - screen < room:
            yield c, data[start:end]


def _promising(members: dict[int, tuple[int, int, bytes]], screen: int) -> dict[int, tuple[int, bytes]]:
    """span -> (room, bytes) for the spans of one anchor that share a core with another."""
    cores: dict[tuple[int, bytes], list[int]] = {}
    for span, (at, room, data) in members.items():
        for core in _cores(at, room, data, screen):
            cores.setdefault(core, []).append(span)
    kept = {span for sharing in cores.values() if len(sharing) > 1 for span in sharing}
    return {span: (room, data) for span, (_, room, data) in members.items() if span in kept}


def _runs(flags: list[np.ndarray], long: bool) -> Iterator[tuple[int, dict]]:
    """(which of the flags, run) for the runs of places that are set."""
    ends = np.cumsum([len(f) + 1 for f in flags])
    gap = np.zeros(1, bool)
    joined = np.concatenate([gap, *(part for f in flags for part in (f, gap))]).astype(np.int8)
    first, last = np.flatnonzero(np.diff(joined)).reshape(-1, 2).T
    owner = np.searchsorted(ends, first, side="right")
    shift = np.concatenate([[0], ends])[owner]
    for k, a, b in zip(owner.tolist(), (first - shift).tolist(), (last - shift).tolist(), strict=True):
        yield k, {"a": a, "b": b - 1, "long": long}


_RUN = "array<struct<a:long,b:long,long:boolean>>"
_RUN_KIND = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("long", pa.bool_())]))


def _expanded(cut: DataFrame, least: int, screen: int) -> DataFrame:
    """(anchor, span, runs) of the spans (anchor, span, at, room, data) with a repeated string of `screen` bytes; runs are
    ranges of places (a, b) from the span's start, those of `least` bytes marked long. All spans of an anchor meet in a
    task, which transforms some anchors at a time: once for the strings of either length."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[int, list[int], int, bytes]]] = {True: [], False: []}  # (anchor, its spans, room, bytes)
        runs: dict[tuple[int, int], list[dict]] = {}
        members: dict[int, tuple[int, int, bytes]] = {}
        size, last = 0, None

        def collect() -> int:
            """Take over the spans of one anchor that a transform must compare; returns their bytes."""
            full = {s: (at, min(room, len(data) - least + 1), data) for s, (at, room, data) in members.items() if len(data) >= least}
            long = [(last, [s], room, data) for s, (room, data) in _promising(full, least).items()]
            # spans whose bytes differ only beyond their short strings repeat all of these; one of them is compared with others
            alike: dict[tuple[int, bytes], list[int]] = {}
            for s, (at, room, data) in members.items():
                alike.setdefault((at, data[: room - 1 + screen]), []).append(s)
            for (_, data), spans in alike.items():
                if len(spans) > 1:
                    for s in spans:
                        runs[last, s] = [{"a": 0, "b": len(data) - screen, "long": False}]
            near = _promising({spans[0]: (at, len(data) - screen + 1, data) for (at, data), spans in alike.items()}, screen)
            short = [(last, alike[members[s][0], data], room, data) for s, (room, data) in near.items()]
            held[True] += long
            if any(len(spans) == 1 for _, spans, *_ in short):
                held[False] += short
            return sum(len(d) for *_, d in long) + sum(len(d) for *_, d in short)

        def settle() -> pa.RecordBatch:
            for long, rows in held.items():
                (flags,) = repeated_starts([d for *_, d in rows], least if long else screen, rooms=[r for *_, r, _ in rows]) if rows else ([],)
                for k, run in _runs(flags, long):
                    anchor, spans = rows[k][:2]
                    if len(spans) == 1:
                        runs.setdefault((anchor, spans[0]), []).append(run)
                rows.clear()
            out = pa.record_batch(
                [pa.array([a for a, _ in runs], pa.int64()), pa.array([s for _, s in runs], pa.int64()), pa.array(list(runs.values()), _RUN_KIND)],
                names=["anchor", "span", "runs"],
            )
            runs.clear()
            return out

        for batch in batches:
            for anchor, span, at, room, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    size += collect()
                    members, last = {}, anchor
                    if size >= BATCH_BYTES:
                        yield settle()
                        size = 0
                members.setdefault(span, (at, room, data))
        collect()
        if runs or any(held.values()):
            yield settle()

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(expand, f"anchor long, span long, runs {_RUN}")


def _counted(cut: DataFrame, least: int, screen: int) -> DataFrame:
    """The same for anchors with very many spans, so that no task holds an anchor's spans together: those that share a core
    with another are found by counting cores, and then each of their strings is counted by the hash of its bytes."""

    @F.arrow_udf("array<binary>")
    def cores(anchor: pa.Array, at: pa.Array, room: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (anchor, at, room, data)), strict=True)
        return pa.array([[xxhash.xxh3_128_digest(b"%d,%d," % (a, c) + core) for c, core in _cores(p, r, d, screen)] for a, p, r, d in rows], pa.list_(pa.binary()))

    @F.arrow_udf("array<struct<a:long,long:boolean,h:binary>>")
    def windows(room: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for r, d in zip(room.to_pylist(), data.to_pylist(), strict=True):
            mine = [(i, length == least, d[i : i + length]) for length in (screen, least) for i in range(min(r, len(d) - length + 1))]
            out.append([{"a": i, "long": long, "h": xxhash.xxh3_128_digest(w)} for i, long, w in mine])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("long", pa.bool_()), ("h", pa.binary())])))

    single = stored(cut.dropDuplicates(["anchor", "span"]), "crowded")
    each_core = single.select("anchor", "span", F.explode(cores("anchor", "at", "room", "data")).alias("core"))
    common = each_core.groupBy("core").agg(F.count("*").alias("n"), F.min("span").alias("span")).filter("n > 1")
    sharing = spread_join(each_core, common.select("core", "n"), ["core"]).select("anchor", "span").distinct()
    each = stored(single.join(sharing, ["anchor", "span"], "left_semi").select("anchor", "span", F.inline(windows("room", "data"))), "windows")
    twice = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    places = spread_join(each, twice, ["h"]).groupBy("anchor", "span").agg(F.collect_set(F.struct("a", F.col("a").alias("b"), "long")).alias("runs"))
    return places.select("anchor", "span", F.col("runs").cast(_RUN).alias("runs"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, screen: int = SCREEN, max_spans: int = MAX_SPANS) -> DataFrame:
    """(key, runs) for the texts with strings of `screen` bytes that start anywhere else: key is the MD5 of the text, runs
    are ranges (a, b, long) of such starts, those of `least` bytes marked long.

    Spans with equal bytes are counted first, which settles copies of any number without moving their texts. Only where an
    anchor has different spans are the bytes of one of each fetched and compared. Rows of hot anchors and hot spans, as of
    a line or passage that very many texts have, are joined where they are.
    """
    small_batches(docs.sparkSession)
    data = F.col(text_col).cast("binary")
    held = docs.filter(F.octet_length(text_col) >= screen).select(F.unhex(F.md5(data)).alias("key"), F.col(id_col).cast("long").alias("id"), data.alias("data"))
    every = stored(_all_spans(held, least, screen), "spans")
    # most anchors occur once and go no further
    shared = every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("span") != F.max("span")).alias("several")).filter("n > 1")
    live = stored(spread_join(every, shared, ["anchor"]).drop("n"), "shared-spans")
    counted = live.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("key", "id", "first", "last", "at")).alias("one"))
    counted = stored(counted, "span-counts")
    different = counted.filter("several").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > max_spans)
    # there are at most as many such anchors as spans divided by max_spans
    crowded = spread_join(counted.filter("several").select("anchor", "span"), different, ["anchor"]).select("anchor", "span", F.lit(True).alias("crowded"))
    some = len(different.take(1)) > 0
    compared = counted.filter("several")
    compared = compared.join(stored(crowded, "crowded-spans"), ["anchor", "span"], "left") if some else compared.withColumn("crowded", F.lit(None).cast("boolean"))
    place = F.struct(F.col("one.first").alias("first"), F.col("one.last").alias("last"), F.col("one.at").alias("at"), "anchor", "span", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    wanted = stored(compared.groupBy("one.key", "one.id").agg(F.collect_list(place).alias("wanted")), "wanted")
    packed = held.select("key", "id", _packed(F.col("data")).alias("packed"))
    by = packed.join(wanted, (packed.key == wanted.key) & packed.id.eqNullSafe(wanted.id)).select("packed", "wanted")
    usual = by.withColumn("wanted", F.filter("wanted", lambda w: ~w["crowded"])).filter(F.size("wanted") > 0)
    settled = _expanded(_cut_out(usual, least), least, screen)
    if some:
        settled = settled.unionByName(_counted(_cut_out(by.withColumn("wanted", F.filter("wanted", lambda w: w["crowded"])).filter(F.size("wanted") > 0), least), least, screen))
    # all strings of a span that occurs twice are repeated; in a span that occurs once, those that the comparison found
    room = (F.col("one.last") - F.col("one.first")).cast("long")
    whole = F.array(*[F.struct(F.lit(0).cast("long").alias("a"), room.alias("b"), F.lit(long).alias("long")) for long in (False, True)])
    once = settled.join(counted.filter("n = 1 and several").select("anchor", "span", "n"), ["anchor", "span"])
    hits = counted.filter("n > 1").select("anchor", "span", whole.alias("runs"), "n").unionByName(once.select("anchor", "span", "runs", "n"))
    # a text's copies have the same places, so each is taken once
    placed = spread_join(live.select("key", "first", "anchor", "span"), stored(hits, "hits"), ["anchor", "span"])
    return placed.groupBy("key").agg(F.collect_set(F.struct("first", "runs")).alias("runs"))


def cover(size: int, starts: Iterable[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """The maximal ranges of bytes (from, to) of a text of `size` bytes that strings of `least` bytes cover, given the ranges
    (first, last) of their starts; starts with fewer bytes behind them are none."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        a, b = first, min(last + least, size)
        if b - a < least:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def covers(sizes: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, from, to): what `cover` gives for many texts at once. Starts have the number of their text; the ranges of text i
    are those from places[i] up to places[i + 1]."""
    base = np.cumsum(sizes + 1) - sizes - 1  # a byte between texts, so that no range meets the next text's
    low, high = first + base[text], np.minimum(last + least, sizes[text]) + base[text]
    fits = high - low >= least
    low, high, text = low[fits], high[fits], text[fits]
    by = np.argsort(low)
    low, high, text = low[by], np.maximum.accumulate(high[by]), text[by]
    head = np.ones(len(low), bool)
    head[1:] = low[1:] > high[:-1]
    tail = np.ones(len(low), bool)
    tail[:-1] = head[1:]
    owner = text[head]
    places = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return places, low[head] - base[owner], high[tail] - base[owner]


def _rest(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in removed)]
    starts = [*(a for a, _ in removed), len(data)]
    return b"".join(data[e:s] for e, s in zip(ends, starts, strict=True))


def passages(data: bytes, covered: list[tuple[int, int]], words: int = PASSAGE_WORDS) -> int:
    """How many of the ranges hold more than `words` words, cut ones at their ends not counted."""
    found = 0
    for a, b in covered:
        # a word goes on across an end where neither side of it is white space
        cut = sum(0 < end < len(data) and not data[end - 1 : end].isspace() and not data[end : end + 1].isspace() for end in (a, b))
        found += len(data[a:b].split()) - cut > words
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, screen: int = SCREEN, max_spans: int = MAX_SPANS) -> DataFrame:
    """(id, n_bytes, removed, kept, n_passages) for every row, repeated rows included: removed are the maximal ranges of bytes
    covered by a string of `least` bytes that starts anywhere else in the table, the same text included; kept are the other
    bytes. n_passages counts the passages that repeat: maximal ranges covered by strings of `screen` bytes that start anywhere
    else, of more than PASSAGE_WORDS words; they are counted, not removed.

    Texts are UTF-8 bytes, null is empty, and ranges may cut a character. Strings are judged on the input, and never cross
    texts. Repeated rows are copies of one another. Texts under `screen` bytes lose nothing; an empty table gives an empty
    result; null ids and other columns do not matter.
    """
    if screen > least:
        raise ValueError("passages are found by strings of at most the removed length")
    runs = repeated_windows(docs, id_col, text_col, least, screen, max_spans)
    @F.arrow_udf("removed array<struct<a:long,b:long>>, kept binary, n_passages long")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        datas = [zstandard.decompress(t) for t in texts.to_pylist()]
        sizes = np.array([len(d) for d in datas], np.int64)
        each = _fields(found)
        runs, n_runs = _fields(each["runs"]), _lengths(each["runs"])
        doc = np.repeat(np.repeat(np.arange(len(datas)), _lengths(found)), n_runs)
        at = np.repeat(each["first"].to_numpy().astype(np.int64), n_runs)
        first, last, long = runs["a"].to_numpy() + at, runs["b"].to_numpy() + at, runs["long"].to_numpy(zero_copy_only=False).astype(bool)
        places, a, b = covers(sizes, doc[long], first[long], last[long], least)
        removed = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))
        a, b = a.tolist(), b.tolist()
        kept = [d if i == j else _rest(d, list(zip(a[i:j], b[i:j], strict=True))) for d, i, j in zip(datas, places.tolist(), places[1:].tolist(), strict=False)]
        places, a, b = covers(sizes, doc[~long], first[~long], last[~long], screen)
        a, b = a.tolist(), b.tolist()
        repeated = [0 if i == j else passages(d, list(zip(a[i:j], b[i:j], strict=True))) for d, i, j in zip(datas, places.tolist(), places[1:].tolist(), strict=False)]
        return pa.StructArray.from_arrays([removed, pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())], ["removed", "kept", "n_passages"])

    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data")).withColumn("key", F.unhex(F.md5("data")))
    rows = rows.select("id", "key", F.octet_length("data").cast("long").alias("n_bytes"), _packed(F.col("data")).alias("packed"))
    joined = rows.join(runs, "key", "left").select("id", "n_bytes", cut("packed", "runs").alias("r"))
    return joined.select(F.col("id").alias(id_col), "n_bytes", "r.removed", "r.kept", "r.n_passages")


def digest(kept: Column) -> Column:
    return F.sha2(kept, 256)


def brute_force(texts: list[bytes], least: int = LEAST, screen: int = SCREEN) -> list[tuple[int, int, str, int]]:
    """(n_removed, n_spans, SHA-256 of the rest, n_passages) by counting every string; for tests."""

    def covered(length: int) -> list[list[tuple[int, int]]]:
        seen: dict[bytes, int] = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
        return [cover(len(t), ((i, i) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1), length) for t in texts]

    out = []
    for t, removed, repeated in zip(texts, covered(least), covered(screen), strict=True):
        out.append((sum(b - a for a, b in removed), len(removed), hashlib.sha256(_rest(t, removed)).hexdigest(), passages(t, repeated)))
    return out
