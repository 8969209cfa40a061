"""Repeated byte strings by bucket-pointer refinement, over content-chosen offsets.

Every byte covered by a string of `length` bytes that also starts elsewhere is found. As in
bucket-pointer refinement, suffixes are put into buckets by their first bytes, and a
bucket is refined by the bucket identifiers of its members at a later
offset; the new identifiers are used in the next refinement, so each reaches further into the text.

Anchors. Suffixes start at anchors only: the anchor of a window of `length` bytes at p is the
place of the smallest hash (the rightmost of equal ones) of GRAM bytes among the first `width` places, width =
(length - GRAM) / 4 (with two refinements). Equal windows have their anchors at the same offset, so a window is
repeated only if its anchor's suffix is in a bucket with another. About 2 of `width`
bytes are anchors, and each has the run of windows it is the anchor of. What anchors follow an
anchor within `width` bytes is decided by the next 2 * width + GRAM bytes.

1. First buckets: the first width + GRAM bytes of each anchor's suffix. Two
   refinements by (own bucket, distance to the last anchor within width bytes, its bucket) reach
   width bytes further each, never beyond the shortest window of an anchor. An anchor
   alone in its bucket leaves, with all its windows.
2. The last refinement takes the whole context of an anchor, from the first byte of its first window to the
   last of its last. An anchor that shares it is closed: all its windows are repeated.
3. The others are open; they stand where a repeated passage begins or ends. Their windows, and those of one closed
   anchor of each context in the same buckets, get buckets of their own.

Buckets are found by sorting identifiers in tasks that share them by hash; an identifier is the rank in its task.
First bytes, contexts and windows are told apart by hashes (64 bits in step 1, which only
parts what differs; 128 bits in 2 and 3, which decide).

Scale. State is packed by segment, the texts of a task of about SEGMENT_BYTES. A segment sends an
identifier once, with a mark if it holds it twice, so a bucket with a third of all suffixes costs one
entry a segment, and no bucket is ever in one task as members. What is sent, is about 2 /
width of the text's bytes, 8 bytes each, then 16 bytes for the windows at the ends of passages.

Defined cases: a null text is empty; a text of fewer than `length` bytes has no window; matches never cross texts;
rows that repeat an id with other texts are told apart by SHA-256 of the text, and equal rows
repeat each other; a null id is a value of its own; an empty table gives an empty result; texts
are read whole, however long; the kept bytes may end within a character, so they are binary; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, _power_tables, drop_table, extended, mix64, row_ranges, small_or_whole, stored_table, text_buffers

LENGTH = 400
GRAM = 16
SEGMENT_BYTES = 1 << 23
#: Bytes of texts that are hashed at once; a Python worker keeps two numbers of 8 bytes for each of them.
CHUNK = 1 << 20
PART_KEYS = 1 << 19
REFINEMENTS = 2
#: Marks of an identifier: it is in two places at least; it is asked for by an open anchor; this segment is the first that has it.
TWICE, OPEN, FIRST = 1, 2, 4
_draw = np.random.default_rng(20050401)
BYTE_VALUES = _draw.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Hashes:
    """Hashes of any substring of data, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _power_tables(len(data) + 1)
        self.data, self.sums = data, {}

    def of(self, low: np.ndarray, high: np.ndarray, kind: int = 0) -> np.ndarray:
        if kind not in self.sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[kind][self.data] * self.up[: len(self.data)], out=sums[1:])
            self.sums[kind] = sums
        sums = self.sums[kind]
        return mix64((sums[high] - sums[low]) * self.down[low] + (high - low).astype(np.uint64) * GOLDEN)

    def grams(self) -> np.ndarray:
        """Hash of the GRAM bytes at each place; places beyond the end are missing."""
        self.of(np.zeros(1, np.int64), np.zeros(1, np.int64))
        sums = self.sums[0]
        n = max(0, len(self.data) - GRAM + 1)
        return mix64((sums[GRAM:] - sums[:n]) * self.down[:n]) if n else np.zeros(0, np.uint64)

    def names(self, low: np.ndarray, high: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """128 bits for each substring and the numbers that go with it."""
        out = np.empty((len(low), 2), np.uint64)
        for kind in range(2):
            value = self.of(low, high, kind)
            for number in more:
                value = mix64(value * GOLDEN + number.astype(np.uint64) + np.uint64(1))
            out[:, kind] = value
        return out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each width keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """row, place in its text, first and last window (places in the text; first > last: none), first bucket and name of the context of each anchor."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)]
    if len(data) < width + GRAM:
        return tuple(none)
    made = Hashes(data)
    bits = np.uint64(int(len(data)).bit_length())
    grams = made.grams()
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = (grams >> bits << bits) | (mask - np.arange(len(grams), dtype=np.uint64))
    anchor = (mask - (sliding_least(keys, width) & mask)).astype(np.int64)
    sizes = np.diff(offsets)
    # Windows of width places that lie in one text.
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    at = np.arange(len(anchor))
    inside = at + width + GRAM - 1 <= offsets[row + 1]
    at, row, anchor = at[inside], row[inside], anchor[inside]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(at) else np.zeros(0, np.int64)
    if not len(new):
        return tuple(none)
    place, row, low = anchor[new], row[new], at[new]
    high = np.append(at[new[1:] - 1], at[-1])
    end = offsets[row + 1]
    high = np.minimum(high, end - length)
    keep = place + width + GRAM <= end
    place, row, low, high, start = place[keep], row[keep], low[keep], high[keep], offsets[row[keep]]
    bucket = made.of(place, place + width + GRAM)
    context = np.zeros((len(place), 2), np.uint64)
    some = np.flatnonzero(high >= low)
    context[some] = made.names(low[some], high[some] + length, place[some] - low[some], place[some] - high[some])
    return row, place - start, low - start, high - start, bucket, context


def packed(*values: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in values]


def one_row(names: list[str], values: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


ROW_LISTS = "ids array<bigint>, digests array<binary>"
SAMPLES = f"seg long, {ROW_LISTS}, rows binary, places binary, lows binary, highs binary, contexts binary, keys binary"


def samples(texts: DataFrame, length: int, width: int) -> DataFrame:
    """A row for each segment: its texts with anchors (ids, digests) and, packed, the anchors' rows (<u4, places in these lists), places, lows, highs (<u4), contexts (two <u8) and keys (first buckets, <u8)."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), *[pa.binary()] * 6]
    names = ["seg", "ids", "digests", "rows", "places", "lows", "highs", "contexts", "keys"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, digests, size, n = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            row, place, low, high, bucket, context = (np.concatenate(x) for x in zip(*held, strict=True))
            high = np.where(high < low, low - 1, high) + 1  # the end, so that no number is negative
            number = TaskContext.get().partitionId() << 32 | n
            return one_row(names, [number, ids, digests, *packed(row.astype("<u4"), place.astype("<u4"), low.astype("<u4"), high.astype("<u4"), context, bucket)], kinds)

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for low, high in row_ranges(offsets, CHUNK):
                row, *found = anchors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], length, width)
                used, row = np.unique(row, return_inverse=True)
                if len(used):
                    held.append((row + len(ids), *found))
                    some = pa.array(used + low)
                    ids += batch.column(0).take(some).to_pylist()
                    digests += batch.column(1).take(some).to_pylist()
                    size += int(offsets[high] - offsets[low])
                if size >= SEGMENT_BYTES:
                    yield segment()
                    held, ids, digests, size, n = [], [], [], 0, n + 1
        if held:
            yield segment()

    return texts.select("id", "digest", "text").mapInArrow(sample, SAMPLES)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (numbers, or rows of two) in order, the number of each, and the place of each key in them."""
    first = keys if keys.ndim == 1 else keys[:, 0]
    order = np.argsort(first)
    new = np.append(True, first[order[1:]] != first[order[:-1]])[: len(keys)]
    if keys.ndim == 2 and ((keys[order[1:], 1] != keys[order[:-1], 1]) & ~new[1:]).any():
        order = np.lexsort((keys[:, 1], first))
        new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
    at = np.flatnonzero(new)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return keys[order[at]], np.diff(np.append(at, len(keys))), inverse


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Distinct keys, the number of each, the place of each key in them, and (part, first, end) of the keys of each part."""
    distinct, counts, inverse = grouped(keys)
    high = mix64(distinct.copy() if keys.ndim == 1 else distinct[:, 0].copy()) >> np.uint64(32)
    part = (high * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    part = part[order]
    edge = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else []
    return distinct[order], counts[order], place[inverse], [(int(part[a]), int(a), int(b)) for a, b in zip([0, *edge][: len(edge)], edge, strict=True)]


SENT = "seg long, part int, sent binary, marks binary"


def sent(seg: int, keys: np.ndarray, flags: np.ndarray, parts: int) -> pa.RecordBatch:
    """What a segment sends: each key once. flags: TWICE counts a key as two, OPEN asks for it."""
    distinct, counts, place, bounds = dealt(keys, parts)
    marks = np.where(counts > 1, TWICE, 0).astype(np.uint8)
    np.bitwise_or.at(marks, place, flags.astype(np.uint8))
    rows = [(seg, p, distinct[a:b].tobytes(), marks[a:b].tobytes()) for p, a, b in bounds]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["seg", "part", "sent", "marks"])


def exchange(rows: DataFrame, parts: int, wide: bool) -> DataFrame:
    """seg, part, ranks (an identifier above 0 of each key that was sent; none if wide) and marks of all that was sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, keys, marks = [], [], []
        for batch in batches:
            for seg, part, sent_keys, sent_marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads.append((seg, part))
                keys.append(np.frombuffer(sent_keys, "<u8").reshape((-1, 2) if wide else -1))
                marks.append(np.frombuffer(sent_marks, np.uint8))
        if not heads:
            return
        sizes = [len(x) for x in keys]
        owner = np.repeat(np.array([h[0] for h in heads]), sizes)
        distinct, counts, inverse = grouped(np.concatenate(keys))
        every = np.concatenate(marks)
        both = np.zeros(len(distinct), np.uint8)
        np.bitwise_or.at(both, inverse, every)
        both |= np.where(counts > 1, TWICE, 0).astype(np.uint8)
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, owner)
        reply = both[inverse] | np.where(first[inverse] == owner, FIRST, 0).astype(np.uint8)
        ranks = (np.uint64(TaskContext.get().partitionId()) << np.uint64(40)) + inverse.astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(sizes)
        for low in range(0, len(heads), 256):
            some = range(low, min(low + 256, len(heads)))
            cut = [(ends[i] - sizes[i], ends[i]) for i in some]
            columns = [[heads[i][0] for i in some], [heads[i][1] for i in some], [b"" if wide else ranks[a:b].tobytes() for a, b in cut], [reply[a:b].tobytes() for a, b in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["seg", "part", "ranks", "marks"])

    return rows.repartition(parts, "part").mapInArrow(count, "seg long, part int, ranks binary, marks binary")


def replies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and marks of all a segment sent, in its order."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "ranks", "marks")), strict=True))
    return np.frombuffer(b"".join(r[1] for r in rows), "<u8"), np.frombuffer(b"".join(r[2] for r in rows), np.uint8)


def array(table: pa.Table, name: str, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_py(), kind)


def later_anchor(rows: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The last anchor of the same text within width bytes of each."""
    at = rows.astype(np.int64) << 40 | places
    return np.searchsorted(at, at + width, "right") - 1


def refined(state: DataFrame, parts: int, width: int, last: bool) -> tuple[DataFrame, str]:
    """state (seg, rows, places, keys) with the keys of the next refinement, 0 for an anchor that is alone in its bucket or has such a one as its later anchor. last: the identifiers themselves."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(keys, "<u8")
                keys = keys[keys > 0]
                yield sent(seg, keys, np.zeros(len(keys), np.uint8), parts)

    def refine(own: pa.Table, answer: pa.Table) -> pa.Table:
        keys, rows, places = array(own, "keys", "<u8"), array(own, "rows"), array(own, "places")
        ranks, marks = replies(answer)
        alive = np.flatnonzero(keys)
        place = dealt(keys[alive], parts)[2]
        bucket = np.zeros(len(keys), np.uint64)
        bucket[alive] = np.where(marks[place] & TWICE, ranks[place], 0) if len(alive) else 0
        if not last:
            later = later_anchor(rows, places, width)
            both = mix64(mix64(bucket * GOLDEN + bucket[later]) + (places[later] - places).astype(np.uint64)) | np.uint64(1)
            bucket = np.where((bucket > 0) & (bucket[later] > 0), both, np.uint64(0))
        return pa.table({"seg": own.column("seg"), "rows": own.column("rows"), "places": own.column("places"), "keys": pa.array([bucket.tobytes()], pa.binary())})

    answers = exchange(state.select("seg", "keys").mapInArrow(send, SENT), parts, False)
    return stored_table(state.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(refine, "seg long, rows binary, places binary, keys binary"))


LIVE = "seg long, rows binary, lows binary, highs binary, contexts binary, keys binary, marks binary"


def live_anchors(all_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Anchors that are not alone in their buckets and have windows, packed as in LIVE; keys are their buckets, marks empty."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, rows, lows, highs, contexts, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, lows, highs, keys = (np.frombuffer(x, k) for x, k in ((rows, "<u4"), (lows, "<u4"), (highs, "<u4"), (keys, "<u8")))
                some = np.flatnonzero((keys > 0) & (highs > lows))
                contexts = np.frombuffer(contexts, "<u8").reshape(-1, 2)
                yield one_row(LIVE_NAMES, [seg, *packed(rows[some], lows[some], highs[some], contexts[some], keys[some]), b""], LIVE_KINDS)

    rows = all_rows.select("seg", "rows", "lows", "highs", "contexts").join(state.select("seg", "keys"), "seg")
    return rows.mapInArrow(take, LIVE)


LIVE_NAMES = ["seg", "rows", "lows", "highs", "contexts", "keys", "marks"]
LIVE_KINDS = [pa.int64(), *[pa.binary()] * 6]


DONE = "seg long, rows binary, lows binary, highs binary, marks binary"


def marked(live: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """live with marks (DONE): TWICE for a closed anchor, FIRST for one that stands for its context, OPEN for one whose bucket has an open anchor. Stored, so that no stage has two Python workers for a core."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, contexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                contexts = np.frombuffer(contexts, "<u8").reshape(-1, 2)
                yield sent(seg, contexts, np.zeros(len(contexts), np.uint8), parts)

    def close(own: pa.Table, answer: pa.Table) -> pa.Table:
        contexts = array(own, "contexts", "<u8").reshape(-1, 2)
        distinct, _, place, _ = dealt(contexts, parts)
        _, marks = replies(answer)
        marks = marks[place]
        lone = np.zeros(len(place), bool)
        lone[np.unique(place, return_index=True)[1]] = True  # of anchors with one context in a segment, one stands for all
        marks = np.where(lone, marks, marks & ~np.uint8(FIRST)).astype(np.uint8)
        return own.set_column(own.schema.get_field_index("marks"), "marks", pa.array([marks.tobytes()], pa.binary()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, keys, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, marks = np.frombuffer(keys, "<u8"), np.frombuffer(marks, np.uint8)
                some = (marks & (TWICE | FIRST)) != TWICE
                yield sent(seg, keys[some], np.where(marks[some] & TWICE, 0, OPEN), parts)

    def answer_open(own: pa.Table, answer: pa.Table) -> pa.Table:
        keys, marks = array(own, "keys", "<u8"), array(own, "marks", "u1").copy()
        some = np.flatnonzero((marks & (TWICE | FIRST)) != TWICE)
        _, found = replies(answer)
        marks[some] |= found[dealt(keys[some], parts)[2]] & np.uint8(OPEN) if len(some) else np.uint8(0)
        return own.select(["seg", "rows", "lows", "highs"]).append_column("marks", pa.array([marks.tobytes()], pa.binary()))

    answers = exchange(live.select("seg", "contexts").mapInArrow(send, SENT), parts, True)
    closed, place = stored_table(live.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(close, LIVE))
    asked = exchange(closed.select("seg", "keys", "marks").mapInArrow(ask, SENT), parts, False)
    done = stored_table(closed.groupBy("seg").cogroup(asked.groupBy("seg")).applyInArrow(answer_open, DONE))
    drop_table(live.sparkSession, place)
    return done


WANTED = "id long, digest binary, closed binary, open binary, partners binary"
PAIR_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def pairs(lows: np.ndarray, highs: np.ndarray) -> bytes:
    """Runs of windows as (first, end), those that meet made one."""
    if not len(lows):
        return b""
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    new = np.append(True, lows[1:] > highs[:-1])
    at = np.flatnonzero(new)
    return np.stack([lows[at], highs[np.append(at[1:] - 1, len(lows) - 1)]], axis=1).astype("<u4").tobytes()


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4").reshape(-1, 2).astype(np.int64)


def wanted_windows(all_rows: DataFrame, live: DataFrame) -> DataFrame:
    """Of each text with live anchors, runs of windows that are repeated (closed), that may be (open), and that stand for others of their buckets (partners)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, digests, rows, lows, highs, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, lows, highs, marks = (np.frombuffer(x, k) for x, k in ((rows, "<u4"), (lows, "<u4"), (highs, "<u4"), (marks, "u1")))
                closed = (marks & TWICE) > 0
                kinds = (closed, ~closed, (marks & (TWICE | FIRST | OPEN)) == TWICE | FIRST | OPEN)
                out = []
                last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) + 1 if len(rows) else []
                for a, b in zip([0, *last][: len(last)], last, strict=True):
                    own = slice(a, b)
                    out.append((ids[rows[a]], digests[rows[a]], *(pairs(lows[own][k[own]], highs[own][k[own]]) for k in kinds)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, PAIR_KINDS, strict=True)], names=["id", "digest", "closed", "open", "partners"])

    rows = all_rows.select("seg", "ids", "digests").join(live.select("seg", "rows", "lows", "highs", "marks"), "seg")
    return rows.select("ids", "digests", "rows", "lows", "highs", "marks").mapInArrow(runs, WANTED)


DENSE = f"seg long, {ROW_LISTS}, closed array<binary>, open array<binary>, partners array<bigint>, keys binary, flags binary"


def places_of(runs: np.ndarray) -> np.ndarray:
    sizes = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(runs) else np.zeros(0, np.int64)


def windows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """A row for each segment: names of the open windows, then of the partners' windows, of each of its texts (partners: how many)."""
    few = small_or_whole(wanted.filter("octet_length(open) > 0 or octet_length(partners) > 0").withColumnsRenamed({"id": "__id", "digest": "__digest"}), 1 << 15)
    rows = texts.join(few, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    names = ["seg", "ids", "digests", "closed", "open", "partners", "keys", "flags"]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3, pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def segment() -> pa.RecordBatch:
            ids, digests, closed, opened, partners, keys, flags = (list(x) for x in zip(*held, strict=True))
            return one_row(names, [TaskContext.get().partitionId() << 32 | n, ids, digests, closed, opened, partners, np.concatenate(keys).tobytes(), np.concatenate(flags).tobytes()], kinds)

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            head = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True))
            for k, (own_id, digest, closed, opened, partners) in enumerate(head):
                made = Hashes(data[offsets[k] : offsets[k + 1]])
                place = [places_of(unpacked(x)) for x in (opened, partners)]
                at = np.concatenate(place)
                held.append((own_id, digest, closed, opened, len(place[1]), made.names(at, at + length), np.repeat(np.array([OPEN, TWICE], np.uint8), [len(x) for x in place])))
                size += len(at) * 16
                if size >= SEGMENT_BYTES // 2:
                    yield segment()
                    held, size, n = [], 0, n + 1
        if held:
            yield segment()

    return rows.select("id", "digest", "text", "closed", "open", "partners").mapInArrow(name, DENSE)


SPANS = "id long, digest binary, runs array<struct<start:bigint,end:bigint>>"


def covered(runs: np.ndarray, length: int) -> list[dict[str, int]]:
    """Bytes covered by runs of windows, as spans."""
    return [{"start": int(a), "end": int(b)} for a, b in unpacked(pairs(runs[:, 0], runs[:, 1] - 1 + length))]


def span_rows(rows: list[tuple]) -> dict[str, pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return {n: pa.array(c, k) for n, c, k in zip(("id", "digest", "runs"), columns, (pa.int64(), pa.binary(), kind), strict=True)}


def decided(dense: DataFrame, parts: int, length: int) -> DataFrame:
    """SPANS of the texts with open windows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, keys, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield sent(seg, np.frombuffer(keys, "<u8").reshape(-1, 2), np.frombuffer(flags, np.uint8), parts)

    def spans(own: pa.Table, answer: pa.Table) -> pa.Table:
        keys = array(own, "keys", "<u8").reshape(-1, 2)
        repeated = (replies(answer)[1][dealt(keys, parts)[2]] & TWICE) > 0
        out, at = [], 0
        for own_id, digest, closed, opened, partners in zip(*(own.column(c)[0].as_py() for c in ("ids", "digests", "closed", "open", "partners")), strict=True):
            places = places_of(unpacked(opened))
            hit = places[repeated[at : at + len(places)]]
            at += len(places) + partners
            if len(places):
                out.append((own_id, digest, covered(np.concatenate((unpacked(closed), np.stack([hit, hit + 1], axis=1))), length)))
        return pa.table(span_rows(out))

    answers = exchange(dense.select("seg", "keys", "flags").mapInArrow(send, SENT), parts, True)
    return dense.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(spans, SPANS)


def settled(wanted: DataFrame, length: int) -> DataFrame:
    """SPANS of the texts with closed windows and no open ones."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, d, covered(unpacked(c), length)) for i, d, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pydict(span_rows(rows))

    return wanted.filter("octet_length(open) = 0 and octet_length(closed) > 0").select("id", "digest", "closed").mapInArrow(spans, SPANS)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def cut(rows: DataFrame) -> DataFrame:
    """rows with the bytes of their text (text) outside their spans as kept."""
    schema = extended(rows.drop("text"), "kept binary")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            data, offsets = text_buffers(batch.column(place))
            out = []
            for k, runs in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                low, high = offsets[k], offsets[k + 1]
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), int(high - low)]
                out.append(b"".join(data[low + a : low + b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [batch.column(i) for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*(f.name for f in batch.schema if f.name != "text"), "kept"])

    return rows.mapInArrow(keep, schema)


def repeated_spans(df: DataFrame, id_col: str, text_col: str, *keep: Column, length: int = LENGTH, refinements: int = REFINEMENTS) -> DataFrame:
    """One row for each row: id, keep's columns, n_bytes, n_removed, spans (start, end: the bytes covered by repeated strings, in order, apart) and kept (the other bytes)."""
    spark, width = df.sparkSession, (length - GRAM) // (refinements + 2)  # so that the last bucket stays within all windows of an anchor
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_rows, rows_at = stored_table(samples(texts.filter(F.octet_length("text") >= length), length, width))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (all_rows.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // (8 * PART_KEYS) + 1)
    state, places = all_rows.select("seg", "rows", "places", "keys"), []
    for level in range(refinements + 1):
        state, place = refined(state, parts, width, level == refinements)
        places.append(place)
    live, live_at = stored_table(live_anchors(all_rows, state))
    for place in places:
        drop_table(spark, place)
    done, done_at = marked(live, parts)
    drop_table(spark, live_at)
    wanted, wanted_at = stored_table(wanted_windows(all_rows, done))
    for place in (rows_at, done_at):
        drop_table(spark, place)
    dense, dense_at = stored_table(windows(texts, wanted, length))
    parts = max(parts, (dense.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // (16 * PART_KEYS) + 1)
    found, found_at = stored_table(settled(wanted, length).unionByName(decided(dense, parts, length)))
    for place in (wanted_at, dense_at):
        drop_table(spark, place)
    found = found.withColumnsRenamed({"id": "__id", "digest": "__digest"}).dropDuplicates(["__id", "__digest"])
    rows = df.select(F.col(id_col), *keep, F.col(id_col).cast("long").alias("__own"), text_digest(F.col(text_col)).alias("__mark"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    joined = rows.join(found, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__digest")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.coalesce("runs", none)
    joined = joined.select(*rows.columns[:-3], F.octet_length("__text").cast("long").alias("n_bytes"), F.col("__text").alias("text"), spans.alias("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return cut(joined).withColumn("n_removed", removed)
