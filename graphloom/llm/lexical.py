"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

A list is a term's postings. The stored table is partitioned by bucket of terms and
segment (the texts of one task, of about SEGMENT_TERMS postings), so the list of a term that
every text has is spread over many tasks. Weights and scores are computed when a block is read, as they need the
counts over all texts.

1. Each list sends its head, the k best postings. The documents of the heads are looked up,
   and an item's k-th best score is a lower bound tau of its k-th best of all.
2. An item of m lists takes the uniform threshold T = tau div m, and every list
   sends the postings of at least max(T, 1). A document seen in s lists has at most
   its sum + (m - s) * (T - 1); those below tau, or below the k-th best sum of
   the item so far, go. A document sent by no list is below tau.
3. The remaining candidates are looked up in all lists of the item, which gives exact scores.

Scale. Only terms that an item has get postings; items are taken in
waves of about MOST_TERMS terms, and a wave's items, terms and weights alone are broadcast. Postings
travel packed: the sums of phase 2 are made in groups of one item and one segment,
so no group grows with the input. Only the items' terms, their counts and thresholds reach
the driver, a wave's at a time. The lists sent in phase 2 are not cut: the
result is exact.

Score of a document: the sum over the item's terms, once each, of w * ((10**9 * tf) div
(1000 * tf + 8 * M)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and M = 10 + (90 n N) div L;
N counts the documents with a term, L all terms with repeats, n one document's. Terms
are maximal runs of digits, letters and characters beyond ASCII, only A to Z
lower-cased; 64-bit integers, div rounds down.

Defined cases: a null text has no terms; a document without a term, or with a score of
0, is in no result; rows that repeat an id are documents of their own, and so are rows
that repeat an item (each has a ranking); equal scores go by ascending id, null ids
last; an item without terms has no rows; empty tables give an empty result; texts are read whole,
however long; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import byte_set, checkpoint, drop_table, row_ranges, stored_table, text_buffers, word_hashes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = byte_set(bytes(c for c in range(128) if not chr(c).isalnum()))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(CAPITALS.encode(), SMALL.encode())), np.uint8)
MOST_TERMS = 1 << 16
SEGMENT_TERMS = 1 << 21
CHUNK = 1 << 22
#: Terms are dealt into so many buckets. A block has a segment's postings of a bucket's terms: the terms, where the postings of each end, and the postings.
BUCKETS = 64
BLOCK = "bucket int, segment long, terms binary, ends binary, refs binary, tf binary, n binary"
PARTS = ("terms", "ends", "refs", "tf", "n")
#: Rows of the same table, for each text: its ref, id and number of terms.
TEXT_ROW = "ref long, id long, size long"


class TermTable:
    """A wave's terms, found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        texts = [t.encode() for t in terms]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes = np.array([word_hashes(data[a:b], np.array([0, b - a]), BREAKS)[0][0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.offsets = hashes[self.order], data, offsets

    def find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in hashes) and terms of all words that are a term of the table."""
        over = np.append(BREAKS[data], True)  # no word goes on here
        over[offsets] = True
        places, terms = [], []
        at = np.searchsorted(self.hashes, hashes)
        left = np.flatnonzero(at < len(self.hashes))
        while len(left):  # more than once only where terms share a hash
            left = left[self.hashes[at[left]] == hashes[left]]
            term = self.order[at[left]]
            size = self.offsets[term + 1] - self.offsets[term]
            for length in np.unique(size):
                some = np.flatnonzero(size == length)
                span = np.arange(length)
                some = some[starts[left[some]] + length <= len(data)]
                same = (data[starts[left[some], None] + span] == self.data[self.offsets[term[some], None] + span]).all(axis=1) & over[starts[left[some]] + length]
                places.append(left[some[same]])
                terms.append(term[some[same]])
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
        return (np.concatenate(places), np.concatenate(terms)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def index(df: DataFrame, id_col: str, text_col: str, table) -> DataFrame:
    """Blocks (columns of BLOCK) and, with a null bucket, the texts (columns of TEXT_ROW). table: a broadcast TermTable."""
    rows = df.select(F.monotonically_increasing_id().alias("ref"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"{BLOCK}, {TEXT_ROW}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        base, count = 0, 0

        def blocks() -> pa.RecordBatch:
            term, ref, tf, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((term, term % BUCKETS))  # refs stay in order
            term, ref, tf, n = term[order], ref[order] - base, tf[order], n[order]
            last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
            bucket = term[last] % BUCKETS
            rows, low = [], 0
            for edge in np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)):
                first = last[low - 1] + 1 if low else 0
                own = slice(first, last[edge] + 1)
                runs = slice(low, edge + 1)
                rows.append((int(bucket[edge]), base, *(x.astype("<u4").tobytes() for x in (term[last[runs]], last[runs] + 1 - first, ref[own], tf[own], n[own]))))
                low = edge + 1
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), pa.int64())] * 3, names=names)

        names = ["bucket", "segment", *PARTS, "ref", "id", "size"]
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            refs = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = []
            for low, high in row_ranges(offsets, CHUNK):
                part = LOWER[data[offsets[low] : offsets[high]]]
                hashes, starts, bounds = word_hashes(part, offsets[low : high + 1] - offsets[low], BREAKS)
                n = np.diff(bounds)
                sizes.append(n)
                places, terms = table.value.find(part, offsets[low : high + 1] - offsets[low], hashes, starts)
                key = (np.searchsorted(bounds, places, "right") - 1) * len(table.value.order) + terms
                key, tf = np.unique(key, return_counts=True)
                row, term = key // max(1, len(table.value.order)), key % max(1, len(table.value.order))
                if not held:
                    base = int(refs[low])
                if len(key):
                    held.append((term, refs[low + row], tf, n[row]))
                    count += len(key)
                if count >= SEGMENT_TERMS:
                    yield blocks()
                    held, count = [], 0
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            empty = [pa.nulls(len(batch), kind) for kind in (pa.int32(), pa.int64(), *[pa.binary()] * 5)]
            yield pa.RecordBatch.from_arrays([*empty, batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=names)
        if held:
            yield blocks()

    return rows.mapInArrow(build, schema)


def runs_of(terms: bytes, ends: bytes, *postings: bytes) -> Iterator[tuple]:
    """term, refs, tf and n of each term of a block."""
    ends, low = np.frombuffer(ends, "<u4"), 0
    postings = [np.frombuffer(x, "<u4") for x in postings]
    for term, high in zip(np.frombuffer(terms, "<u4").tolist(), ends.tolist(), strict=True):
        yield term, *(x[low:high] for x in postings)
        low = high


def frequencies(blocks: DataFrame) -> dict[int, int]:
    """How many texts have each term of the wave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<u4"), pa.int64()), pa.array(np.diff(np.frombuffer(ends, "<u4").astype(np.int64), prepend=0))], names=["term", "df"])

    return {r["term"]: r["df"] for r in blocks.select("terms", "ends").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of the highest score of each key; ties any way."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score")))).filter(F.col("__place") <= k).drop("__place")


def bounds_of(sums: DataFrame, k: int) -> dict[int, int]:
    """For each item with k rows at least, its k-th best score: one number an item of the wave."""
    top = best(sums.select("item", "score"), "item", k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    return {r["item"]: r["least"] for r in top.filter(F.col("n") >= k).collect()}


def look_up(blocks: DataFrame, asked: DataFrame, facts) -> DataFrame:
    """item, ref and exact score of the candidates asked (item, segment, ref). A segment's postings and candidates meet in a task."""
    packed = asked.groupBy("segment", "item").agg(F.sort_array(F.collect_set("ref")).alias("wanted"))  # at most the texts of a segment
    nothing = [F.lit(None).cast("binary").alias(c) for c in PARTS]
    own = blocks.select("segment", F.lit(None).cast("long").alias("item"), *PARTS, F.lit(None).cast("array<long>").alias("wanted"))
    rows = own.unionByName(packed.select("segment", "item", *nothing, "wanted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lists = None, {}
        for batch in batches:
            out = []
            for segment, item, *block, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != current:
                    current, lists = segment, {}
                if item is None:
                    lists |= {term: x for term, *x in runs_of(*block)}
                    continue
                refs = np.array(wanted, np.int64) - segment
                total = np.zeros(len(refs), np.int64)
                for term in facts.value.terms[item]:
                    if term in lists:
                        known, tf, n = lists[term]
                        at = np.minimum(np.searchsorted(known, refs), len(known) - 1)
                        hit = np.flatnonzero(known[at] == refs)
                        total[hit] += facts.value.scores(term, tf[at[hit]], n[at[hit]])
                out.append((np.full(len(refs), item), refs + segment, total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["item", "ref", "score"])

    dealt = rows.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("item"))
    return dealt.select("segment", "item", *PARTS, "wanted").mapInArrow(score, "item long, ref long, score long")


def heads(blocks: DataFrame, facts, k: int) -> DataFrame:
    """term, segment, ref and score of each list's k best postings."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for term, refs, tf, n in runs_of(*block):
                    value = facts.value.scores(term, tf, n)
                    some = np.argpartition(-value, k - 1)[:k] if len(value) > k else np.arange(len(value))
                    some = some[value[some] > 0]
                    out.append((np.full(len(some), term), np.full(len(some), segment), refs[some].astype(np.int64) + segment, value[some]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["term", "segment", "ref", "score"])

    return best(blocks.select("segment", *PARTS).mapInArrow(top, "term long, segment long, ref long, score long"), "term", k)


def candidates(blocks: DataFrame, facts, tau: dict[int, int], k: int) -> DataFrame:
    """item, segment, ref, score (the sum of what the lists sent) and most (the upper bound) of the documents whose upper bound reaches tau and the k-th best sum of their item and segment."""
    bound = blocks.sparkSession.sparkContext.broadcast(tau)

    def threshold(item: int) -> int:
        return max(1, bound.value.get(item, 0) // len(facts.value.terms[item]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: dict[int, list] = {}
                for term, refs, tf, n in runs_of(*block):
                    items = facts.value.items.get(term)
                    if items is None:
                        continue
                    value = facts.value.scores(term, tf, n)
                    order = np.argsort(-value, kind="stable")
                    falling = -value[order]
                    for item in items:
                        some = order[: np.searchsorted(falling, -threshold(item), "right")]
                        if len(some):
                            out.setdefault(item, []).append((refs[some], value[some]))
                columns = [[*out], [segment] * len(out), *([np.concatenate([x[i] for x in own]).astype(kind).tobytes() for own in out.values()] for i, kind in ((0, "<u4"), (1, "<i8")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["item", "segment", "refs", "scores"])

    def prune(item: int, segment: int, parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
        refs = np.frombuffer(b"".join(p[0] for p in parts), "<u4")
        refs, at, seen = np.unique(refs, return_inverse=True, return_counts=True)
        total = np.zeros(len(refs), np.int64)
        np.add.at(total, at, np.frombuffer(b"".join(p[1] for p in parts), "<i8"))
        most = total + (len(facts.value.terms[item]) - seen) * (threshold(item) - 1)
        least = max(bound.value.get(item, 1), int(np.partition(total, -k)[-k]) if len(total) >= k else 1)
        keep = most >= least
        return np.full(keep.sum(), item), np.full(keep.sum(), segment), refs[keep].astype(np.int64) + segment, total[keep], most[keep]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, out = None, [], []

        def rows() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "segment", "ref", "score", "most"])

        for batch in batches:
            for item, segment, refs, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (item, segment) != key:
                    if parts:
                        out.append(prune(*key, parts))
                    key, parts = (item, segment), []
                parts.append((refs, value))
            if sum(len(x[0]) for x in out) > 1 << 16:
                yield rows()
                out = []
        if parts:
            out.append(prune(*key, parts))
        yield rows()

    sent = blocks.select("segment", *PARTS).mapInArrow(send, "item long, segment long, refs binary, scores binary")
    return sent.repartition("item", "segment").sortWithinPartitions("item", "segment").mapInArrow(gather, "item long, segment long, ref long, score long, most long")


class Facts:
    """What all tasks of a wave know: weights of its terms, N and L, the terms of each item and the items of each term. Lists that are empty or weigh nothing are left out."""

    def __init__(self, pairs: list[tuple[int, int]], found: dict[int, int], big_n: int, big_l: int) -> None:
        self.weights = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in found.items()}
        self.big_n, self.big_l = big_n, big_l
        self.terms, self.items = {}, {}
        for item, term in pairs:
            if self.weights.get(term):
                self.terms.setdefault(item, []).append(term)
                self.items.setdefault(term, []).append(item)

    def scores(self, term: int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n.astype(np.int64) * self.big_n) // max(1, self.big_l)
        tf = tf.astype(np.int64)
        return self.weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m))


def search_wave(df: DataFrame, pairs: list[tuple[int, str]], id_col: str, text_col: str, k: int) -> tuple[DataFrame, str]:
    """item, id, ref and score of each item's documents that can be among its k best, and the place of the stored postings. pairs: item and term."""
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    terms = sorted({t for _, t in pairs})
    place = {t: i for i, t in enumerate(terms)}
    stored, where = stored_table(index(df, id_col, text_col, share(TermTable(terms))).repartition("bucket", "segment", "ref"))
    blocks, texts = stored.filter("bucket is not null").select("bucket", "segment", *PARTS), stored.filter("bucket is null").select("ref", "id", "size")
    big_n, big_l = texts.filter("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    known = Facts([(i, place[t]) for i, t in pairs], frequencies(blocks), big_n, big_l)
    facts = share(known)
    wanted = spark.createDataFrame([(t, own) for t, own in known.items.items()], "term long, items array<long>")
    first = heads(blocks, facts, k).join(F.broadcast(wanted), "term").select(F.explode("items").alias("item"), "segment", "ref").distinct()
    tau = bounds_of(look_up(blocks, first, facts), k)
    likely = checkpoint(candidates(blocks, facts, tau, k))
    better = bounds_of(likely, k)
    least = spark.createDataFrame([(i, max(tau.get(i, 0), better.get(i, 0))) for i in known.terms], "item long, least long")
    likely = likely.join(F.broadcast(least), "item").filter(F.col("most") >= F.col("least"))
    return look_up(blocks, likely.select("item", "segment", "ref"), facts).join(texts.select("ref", "id"), "ref"), where


def search(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, k: int = 10) -> DataFrame:
    """The k documents of the highest score above 0 for each row of items: the item's id, rank, the document's id (doc_id) and score."""
    lowered = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), CAPITALS, SMALL)
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
    asked = checkpoint(asked)
    waves = (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // MOST_TERMS + 1
    parts, order = [], Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "ref")
    for wave in range(waves):
        pairs = [(r["item"], t) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(waves)) == wave).select("item", "terms").collect() for t in r["terms"]]
        found, place = search_wave(df, pairs, id_col, text_col, k)
        parts.append(checkpoint(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)))
        drop_table(df.sparkSession, place)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
