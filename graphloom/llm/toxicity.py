"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence from
its words and their prefixes (stems carry the insult in inflected words); the document's score is the noisy-or of its sentences' scores,
1 - prod(1 - p). Only document labels are needed: the gradient of the document
likelihood runs through the noisy-or, so it lands on the sentences that
explain the label, which then can be located.

Learning: about per_label (1,500) labelled documents of each label, chosen by
a hash of their ids, with most_bytes (16 MB) of text a label at most, are turned into word hashes on the executors; the
driver fits one weight for each of 2**HASH_BITS hashes. That bound holds
at any input size. The labels' weights give toxic documents the square root of
their odds among all labelled rows: half-way (in log-odds) between even classes, which would
reject too many clean documents, and the rows' own shares, which would pass too many toxic ones. Scoring covers every document and every sentence.

Defined cases: a text without a word (null, empty, marks only) has score 0 and
no sentences; equal texts have equal scores; with no labelled rows, or only one
label among them, the model is constant (0 for no document toxic, 1 for all);
repeated ids are scored row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import byte_set, extended, hash_share, row_ranges, text_buffers, word_hashes

HASH_BITS = 20
NOTHING = 1 << HASH_BITS  # the bucket of a prefix that a word is too short for
PREFIXES = (4, 5, 6, 7, 8)
CHUNK = 1 << 20
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
NO_WORD = byte_set(bytes(c for c in range(128) if not chr(c).isalnum()))
SENTENCE_END = byte_set(b".!?\n")


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and its prefixes; first word of each sentence with words, plus the end; each row's first sentence, plus the end; first byte of each sentence's first word."""
    hashes, starts, bounds, heads = word_hashes(LOWER[data], offsets, NO_WORD, PREFIXES)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    part = np.cumsum(SENTENCE_END[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = part[1:] != part[:-1]
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    buckets = np.concatenate((hashes[:, None], heads), axis=1)
    buckets = np.where(buckets == 0, NOTHING, (buckets >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return buckets, np.append(first, len(starts)), np.searchsorted(first, bounds), starts[first]


@dataclass
class BagModel:
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        total = np.add.reduceat(self.weights[buckets].sum(axis=1), first[:-1]) if len(first) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def document_scores(self, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Noisy-or of each row's sentences, summed row by row, so that a score depends on its own text only."""
        full, out = np.diff(rows) > 0, np.zeros(len(rows) - 1)
        if full.any():
            out[full] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(scores, 1 - 1e-12)), rows[:-1][full]))
        return out


def fit(buckets: np.ndarray, first: np.ndarray, rows: np.ndarray, label: np.ndarray, prior: float | None = None, rounds: int = 150, rate: float = 0.3, documents: float = 0.3) -> BagModel:
    """Penalised likelihood of the document labels by proximal AdaGrad on the whole sample; prior is the toxic share that the labels are weighed to. Words of fewer than 3 documents are left out; the absolute penalty
    drops a word that does not pull as hard as so many whole toxic documents do."""
    if not len(label) or label.min() == label.max():
        return BagModel(np.zeros(0), 0.0, float(label[0]) if len(label) else 0.0)
    row_of = np.repeat(np.arange(len(rows) - 1, dtype=np.int32), np.diff(rows))
    sentence_of = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    spread = np.zeros(NOTHING + 1, np.int32)
    for low, high in zip(first[rows[:-1]].tolist(), first[rows[1:]].tolist(), strict=True):
        spread[np.unique(buckets[low:high])] += 1
    spread[NOTHING] = 0
    use = spread[buckets] >= 3
    sentence_of = np.repeat(sentence_of, use.sum(axis=1))
    buckets = buckets[use]
    words = np.flatnonzero(spread >= 3)
    place = np.zeros(NOTHING + 1, np.int32)
    place[words] = np.arange(len(words), dtype=np.int32)
    local = place[buckets]
    del buckets, use, place
    weight, bias, square, square_bias = np.zeros(len(words)), -4.0, np.full(len(words), 1e-6), 1e-6
    share = label.mean()
    prior = share if prior is None else prior
    importance = np.where(label == 1, prior / share, (1 - prior) / (1 - share)) / len(label)
    penalty = documents * prior / label.sum()
    for _ in range(rounds):
        total = np.bincount(sentence_of, weight[local], minlength=len(first) - 1) + bias
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        none = np.exp(np.bincount(row_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(label)))
        # d log-likelihood / d score of a sentence: p (1 - P) / P for a toxic document, -p for a clean one.
        pull = np.where(label == 1, none / np.maximum(1 - none, 1e-9), -1.0) * importance
        slope = p * pull[row_of]
        grad = np.bincount(local, slope[sentence_of], minlength=len(words))
        square += grad**2
        step = rate / np.sqrt(square)
        weight += step * grad
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * penalty, 0)
        square_bias += slope.sum() ** 2
        bias += rate * slope.sum() / np.sqrt(square_bias)
    full = np.zeros(NOTHING + 1)
    full[words] = weight
    return BagModel(full, float(bias))


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = 1500, most_bytes: int = 16 << 20) -> BagModel:
    """labels: ids and labels (0 or 1) of the rows to learn from.

    The sample is drawn from the labels alone, so only its few rows are sent to the texts, which stay where they are:
    per_label ids of each label, of which the first by hash are taken whose texts make up most_bytes of each label at
    most (a longer text is passed over). Of rows that repeat an id the text with the smallest hash is learned from.
    """
    labels = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    limit = F.when(F.col("label") == 1, min(1.0, per_label / n.get(1, 1))).otherwise(min(1.0, per_label / n.get(0, 1)))
    sample = labels.filter(hash_share(F.col("__id"), 7) < limit).dropDuplicates(["__id"])
    texts = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    sizes = texts.join(F.broadcast(sample), "__id").groupBy("__id", "label").agg(F.min(F.struct("mark", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("row"))
    rows = sizes.orderBy(F.xxhash64("__id", F.lit(7)), "__id").collect()  # one an id of the sample
    chosen, used = [], {0: 0, 1: 0}
    for r in rows:
        if used[r["label"]] + r["row"]["size"] <= most_bytes:
            used[r["label"]] += r["row"]["size"]
            chosen.append((r["__id"], r["row"]["mark"], r["label"]))
    if not chosen:
        return fit(np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    key = df.schema[id_col].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame(chosen, f"__id {key}, mark long, label int")
    labelled = texts.join(F.broadcast(wanted), ["__id", "mark"]).dropDuplicates(["__id"]).orderBy("__id")  # in one order, so that each run learns the same

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in row_ranges(offsets, CHUNK):
                buckets, first, rows, _ = sentences(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (buckets, first, rows, batch.column(1)[low:high].to_numpy())], names=["buckets", "first", "rows", "label"])

    found = labelled.select("text", "label").mapInArrow(bags, "buckets binary, first binary, rows binary, label binary").collect()
    blocks = [[np.frombuffer(x, "<i4") for x in r] for r in found]
    buckets, first, rows, label = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    words = parts = 0
    for b, f, r, y in blocks:
        b = b.reshape(-1, 1 + len(PREFIXES))
        buckets.append(b), first.append(f[1:].astype(np.int64) + words), rows.append(r[1:].astype(np.int64) + parts), label.append(y)
        words, parts = words + len(b), parts + len(f) - 1
    return fit(*(np.concatenate(x) for x in (buckets, first, rows, label)), prior=1 / (1 + (n.get(0, 0) / max(1, n.get(1, 0))) ** 0.5))


def score(df: DataFrame, model: BagModel, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """The id, keep's columns, score, predicted, and the offending sentences: from the first byte of the sentence's first word to that of the next sentence's, with its score, wherever that is 0.5 or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    offending = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            out, found = np.zeros(batch.num_rows), []
            for low, high in row_ranges(offsets, CHUNK):
                at = offsets[low : high + 1] - offsets[low]
                buckets, first, of_row, begin = sentences(data[offsets[low] : offsets[high]], at)
                p = model.sentence_scores(buckets, first)
                out[low:high] = model.document_scores(p, of_row)
                bad = np.flatnonzero(p >= 0.5)
                row = np.searchsorted(of_row, bad, "right") - 1
                end = np.where(bad + 1 < of_row[row + 1], np.append(begin, 0)[bad + 1], at[row + 1])
                spans = [[] for _ in range(high - low)]
                for r, a, b, s in zip(row.tolist(), (begin[bad] - at[row]).tolist(), (end - at[row]).tolist(), p[bad].tolist(), strict=True):
                    spans[r].append({"start": a, "end": b, "score": s})
                found += spans
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(found, offending)], names=[*batch.schema.names[:-1], "score", "predicted", "offending"])

    return rows.mapInArrow(judge, extended(rows.drop("__text"), "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"))
