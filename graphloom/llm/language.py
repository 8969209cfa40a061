"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each of its
slots is a bit mask over the languages, and the AND of the slots that an
n-gram hashes to is the mask of all languages that (seem to) contain it. A
text's n-grams are looked up at once; the popcount of each language's bit,
corrected for the share of false positives that the filter's fill gives that
language, decides.

Learning: the filter is fitted on about per_language (2,000) labelled texts of
each language, chosen by a hash of their ids. An n-gram enters a language's slice if
it makes up min_share (1e-5) or more of that language's n-grams, so a slice
holds at most 1 / min_share n-grams whatever the input. A mask has as many words of 64 bits as
the languages need.

Defined cases: a null text, or one without a letter, is "und" with score 0; so
is every text if nothing could be learned. Ties go to the first language by name. Texts are
read whole; n-grams that a language's sample has once are left out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, extended, hash_share, mix64, row_ranges, segment_sums, text_buffers

CHUNK = 1 << 20
N_GRAM = 4
PROBES = 4
#: ASCII characters other than letters count as a blank, so digits and marks say nothing.
FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's byte n-grams as integers, and their bounds."""
    counts = np.maximum(np.diff(offsets) - N_GRAM + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if not bounds[-1]:
        return np.zeros(0, np.uint32), bounds
    folded = FOLD[data].astype(np.uint32)
    n = len(folded) - N_GRAM + 1
    every = sum(folded[k : n + k] << np.uint32(8 * k) for k in range(N_GRAM))
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    return every[at], bounds


def slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(gram.astype(np.uint64) * GOLDEN)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(PROBES)]


class LanguageFilter:
    """The bit-sliced filter of all languages, and each language's share of false positives."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.names = sorted(by_language)
        most = max((len(x) for x in by_language.values()), default=0)
        self.bits = max(10, int(np.ceil(np.log2(12 * max(1, most)))))
        self.words = [self.names[i : i + 64] for i in range(0, len(self.names), 64)]
        self.tables, false = [], []
        for names in self.words:
            kind = np.dtype(f"uint{max(8, 1 << (len(names) - 1).bit_length())}")
            table = np.zeros(1 << self.bits, kind)
            for i, name in enumerate(names):
                for slot in slots(by_language[name], self.bits):
                    table[slot] |= kind.type(1 << i)
            false += [float(((table >> kind.type(i)) & kind.type(1)).mean()) ** PROBES for i in range(len(names))]
            self.tables.append(table)
        self.false_share = np.array(false)

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """For each word of the mask, the languages that seem to contain each n-gram."""
        at = slots(gram, self.bits)
        return [np.bitwise_and.reduce([table[slot] for slot in at]) for table in self.tables]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row and language the corrected share of n-grams found."""
        gram, bounds = grams(data, offsets)
        n = np.diff(bounds).astype(np.float64)
        out = np.zeros((len(n), len(self.names)))
        for word, mask in enumerate(self.masks(gram)):
            kind = mask.dtype.type
            for i in range(len(self.words[word])):
                hit = segment_sums(((mask >> kind(i)) & kind(1)).astype(np.int64), bounds)
                false = self.false_share[64 * word + i]
                out[:, 64 * word + i] = np.maximum(hit - n * false, 0) / (1 - min(false, 0.999)) / np.maximum(n, 1)
        return out


def learn_filter(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 2000, min_share: float = 1e-5) -> LanguageFilter:
    """labelled: the rows to learn from, with text and language."""
    labelled = labelled.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return LanguageFilter({})
    share = F.create_map(*[x for name, n in rows.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            data, offsets = text_buffers(batch.column(0))
            for low, high in row_ranges(offsets, CHUNK):
                gram, bounds = grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                owner = np.repeat(names[low:high], np.diff(bounds))
                for name in set(names[low:high]):
                    found, n = np.unique(gram[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = labelled.filter(hash_share(F.col("id"), 5) < share[F.col("lang")]).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counted.join(F.broadcast(totals), "lang").filter((F.col("n") >= min_share * F.col("total")) & (F.col("n") > 1)).select("lang", "gram").toPandas()  # one row a language is sent
    return LanguageFilter({name: kept.gram[kept.lang == name].to_numpy(np.int64) for name in rows})


def identify(df: DataFrame, model: LanguageFilter, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """The id, keep's columns, lang_pred and score of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col), *keep, F.lower(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.names, "und"])
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 2))
            best, score = np.full(batch.num_rows, len(model.names)), np.zeros(batch.num_rows)
            if model.names:
                for low, high in row_ranges(offsets, CHUNK):
                    share = model.counts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    best[low:high], score[low:high] = share.argmax(axis=1), share.max(axis=1)
                letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                best[~letter], score[~letter] = len(model.names), 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return rows.mapInArrow(predict, extended(rows.drop("__text", "__letter"), "lang_pred string, score double"))
