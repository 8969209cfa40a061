"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Fixed odd constants of the mixers below (64-bit golden ratio and the finaliser of MurmurHash3).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x2545F4914F6CDD1D
MOST_BROADCAST = 1 << 17


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoints and tables go to the folder that the cluster names in spark.checkpoint.dir. Where none is named, a local session (tests) gets a temporary one; on a cluster, a folder of one machine would be lost with it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table into the checkpoint folder and read again, and its place for drop_table(). Smaller than a checkpoint, and columns are read one by one."""
    place = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def drop_table(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_whole(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df to be broadcast if it has so many rows (of few columns) at most, else as it is, for a shuffled join. df is counted, so it should be cut off before."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The columns of df, then those of the DDL."""
    return T.StructType([*df.schema.fields, *T.DataType.fromDDL(ddl).fields])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hash_share(doc_id: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and each row's offset, without a Python string for each row."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_ranges(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most most_bytes each; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most_bytes, "right")) - 1)
        yield low, high
        low = high


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE_TABLE = byte_set(WHITE_SPACE)


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE_TABLE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hash and first byte of each word (maximal run of bytes outside breaks), and the index of each row's first word.

    With prefixes, also a column of hashes for each of these lengths in bytes, 0 where
    the word is shorter. A word never spans two rows. All rows are handled at once: the hash is a
    difference of prefix sums of a polynomial modulo 2**64, then mixed.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), *([np.zeros((0, len(prefixes)), np.uint64)] if prefixes else [])
    inside = ~breaks[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | first[1:])) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])

    def hashes(ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)

    found = hashes(ends), starts, np.searchsorted(starts, offsets)
    if not prefixes:
        return found
    return *found, np.stack([np.where(starts + k <= ends, hashes(np.minimum(starts + k, n)), np.uint64(0)) for k in prefixes], axis=1)


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words in each row, and the bounds of each row's windows; a row of fewer words (not none) has one window of all of them."""
    n = np.diff(bounds)
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out = np.concatenate(([0], np.cumsum(counts)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    begin = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], counts)
    length = np.repeat(np.minimum(n, size), counts)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    total = np.zeros(len(begin), np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * BASE % (1 << 64)
        part = mix64(padded[begin + k]) * np.uint64(factor)
        total += part if not (length <= k).any() else np.where(length > k, part, np.uint64(0))
    return mix64(total + length.astype(np.uint64)), out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty segments give 0."""
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return sums[bounds[1:]] - sums[bounds[:-1]]
