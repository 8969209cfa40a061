"""Order-preserving packing of tokenised documents into sequences.

Documents are put in the order of their ids (a range partitioning, then a sort
within each partition) and their token streams are laid end to end. A dynamic
programme chooses where to cut the stream into windows of at most max_tokens:
at the end of a document (free), at the end of a sentence (a small penalty for
truncating the document), or, in sentences longer than MAX_GAP, at fixed
places (a larger penalty). The cost of a window is its padding, which is zero
at a listed short length, plus the penalty of its last cut.

best[j] = min over i of best[i] + (max_tokens - (pos[j] - pos[i])) + penalty[j]
has a window of admissible i that only moves forward and a cost that is a sum
of a term of i and a term of j, so a monotone queue gives each minimum in constant time
on average. The few short lengths are looked up directly. A partition is read as a stream: the
programme runs over blocks of about block_tokens, and the tokens of a block's
last windows are carried into the next block, so memory does not grow with
a partition; only the last window of a partition is short for want of tokens.

Defined cases: a null text is empty and has only the end token; repeated ids
are documents of their own, next to each other; a text of any length, and a run of white space of any length in it, is cut as
often as needed; extra columns are ignored; an empty table packs into no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import extended

#: The pre-tokeniser's pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the pattern would have to backtrack over. (Python counts four control characters as white space that Unicode does not.)
LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{1000,}")
SHORT_LENGTHS = (256, 512, 1024)
SENTENCE_PENALTY, HARD_PENALTY = 4, 64
MAX_GAP = 512
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as the characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level BPE from a tokenizers file. Ids of the vocabulary are merge ranks in such files; texts of added tokens are those tokens."""

    def __init__(self, blob: bytes):
        import tiktoken

        spec, alphabet = json.loads(blob), byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.whole = tiktoken.Encoding("one-piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.special = set(added)
        ends = [i for token, i in ranks.items() if b"\n" in token or token.rstrip()[-1:] in (b".", b"!", b"?")]
        self.sentence_end = np.zeros(max([*ranks.values(), *added.values(), 1]) + 1, bool)
        self.sentence_end[ends] = True

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A long run of white space is taken out first: it is one piece, without its last character unless the text or a special token ends it."""
        found, at = [], 0
        for run in LONG_RUN.finditer(text):
            low, high = run.span()
            high -= high < len(text) and not text.startswith(tuple(self.special), high)
            found += self.encoding.encode(text[at:low], allowed_special=self.special) + self.whole.encode_ordinary(text[low:high])
            at = high
        return np.array(found + self.encoding.encode(text[at:], allowed_special=self.special), np.uint32)


def cut_windows(pos: np.ndarray, penalty: np.ndarray, most: int, short: tuple[int, ...]) -> list[int]:
    """Indices of the chosen cuts. pos: candidate cuts, ascending from 0, no two further apart than most; the last must be chosen."""
    n, steps = len(pos), []
    exact: dict[int, list[int]] = {}
    for length in short:
        at = np.minimum(np.searchsorted(pos, pos - length), n - 1)
        for j in np.flatnonzero((pos[at] == pos - length) & (pos >= length)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    places, cost = pos.tolist(), penalty.tolist()
    best, source = [0] * n, [0] * n
    queue = deque([0])  # indices i of rising best[i] + pos[i]
    keys = [0] * n
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - most:
            queue.popleft()
        i = queue[0]
        value = keys[i] + most - p
        if j in exact:
            for k in exact[j]:
                if best[k] < value:
                    value, i = best[k], k
        value += cost[j]
        best[j], source[j] = value, i
        key = keys[j] = value + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = n - 1
    while j:
        steps.append(j)
        j = source[j]
    return steps[::-1]


class Packer:
    """The stream of one partition: add() documents, take pieces."""

    def __init__(self, tokenizer: ByteTokenizer, most: int, end_id: int, block: int, first_sequence: int):
        self.tokenizer, self.most, self.end_id, self.block, self.sequence = tokenizer, most, end_id, block, first_sequence
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # row, ids not yet packed, tokens packed before, tokens in all
        self.waiting = 0

    def add(self, row: object, text: str) -> Iterator[tuple]:
        ids = np.append(self.tokenizer.encode(text), np.uint32(self.end_id))
        self.docs.append((row, ids, 0, len(ids)))
        self.waiting += len(ids)
        while self.waiting >= self.block:
            before = self.waiting
            yield from self.pack(False)
            if self.waiting == before:
                break

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        stream = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        price = np.full(len(stream) + 1, -1, np.int64)
        price[np.flatnonzero(self.tokenizer.sentence_end[stream]) + 1] = SENTENCE_PENALTY
        price[ends] = 0
        price[0] = 0
        price[-1] = max(price[-1], 0)
        known = np.flatnonzero(price >= 0)
        gaps = np.flatnonzero(np.diff(known) > MAX_GAP)
        for a, b in zip(known[gaps].tolist(), known[gaps + 1].tolist(), strict=True):
            price[a + MAX_GAP : b : MAX_GAP] = HARD_PENALTY
        pos = np.flatnonzero(price >= 0)
        cuts = pos[cut_windows(pos, price[pos], self.most, SHORT_LENGTHS)].tolist()
        if not last:  # the last windows may be better once more tokens are known
            keep = [c for c in cuts if c <= len(stream) - 4 * self.most]
            cuts = keep
        row = at = 0
        begin = 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc, ids, packed, total = self.docs[row]
                low, high = begin - at, min(cut, int(ends[row])) - at
                piece = ids[low:high]
                yield doc, packed + low, high - low, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset
                offset, begin = offset + high - low, at + high
                if begin == ends[row]:
                    at, row = int(ends[row]), row + 1
            self.sequence += 1
        rest = self.docs[row:]
        if rest and begin > at:
            doc, ids, packed, total = rest[0]
            rest[0] = doc, ids[begin - at :], packed + begin - at, total
        self.docs, self.waiting = rest, len(stream) - begin


_tokenizers: dict[int, ByteTokenizer] = {}


def tokenizer_of(blob: bytes) -> ByteTokenizer:
    """The tokenizer, kept for the worker's next tasks."""
    if (key := hash(blob)) not in _tokenizers:
        _tokenizers[key] = ByteTokenizer(blob)
    return _tokenizers[key]


def pack(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, max_tokens: int = 2048, end_id: int = 1, block_tokens: int = 1 << 19) -> DataFrame:
    """One row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer_path, "rb") as file:  # the driver reads it; executors get its bytes
        blob = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, F.xxhash64("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out, kind = Packer(tokenizer_of(blob.value), max_tokens, end_id, block_tokens, TaskContext.get().partitionId() << 32), [], None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out += packer.add(key, text.as_py())
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        out += packer.pack(True)
        if out:
            yield batch(out)

    return rows.mapInArrow(run, extended(rows.select(id_col), PIECES))
