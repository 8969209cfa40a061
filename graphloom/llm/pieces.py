"""SentencePiece encoding and decoding with exact source offsets.

Text is normalised by the longest prefix that the model's compiled character
map knows, recording for each normalised character the source bytes it came
from. Byte-pair merges run inside units that no piece can cross (a run of the
space mark and what follows up to the next mark); a unit's pieces are kept in a
bounded cache. The short units of a batch that are not in it are merged together,
one pair of each at a time, over arrays of symbol numbers. Piece lengths are then projected through the alignment, so each
piece has a span of bytes in the original text. Where the character map is
empty, normalised and source bytes differ only by the space mark, and the
alignment is arithmetic over whole arrays.

Defined cases: a null text counts as empty and has no pieces; every byte of a
text is covered; characters outside the vocabulary become byte pieces, or the
unknown piece where the model has none; equal texts give equal pieces; extra
columns are ignored. Models other than byte-pair ones, and models with
user-defined pieces, raise an error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import extended

MARK = "▁"
#: Piece types in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = float("-inf")
#: Units of at most so many characters are merged with others; characters of the texts whose units are learnt together; units merged at once.
SHORT_UNIT, MERGED_CHARS, MERGED_UNITS = 48, 1 << 20, 1 << 16
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class CharacterMap:
    """A compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of source from at on."""
        if not self.units:
            return None
        units, found = self.units, None
        here = units[0] >> 10 << ((units[0] >> 6) & 8)
        for i in range(at, len(source)):
            here ^= source[i]
            if here >= len(units) or units[here] & 0x800000FF != source[i]:
                break
            unit = units[here]
            here ^= unit >> 10 << ((unit >> 6) & 8)
            if unit >> 8 & 1:
                found = i + 1 - at, units[here] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class PairTable:
    """Symbols (0: a character that no piece holds; then such characters and the pieces) and, for two of them that make a piece, that piece and its rank by score."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        characters = sorted({c for p in scores for c in p} - scores.keys())
        self.names = ["", *characters, *scores]
        symbols = {name: s for s, name in enumerate(self.names)}
        self.ids = np.array([ids.get(name, -1) for name in self.names], np.int32)
        self.sizes = np.array([len(name.encode("utf-8", "surrogatepass")) for name in self.names], np.int32)
        self.characters = np.zeros(0x110000, np.int32)
        for name, s in symbols.items():
            if len(name) == 1:
                self.characters[ord(name)] = s
        ranks = {x: r for r, x in enumerate(sorted(set(scores.values())))}
        self.ranks = np.array([ranks[scores[name]] if name in scores else -1 for name in self.names], np.int64)
        found = [(symbols[a] * len(self.names) + symbols[b], symbols[p]) for p in scores for cut in range(1, len(p)) if (a := p[:cut]) in symbols and (b := p[cut:]) in symbols]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        # Open addressing: a key lies at the first free slot from its hash on.
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, symbol, slot = pairs[:, 0], pairs[:, 1], self.slots(pairs[:, 0])
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            left = self.keys[slot] != key  # of several at one slot the last stays
            self.made[slot[~left]] = symbol[~left]
            key, symbol, slot = key[left], symbol[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that pairs make, or -1."""
        keys = left.astype(np.int64) * len(self.names) + right
        slot = self.slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.made[slot], -1)
        look = np.flatnonzero((held != keys) & (held >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[look]]
            hit = held == keys[look]
            out[look[hit]] = self.made[slot[look[hit]]]
            look = look[~hit & (held >= 0)]
        return out

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As PieceModel.merge, for all units at once: their symbols one after another, and how many each unit has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.characters[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        unit, done = np.arange(len(units)), []
        made = np.full(len(symbols), -1, np.int32)
        made[:-1] = self.joined(symbols[:-1], symbols[1:])
        made[np.cumsum(sizes) - 1] = -1
        while len(unit):
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(symbols))
            worth = np.where(made >= 0, (self.ranks[made] << 32) - place, -1 << 62)
            best = np.maximum.reduceat(worth, starts)
            on = best > -1 << 61
            if not on.all():
                rest = np.repeat(on, sizes)
                done.append((unit[~on], sizes[~on], symbols[~rest]))
                unit, sizes, symbols, made, worth = unit[on], sizes[on], symbols[rest], made[rest], worth[rest]
                starts = np.cumsum(sizes) - sizes
                if not len(unit):
                    break
            at = np.flatnonzero(worth == np.repeat(best[on], sizes))  # places differ, so there is one in each unit
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            ends = np.zeros(len(symbols), bool)
            ends[starts + sizes - 1] = True
            ends[at] = ends[at + 1]
            symbols, made, ends = symbols[stay], made[stay], ends[stay]
            sizes = sizes - 1
            at = at - np.arange(len(at))
            first = np.cumsum(sizes) - sizes
            right, left = at[~ends[at]], at[at > first] - 1
            made[at] = -1
            made[right] = self.joined(symbols[right], symbols[right + 1])
            made[left] = self.joined(symbols[left], symbols[left + 1])
        owner = np.concatenate([np.repeat(u, n) for u, n, _ in done])
        counts = np.zeros(len(units), np.int64)
        for u, n, _ in done:
            counts[u] = n
        return np.concatenate([x for _, _, x in done])[np.argsort(owner, kind="stable")], counts


class PieceModel:
    def __init__(self, blob: bytes, cache_size: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != 2 or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("only byte-pair models without user-defined pieces")
        spec = model.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.names = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.whole = any(MARK in name.lstrip(MARK) for name in self.ids)  # pieces cross units
        self.raw = [bytes([int(n[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else n.replace(MARK, " ").encode() for n, t in zip(self.names, self.types, strict=True)]
        self.cache: dict[str, tuple[bytes, bytes, int]] = {}
        self.cache_size = cache_size
        self.pairs: PairTable | None = None

    def merge(self, unit: str) -> list[str]:
        """Merge the adjacent pair of the highest score, the leftmost of equals, until none is a piece."""
        score, parts = self.scores.get, list(unit)
        worth = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while worth:
            best = max(worth)
            if best == NEVER:
                break
            at = worth.index(best)
            parts[at] += parts.pop(at + 1)
            del worth[at]
            if at < len(worth):
                worth[at] = score(parts[at] + parts[at + 1], NEVER)
            if at:
                worth[at - 1] = score(parts[at - 1] + parts[at], NEVER)
        return parts

    def merge_long(self, unit: str) -> list[str]:
        """As merge, in n log n steps, for units of many characters."""
        from heapq import heapify, heappop, heappush

        scores, parts = self.scores, list(unit)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(-scores[p], i, p) for i, p in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if p in scores]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (p := pair + parts[after[i]]) in scores:
                    heappush(heap, (-scores[p], i, p))
            if before[i] >= 0 and (p := parts[before[i]] + pair) in scores:
                heappush(heap, (-scores[p], before[i], p))
        return [p for p in parts if p]

    def unit(self, unit: str) -> tuple[bytes, bytes, int]:
        """Ids and byte lengths of a unit's pieces as packed 32-bit integers."""
        ids, sizes = [], []
        for part in self.merge(unit) if len(unit) <= SHORT_UNIT else self.merge_long(unit):
            if (i := self.ids.get(part)) is not None:
                ids.append(i)
                sizes.append(len(part.encode()))
            elif self.bytes:
                for byte in part.encode():
                    ids.append(self.bytes[byte])
                    sizes.append(1)
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(part.encode())
            else:
                ids.append(self.unknown)
                sizes.append(len(part.encode()))
        found = struct.pack(f"<{len(ids)}i", *ids), struct.pack(f"<{len(ids)}i", *sizes), len(ids)
        if len(self.cache) >= self.cache_size:
            self.cache.clear()
        self.cache[unit] = found
        return found

    def learn(self, units: Iterable[str]) -> None:
        """Puts short units that are not in the cache there, as far as it has room. Those with a character that is no piece are left to unit()."""
        every = {u for u in set(units) if len(u) <= SHORT_UNIT}
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > self.cache_size:
            self.cache.clear()
            new = every
        new = list(new)[: self.cache_size]
        for at in range(0, len(new), MERGED_UNITS):
            self.learn_part(new[at : at + MERGED_UNITS])

    def learn_part(self, new: list[str]) -> None:
        self.pairs = self.pairs or PairTable(self.scores, self.ids)
        symbols, counts = self.pairs.merge(new)
        ids, sizes = self.pairs.ids[symbols], self.pairs.sizes[symbols]
        ends = np.cumsum(counts)
        known = np.minimum.reduceat(ids, ends - counts) >= 0
        ids, sizes = ids.astype("<i4").tobytes(), sizes.astype("<i4").tobytes()
        begin = 0
        for u, end, n, whole in zip(new, (4 * ends).tolist(), counts.tolist(), known.tolist(), strict=True):
            if whole:
                self.cache[u] = ids[begin:end], sizes[begin:end], n
            begin = end

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the source byte it stands at."""
        source, out, at_source, at = text.encode(), [], [], 0
        space = MARK.encode() if self.escape else b" "
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                first = source[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = size, source[at : at + size]
            for piece in re.findall(b" |[^ ]+", hit[1]):
                out.append(piece)
                at_source.append((at, at + hit[0]))
            at += hit[0]
        if self.squeeze:
            keep = [i for i, x in enumerate(out) if x != b" " or (i and out[i - 1] != b" ")]
            out, at_source = [out[i] for i in keep], [at_source[i] for i in keep]
            while out and (out[-1] == b" " or out[-1].endswith(space)):  # a space mark of the text's own counts at the end only
                out[-1] = out[-1].removesuffix(space) if out[-1] != b" " else b""
                if not out[-1]:
                    out.pop(), at_source.pop()
        spans = [(space if x == b" " else x, s) for x, s in zip(out, at_source, strict=True)]
        if self.prefix and (spans or not self.squeeze):
            begin = spans[0][1][0] if spans else 0
            spans.insert(0, (space, (begin, begin)))
        align = [s[0] for x, s in spans for _ in x] + [len(source)]
        return b"".join(x for x, _ in spans).decode(), np.array(align, np.int64)

    def units(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """The units of a text that is not empty, and its alignment, or None if it is plain_alignment()."""
        if not self.map.units and self.prefix and self.escape and not self.squeeze and not self.whole:
            if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                return UNIT.findall(MARK + text.replace(" ", MARK)), None
            return (MARK + text.replace(" ", f" {MARK}")).split(" "), None
        normal, align = self.normalise(text)
        return [normal] if self.whole and normal else UNIT.findall(normal), align

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte spans in the original text of all pieces."""
        return self.encode_units(text, *self.units(text)) if text else self.encode_units(text, [], None)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As encode, of each text; the units of some texts are merged together."""
        first = 0
        while first < len(texts):
            end, chars = first, 0
            while end < len(texts) and (end == first or chars + len(texts[end]) <= MERGED_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.units(t) if t else ([], None) for t in texts[first:end]]
            self.learn(chain.from_iterable(units for units, _ in split))
            for text, (units, align) in zip(texts[first:end], split, strict=True):
                yield self.encode_units(text, units, align)
            first = end

    def encode_units(self, text: str, units: list[str], align: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not text:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        cache = self.cache
        found = [cache.get(u) or self.unit(u) for u in units]
        ids = np.frombuffer(b"".join([x[0] for x in found]), "<i4")
        ends = np.cumsum(np.frombuffer(b"".join([x[1] for x in found]), "<i4"), dtype=np.int64)
        if align is None:
            align = self.plain_alignment(text)
        ends = align[ends]
        starts = np.concatenate((align[:1], ends[:-1]))
        return ids, starts.astype(np.int32), ends.astype(np.int32)

    @staticmethod
    def plain_alignment(text: str) -> np.ndarray:
        """Alignment where only spaces grow, by two bytes each, and a mark stands in front."""
        source = np.frombuffer(text.encode(), np.uint8)
        width = np.where(source == 32, 3, 1)
        return np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(source)), width), [len(source)]))

    def decode(self, ids: list[int]) -> str:
        """Text of the pieces; bytes that are no UTF-8 become U+FFFD each, and the space that the dummy prefix made goes."""
        joined = b"".join(map(self.raw.__getitem__, ids))  # a control piece has no bytes
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if first is not None and self.prefix and self.names[first].startswith(MARK):
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


_models: dict[int, PieceModel] = {}


def model_of(blob: bytes) -> PieceModel:
    """The model, kept with its cache for the worker's next tasks."""
    if (key := hash(blob)) not in _models:
        _models.clear()
        _models[key] = PieceModel(blob)
    return _models[key]


def encode_documents(df: DataFrame, model_path: str, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """The id, keep's columns, ids, starts and ends (bytes of the original text, end exclusive) of all pieces, and the decoded text."""
    with open(model_path, "rb") as file:  # the driver reads it; executors get its bytes
        blob = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = list(model.encode_all(batch.column(batch.num_columns - 1).to_pylist()))
                decoded = [model.decode(ids.tolist()) for ids, _, _ in found]
                bounds = pa.array(np.concatenate(([0], np.cumsum([len(x[0]) for x in found]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([x[k] for x in found]))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists, pa.array(decoded, pa.string())], names=[*batch.schema.names[:-1], "ids", "starts", "ends", "decoded"])

    return rows.mapInArrow(encode, extended(rows.drop("__text"), "ids array<int>, starts array<int>, ends array<int>, decoded string"))
