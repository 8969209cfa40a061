"""Near-duplicates by improved consistent weighted sampling.

Each text is a weighted set of five-word shingles, its weights tf * idf. A
signature of BANDS * ROWS consistent weighted samples is drawn (Ioffe 2010):
two texts agree in a sample with a probability equal to their weighted Jaccard
similarity. Equal bands put texts into a bucket; at 0.8 a pair shares a bucket
with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9998. Candidates are verified
by the exact weighted Jaccard similarity, and classes are the connected
components of the verified links.

idf. idf = 1 + ln(1 / share) / ln(1 / MIN_SHARE), where share is the part of
all documents that have the shingle, not below MIN_SHARE (0.001): from 1 (in every
document) to 2. Document frequencies are counted exactly over all documents (packed blocks of
hashes, dealt by hash into as many parts as the texts have times PART_BYTES, equal
hashes merged before the shuffle). Only shingles above MIN_SHARE differ from the constant, and of these there are at
most (shingles a document) / MIN_SHARE, however many documents there are; that
table alone is broadcast.

Variates. The gamma and beta variates of a shingle and sample are looked up by two
independent parts of a hash in two tables of TABLE draws, so two shingles share all
of a sample's variates with probability TABLE**-2.

Scale. Texts with the same word sequence (told by a 64-bit hash of it) are one from the start, a
content: one row for each represents its copies. A bucket gives links, not pairs: its members are
grouped by their signatures (single linkage) inside a task, or, beyond MOST_MEMBERS, all linked to the
smallest. Two contents of a candidate component are compared if their signatures agree in
SKETCH (0.55, five standard deviations below the threshold) of the samples, however large the
component is. A component is dealt into blocks of about BLOCK_SHINGLES shingles. First each block
is compared within itself and with block 0. What is then not in the component's largest class is
the rest, and only the rest is compared with all blocks; a task compares only texts not yet
in one class and returns a spanning forest of the links it found.

Defined cases: words are runs without white space (space, tab to carriage
return), as written; texts of fewer than five words have one shingle of all their words; texts of any
length are read whole; texts without a word (null, empty) have no shingle and are classes of their own;
the class is named by its smallest id and keeps the row with it (null ids come last, and of
rows that repeat the smallest id, that with the smallest hash of its text); rows that repeat an id with
other texts are told apart by their texts, and equal rows are kept or dropped together; ties go to the smaller
hash; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, checkpoint, mix64, row_ranges, small_or_whole, text_buffers, window_hashes, word_hashes
from graphloom.llm.components import components_of, heavy_keys, join_spread

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SKETCH = 0.55
MIN_SHARE = 0.001
MOST_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 19
CHUNK = 1 << 20
TABLE = 1 << 16
PART_BYTES = 1 << 25


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in order, their counts, bounds of the rows, and a 64-bit hash of each row's word sequence (0: no word)."""
    words, _, bounds = word_hashes(data, offsets)
    found, at = window_hashes(words, bounds, WORDS)
    sizes = np.diff(bounds)
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], sizes).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words + (place + np.uint64(1)) * GOLDEN))))
    content = np.where(sizes > 0, mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)) | np.uint64(1), np.uint64(0))
    owner = np.repeat(np.arange(len(sizes)), np.diff(at))
    order = np.lexsort((found, owner)) if len(sizes) > 1 else np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(found)))
    return found[first], counts, np.searchsorted(owner[first], np.arange(len(sizes) + 1)), content


def frequent_shingles(df: DataFrame, text_col: str, min_share: float = MIN_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and idf weights of the shingles in more than min_share of all rows."""
    total, size = df.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART_BYTES + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            found = [shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])[0] for low, high in row_ranges(offsets, CHUNK)]
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            del found
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(every))).astype(np.uint32)
            hashes = every[first]
            del every, first
            once, part = counts == 1, ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(hashes)) if len(hashes) else [0]
            rows = []
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                h, n, o = (x[low:high] for x in (hashes, counts, once))
                rows.append((int(part[low]), h[o].tobytes(), h[~o].tobytes(), n[~o].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["part", "once", "more", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, once, more, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, more = np.frombuffer(once, "<u8"), np.frombuffer(more, "<u8")
                held.setdefault(part, []).append((np.concatenate((once, more)), np.concatenate((np.ones(len(once), np.uint32), np.frombuffer(counts, "<u4")))))
        for part in list(held):
            hashes, counts = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            order = np.argsort(hashes)
            hashes, sums = hashes[order], np.concatenate(([0], np.cumsum(counts[order].astype(np.int64))))
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            n = sums[np.append(first[1:], len(hashes))] - sums[first]
            keep = n > min_share * total
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first][keep].view(np.int64)), pa.array(n[keep])], names=["hash", "n"])

    packed = df.select(F.col(text_col).alias("text")).mapInArrow(pack, "part int, once binary, more binary, counts binary")
    found = packed.repartition(parts, "part").mapInArrow(count, "hash long, n long").toArrow()
    hashes, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], (1 + np.log(total / np.maximum(n[order], 1)) / np.log(1 / min_share)).astype(np.float32)


def weights(hashes: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """tf * idf"""
    known, idf = frequent
    out = np.full(len(hashes), 2.0, np.float32)
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[hit] = idf[at[hit]]
    return out * counts.astype(np.float32)


_variates: list[tuple[np.ndarray, np.ndarray]] = []


def variates() -> tuple[np.ndarray, np.ndarray]:
    """Rows of (1 / r, r) and of (beta, ln c), for r, c ~ Gamma(2, 1) and beta ~ U(0, 1)."""
    if not _variates:
        draw = np.random.default_rng(20100101)
        r, c, beta = draw.gamma(2, 1, TABLE), draw.gamma(2, 1, TABLE), draw.random(TABLE)
        _variates.append((np.stack([1 / r, r], axis=1).astype(np.float32), np.stack([beta, np.log(c)], axis=1).astype(np.float32)))
    return _variates[0]


def samples(hashes: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit value for each row (with shingles) and sample: the sampled shingle and its t."""
    (rates, others), log = variates(), np.log(weight)
    start, sizes = bounds[:-1], np.diff(bounds)
    out = np.zeros((len(start), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        mixed = hashes * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1)
        rate = rates[(mixed >> np.uint64(48)).astype(np.int64)]
        other = others[((mixed >> np.uint64(32)) & np.uint64(TABLE - 1)).astype(np.int64)]
        t = np.floor(log * rate[:, 0] + other[:, 0])
        # ln a = ln c - r (t - beta) - r
        a = other[:, 1] - rate[:, 1] * (t - other[:, 0] + np.float32(1))
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, start)]
        out[:, k] = mix64(hashes[first] + (t[first].astype(np.int64).view(np.uint64) + np.uint64(k << 32)) * GOLDEN)
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, frequent) -> DataFrame:
    """id, mark (hash of the text), content (hash of the word sequence; 0: no word), size (shingles), bands (a key for each band) and sketch (a byte for each sample) of each row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for low, high in row_ranges(offsets, CHUNK):
                hashes, counts, bounds, content = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                full = np.flatnonzero(content)
                found = np.zeros((high - low, BANDS * ROWS), np.uint64)
                if len(full):
                    found[full] = samples(hashes, weights(hashes, counts, frequent.value), np.append(bounds[full], len(hashes)))
                keys = np.zeros((high - low, BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix64(keys * GOLDEN + found[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                sketch = pa.array([x.tobytes() for x in (found & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], pa.array(content.view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), bands, sketch], names=["id", "mark", "content", "size", "bands", "sketch"])

    return rows.mapInArrow(sign, "id long, mark long, content long, size int, bands array<long>, sketch binary")


def link_bucket(ids: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, int]]:
    """Single linkage of a bucket's members by the share of equal bytes: each member and the smallest id of its group."""
    left = np.argsort(ids)
    while len(left):
        group, wave = [left[0]], [left[0]]
        left = left[1:]
        while wave and len(left):
            near = (sketch[left] == sketch[wave.pop()]).mean(axis=1) >= SKETCH
            wave += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        yield from ((int(ids[group[0]]), int(ids[i])) for i in group[1:])


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all buckets of a partition that is sorted by bucket."""
    key, ids, sketches, out = None, [], [], set()

    def close() -> None:
        if len(ids) == 2:
            out.add((min(ids), max(ids)))
        elif len(ids) > 2:
            out.update(link_bucket(np.array(ids), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1)))

    def rows() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out.clear()
        return found

    for batch in batches:
        for k, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close()
                key, ids, sketches = k, [], []
            ids.append(i)
            sketches.append(s)
        if len(out) > 10_000:
            yield rows()
    close()
    yield rows()


def candidate_links(contents: DataFrame) -> DataFrame:
    """Links a < b between contents that share a bucket."""
    keyed = contents.select("content", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("first")).filter("n > 1")
    members = checkpoint(join_spread(keyed, shared, "key", heavy_keys(keyed, "key")))
    large = members.filter(F.col("n") > MOST_MEMBERS).filter("content <> first").select(F.col("first").alias("a"), F.col("content").alias("b"))
    small = members.filter(F.col("n") <= MOST_MEMBERS).select("key", "content").join(contents.select("content", "sketch"), "content")
    small = small.select("key", "content", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links, "a long, b long")
    return small.union(large).distinct()


def forest(ids: np.ndarray, side: np.ndarray, sketch: np.ndarray, hashes: np.ndarray, weight: np.ndarray, bounds: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
    """Links of texts of a weighted Jaccard similarity of THRESHOLD or more, enough to connect all that are linked. cross: only between texts of two sides."""
    n = len(ids)
    _, local = np.unique(hashes, return_inverse=True)
    mass = np.add.reduceat(weight.astype(np.float64), bounds[:-1])
    sizes = np.diff(bounds)
    dense = np.zeros(int(local.max()) + 1, np.float64)
    group = np.arange(n)
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if cross:
            others = others[side[others] != side[i]]
        others = others[(mass[others] >= THRESHOLD * mass[i] * (1 - 1e-9)) & (mass[i] >= THRESHOLD * mass[others] * (1 - 1e-9))]
        others = others[(sketch[others] == sketch[i]).mean(axis=1) >= SKETCH] if len(others) else others
        if not len(others):
            continue
        own = slice(bounds[i], bounds[i + 1])
        dense[local[own]] = weight[own]
        take = np.repeat(bounds[others], sizes[others]) + np.arange(sizes[others].sum()) - np.repeat(np.cumsum(sizes[others]) - sizes[others], sizes[others])
        common = np.add.reduceat(np.minimum(dense[local[take]], weight[take]), np.cumsum(sizes[others]) - sizes[others])
        dense[local[own]] = 0
        like = others[common >= THRESHOLD * (mass[i] + mass[others] - common) - 1e-9]
        for j in like.tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                yield int(ids[i]), int(ids[j])


def compared(df: DataFrame, dealt: DataFrame, id_col: str, text_col: str, frequent) -> DataFrame:
    """Links a, b found in each group of dealt (component, low, high, side, content, sketch, id and mark of a row with the content): within it, or between its two sides where low <> high."""
    texts = df.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__mark"), F.col(text_col).alias("__text"))
    found = dealt.join(texts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    rows = found.select("component", "low", "high", "side", "content", "sketch", F.col("__text").alias("text"))
    rows = rows.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "content")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last = None, [], None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, side = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            sketch = np.frombuffer(b"".join(x[2] for x in held), np.uint8).reshape(len(held), -1)
            bounds = np.concatenate(([0], np.cumsum([len(x[3]) for x in held])))
            return list(forest(ids, side, sketch, np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), bounds, key[1] != key[2]))

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        out = []
        for batch in batches:
            head = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            data, offsets = text_buffers(batch.column(6))
            for low, high in row_ranges(offsets, CHUNK):
                hashes, counts, bounds, _ = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                weight = weights(hashes, counts, frequent.value)
                for k in range(low, high):
                    component, a, b, side, content, sketch = head[k]
                    if (component, a, b) != key:
                        out += close()
                        key, held = (component, a, b), []
                    own = slice(bounds[k - low], bounds[k - low + 1])
                    if own.stop > own.start and (key, content) != last:
                        held.append((content, side, sketch, hashes[own], weight[own]))
                    last = key, content
            if len(out) > 10_000:
                yield rows(out)
                out = []
        yield rows(out + close())

    return rows.mapInArrow(check, "a long, b long")


def joined_sums(rows: DataFrame, key: str, *sums: Column) -> DataFrame:
    """rows with sums over their key, however many rows a key has."""
    return join_spread(rows, rows.groupBy(key).agg(*sums), key, heavy_keys(rows, key))


def block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value), blocks).cast("int")


def verified_links(df: DataFrame, contents: DataFrame, candidates: DataFrame, id_col: str, text_col: str, frequent) -> DataFrame:
    """Links between contents, checked on their texts, enough to connect all that are linked."""
    blocks = F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks")
    member = checkpoint(components_of(candidates, "a", "b").join(contents.select(F.col("content").alias("id"), "size", "sketch", F.col("row.id").alias("row_id"), F.col("row.mark").alias("mark")), "id").withColumnRenamed("id", "content"))
    placed = checkpoint(joined_sums(member, "component", blocks).withColumn("block", block(F.col("content"), F.col("blocks"))))

    def dealt(rows: DataFrame, groups: Column) -> DataFrame:
        """rows once for each (low, high, side) of groups."""
        return rows.withColumn("group", F.explode(groups)).select("component", "group.*", "content", "sketch", F.col("row_id").alias("id"), "mark")

    def group(low: Column, high: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), side.alias("side"))

    zero, own = F.lit(0), F.col("block")
    # Block 0 meets every block; the others meet themselves, too.
    first = F.when(own == 0, F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: group(zero, j, zero))).otherwise(F.array(group(own, own, own), group(zero, own, own)))
    links = checkpoint(compared(df, small_or_whole(checkpoint(dealt(placed, first))), id_col, text_col, frequent))
    many = placed.filter("blocks > 1")
    if many.isEmpty():
        return links
    named = components_of(links, "a", "b").select(F.col("id").alias("content"), F.col("component").alias("class"))
    many = checkpoint(many.join(named, "content", "left").withColumn("class", F.coalesce("class", "content")))
    largest = many.groupBy("component", "class").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "class")).alias("most"))
    many = checkpoint(join_spread(many, largest, "component", heavy_keys(many, "component")).withColumn("rest", F.col("class") != F.col("most.class")))
    rest = checkpoint(joined_sums(many.filter("rest"), "component", F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("parts")).withColumn("part", block(F.col("class"), F.col("parts"))))
    if rest.isEmpty():
        return links
    # Part r of the rest is block -1 - r; it meets all blocks of the largest class, all parts and itself.
    part = -1 - F.col("part")
    with_blocks = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: group(part, j, part))
    with_parts = F.transform(F.sequence(zero, F.col("parts") - 1), lambda j: group(F.least(part, -1 - j), F.greatest(part, -1 - j), part))
    parts = rest.select("component", "parts").distinct()
    main = join_spread(many.filter("not rest"), parts, "component", heavy_keys(many, "component"))
    blocks_of = F.transform(F.sequence(zero, F.col("parts") - 1), lambda r: group(-1 - r, own, own))
    more = dealt(rest, F.concat(with_blocks, with_parts)).union(dealt(main, blocks_of))
    return links.union(checkpoint(compared(df, more, id_col, text_col, frequent)))


def near_classes(df: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """One row for each row: id, keep's columns, class_id (the smallest id of its class) and kept (it is that row)."""
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(df, text_col))
    signed = checkpoint(signatures(df, id_col, text_col, frequent))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    contents = checkpoint(signed.filter("content <> 0").groupBy("content").agg(F.min(row).alias("row"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch"))))
    links = verified_links(df, contents, candidate_links(contents), id_col, text_col, frequent)
    named = components_of(links, "a", "b").select(F.col("id").alias("content"), "component")
    classes = contents.select("content", "row").join(named, "content", "left").withColumn("component", F.coalesce("component", "content"))
    least = classes.groupBy("component").agg(F.min("row").alias("least"))
    classes = checkpoint(join_spread(classes.select("content", "component"), least, "component", heavy_keys(classes, "component")))
    full = signed.filter("content <> 0").select("id", "mark", "content")
    found = join_spread(full, classes.select("content", "least"), "content", heavy_keys(full, "content"))
    named = found.select(F.col("id").alias("__named"), F.col("mark").alias("__named_mark"), F.col("least.id").alias("__class"), ((F.col("id").eqNullSafe(F.col("least.id"))) & (F.col("mark") == F.col("least.mark"))).alias("__kept")).distinct()
    rows = df.select(F.col(id_col), *keep, F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__mark"))
    joined = rows.join(named, F.col("__id").eqNullSafe(F.col("__named")) & (F.col("__mark") == F.col("__named_mark")), "left")
    alone = F.col("__kept").isNull()
    return joined.select(*rows.columns[:-2], F.when(alone, F.col("__id")).otherwise(F.col("__class")).alias("class_id"), F.coalesce("__kept", F.lit(True)).alias("kept"))
