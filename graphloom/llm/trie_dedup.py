"""Exact dedup with Patricia-trie owners.

Each distinct text has one owner: rows are partitioned by length and content
hash, and the owner of a partition inserts whole byte strings into a compressed
radix trie whose terminal nodes hold the smallest id, the number of copies and
the salts of the copies. Two texts meet at a terminal only if all their bytes
are equal; rows find their owner's answer by SHA-256 and length of the text.

Scale. Copies are combined batch by batch before the shuffle, so a text that makes
up a third of all rows reaches its owner once a batch, not once a copy. The
owner's answer is one row for each salt it saw (at most SALTS) of each text;
rows take it by (hash, length, salt), so the copies of a hot text spread over
SALTS keys. A trie that outgrows its memory spills its largest subtrees: their
strings leave as rows, and go to owners of the next round, dealt by hash and
round, until none is left. Rounds are cut by checkpoint(); nothing is kept on an
executor's disk.

Defined cases: a null text counts as empty, and all empty texts are one group;
rows that repeat an id are counted and returned row by row; of equal texts the
smallest id stays (all rows with it, if it is repeated with the same text);
rows with a null id are returned, and stay only if their group has no other id;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint

SALTS = 256
NO_ID = (1 << 63) - 1


class Node:
    """An edge label, the nodes below by their first byte, and at a terminal what is known of its string."""

    __slots__ = ("label", "below", "entry")

    def __init__(self, label: bytes):
        self.label, self.below, self.entry = label, {}, None


class PatriciaTrie:
    """A compressed radix trie over byte strings. Entries: smallest id, copies, salts as a bit mask, key."""

    def __init__(self, most_bytes: int):
        self.root, self.most_bytes, self.used, self.strings = Node(b""), most_bytes, 0, 0
        self.evicted: dict[int, set[bytes]] = {}  # by depth: a text shorter than its depth is a group of its own, not a prefix of others

    def insert(self, text: bytes, smallest: int, copies: int, salts: int, key: tuple) -> bool:
        """False if the string belongs to a subtree that has been spilled."""
        node, at = self.root, 0
        if any(text[:d] in groups for d, groups in self.evicted.items()):
            return False
        while True:
            if at == len(text):
                break
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.used += len(text) - at + 200
                node = child
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(text) - at)
            while low < high:  # length of the common prefix
                middle = (low + high + 1) // 2
                if text.startswith(label[:middle], at):
                    low = middle
                else:
                    high = middle - 1
            fork = Node(label[:low])
            child.label = label[low:]
            fork.below[child.label[0]] = child
            node.below[text[at]] = fork
            self.used += 200
            node, at = fork, at + low
        if node.entry is None:
            node.entry = [smallest, copies, salts, key]
            self.strings += 1
        else:
            entry = node.entry
            entry[0], entry[1], entry[2] = min(entry[0], smallest), entry[1] + copies, entry[2] | salts
        return True

    def entries(self, node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.entry:
                yield prefix, node.entry
            stack += [(child, prefix) for child in node.below.values()]

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take out the largest subtrees, about half of all that is held. Subtrees begin at the shortest depth at which none is more than half; at least one string stays, so each round makes progress."""
        found = list(self.entries(self.root))
        longest, depth = max(len(t) for t, _ in found), 2
        while True:
            groups: dict[bytes, list[tuple[bytes, list]]] = {}
            for text, entry in found:
                groups.setdefault(text[:depth], []).append((text, entry))
            sizes = {g: sum(len(t) + 200 for t, _ in rows) for g, rows in groups.items()}
            if depth >= longest or 2 * max(sizes.values()) <= sum(sizes.values()):
                break
            depth *= 2
        free, self.root, self.used, self.strings = sum(sizes.values()) / 2, Node(b""), 0, 0
        evicted = self.evicted.setdefault(depth, set())
        for g in sorted(groups, key=sizes.get, reverse=True)[:-1]:
            if free <= 0:
                break
            free -= sizes[g]
            evicted.add(g)
            yield from groups.pop(g)
        for rows in groups.values():
            for text, entry in rows:
                if not self.insert(text, *entry):
                    yield text, entry


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch one row for each distinct text: smallest id, copies, the set of salts."""
    for batch in batches:
        text, key, ids, salt = batch.columns
        coded = text.dictionary_encode()
        table = pa.table({"text": coded.indices, "key": key, "id": pc.fill_null(ids, NO_ID), "salt": salt})
        found = table.group_by("text").aggregate([("key", "min"), ("id", "min"), ("id", "count"), ("salt", "distinct")]).combine_chunks()
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(found["text"].combine_chunks()), *(found[c].combine_chunks() for c in ("key_min", "id_min", "id_count", "salt_distinct"))], names=["text", "key", "smallest", "copies", "salts"])


OWNED = "key string, smallest long, copies long, salts array<int>, size int, text string, spilled boolean"


def own(most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = PatriciaTrie(most_bytes), []

        def rows(found: list) -> pa.RecordBatch:
            salts = [[i for i in range(SALTS) if e[2] >> i & 1] if e[2] & (e[2] - 1) else [e[2].bit_length() - 1] for _, e, _ in found]
            columns = [[e[3] for _, e, _ in found], [e[0] for _, e, _ in found], [e[1] for _, e, _ in found], salts, [len(t) for t, _, _ in found], [t.decode() if s else None for t, _, s in found], [s for _, _, s in found]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "smallest", "copies", "salts", "size", "text", "spilled"])

        for batch in batches:
            text, keys, smallest, copies, salts = batch.columns
            for t, k, i, n, s in zip(text.cast(pa.binary()), keys, smallest, copies, salts, strict=True):
                mask = 0
                for x in s.as_py():
                    mask |= 1 << x
                row = t.as_py(), i.as_py(), n.as_py(), mask, k.as_py()
                if not trie.insert(*row):
                    out.append((row[0], [row[1], row[2], row[3], row[4]], True))
                if trie.used > most_bytes and trie.strings > 1:
                    out += [(t, e, True) for t, e in trie.spill()]
                if len(out) >= 500:
                    yield rows(out)
                    out = []
        if out:
            yield rows(out)
        out = []
        for t, e in trie.entries(trie.root):
            out.append((t, e, False))
            if len(out) >= 2000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return run


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(df: DataFrame, id_col: str, text_col: str, *keep: Column, most_bytes: int = 96 << 20) -> DataFrame:
    """One row for each row: id, keep's columns, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col(text_col))
    row = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    salt = F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")
    source = df.select(text.alias("text"), F.col(id_col).cast("long").alias("id"), salt.alias("salt"))
    todo = source.select("text", F.sha2(F.col("text"), 256).alias("key"), "id", "salt").mapInArrow(combine, "text string, key string, smallest long, copies long, salts array<int>")
    done, turn = [], 0
    while True:
        where = [F.octet_length("text"), F.col("key")] if not turn else [F.xxhash64("key", F.lit(turn)), F.substring("text", 1, 2)]
        owned = checkpoint(todo.repartition(*where).mapInArrow(own(most_bytes), OWNED))
        done.append(owned.filter("not spilled"))
        if owned.filter("spilled").isEmpty():
            break
        todo, turn = owned.filter("spilled").select("text", "key", "smallest", "copies", "salts"), turn + 1
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    answers = answers.select(F.col("key").alias("__own_key"), F.col("size").alias("__own_size"), F.explode("salts").alias("__own_salt"), F.col("smallest").alias("__smallest"), F.col("copies").alias("__copies"))
    rows = df.select(F.col(id_col), *keep, F.sha2(text, 256).alias("__key"), F.octet_length(text).alias("__size"), salt.alias("__salt"))
    joined = rows.join(answers, (F.col("__key") == F.col("__own_key")) & (F.col("__size") == F.col("__own_size")) & (F.col("__salt") == F.col("__own_salt")))
    return joined.select(
        *[c for c in rows.columns if not c.startswith("__")],
        F.when(F.col("__smallest") != NO_ID, F.col("__smallest")).alias("keep_id"),
        F.col("__copies").alias("group_size"),
        (row == F.col("__smallest")).alias("kept"),
        F.col("__key").alias("text_sha256"),
    )
