"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint

#: A key is heavy if it has more than 1 / HEAVY of all rows (and LEAST of them), so there are fewer than HEAVY heavy keys, whatever the size.
HEAVY, LEAST = 1 << 14, 100
#: So many links (16 bytes each) fit into one task.
MOST_LINKS = 1 << 20


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """The heavy keys of rows, cut off."""
    counts = checkpoint(rows.groupBy(key).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return checkpoint(counts.filter(F.col("count") > max(LEAST, total // HEAVY)).select(key))


def join_spread(rows: DataFrame, other: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """rows joined with other, which has one row a key at most. The heavy keys' rows stay where they are: their fewer than HEAVY partners are broadcast."""
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
    light = marked.filter("__heavy is null").drop("__heavy").join(other, key)
    few = F.broadcast(other.join(F.broadcast(heavy), key, "left_semi"))
    return light.unionByName(marked.filter("__heavy").drop("__heavy").join(few, key))


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the links a, b, and the smallest id of the component of each."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b):  # the label itself takes the smaller label, too
            np.minimum.at(label, before[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            return ids, ids[label]


def components_of(links: DataFrame, a: str, b: str) -> DataFrame:
    """As components(), for operators that may use Python: links that fit into a task are joined there, all others as in components(), with the same result."""
    ends = checkpoint(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b"))
    if ends.limit(MOST_LINKS + 1).count() > MOST_LINKS:
        return components(ends, "a", "b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if held:
            found = labels_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "component"])

    return checkpoint(ends.coalesce(1).mapInArrow(join, "id long, component long"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """For each id in links, the smallest id of its component: columns id, component.

    Each round every node takes the smallest label among its own and its
    neighbours', and then its label's label (pointer jumping), so a chain of n
    links needs about log n rounds and a star two. Labels and links stay in
    tables, cut by checkpoint(); only counts reach the driver. The neighbours'
    minimum is combined before the shuffle; a hub with very many neighbours and a
    label with very many nodes are heavy keys. Links with a null end, and loops, say nothing.
    """
    ends = links.select(F.col(a).alias("id"), F.col(b).alias("other")).filter("id is not null and other is not null and id <> other")
    both = checkpoint(ends.union(ends.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    hubs = heavy_keys(both, "other")
    labels = checkpoint(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component")))
    while True:
        near = join_spread(both, labels.withColumnRenamed("id", "other"), "other", hubs).groupBy("id").agg(F.min("component").alias("near"))
        pulled = checkpoint(labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component")))
        jump = pulled.select(F.col("id").alias("component"), F.col("component").alias("next"))
        turned = join_spread(pulled, jump, "component", heavy_keys(pulled, "component"))
        turned = checkpoint(turned.select("id", "before", F.col("next").alias("component")))
        labels = turned.select("id", "component")
        if turned.filter("before <> component").isEmpty():
            return labels
