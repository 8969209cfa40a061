"""Breadth-first operators over the edges: impact, subtree, shortest path.

One level is one join of the frontier with the edges, one grouped minimum and
one anti join, whatever the size of the frontier; levels are cut by checkpoint(), and
what was visited is merged two parts of a size at a time, so after n levels it has about
log n parts and each row was written as often. Only a count a level reaches the driver. First-in-first-out order, which
decides the path by which a node is first reached, is that of the edge ids along the
path: a node's trail. The least trail wins, so no level is ever numbered.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import CodeGraph


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, a local session (tests) gets a temporary one, and a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written as a table into the checkpoint folder and read again: compressed, and columns are read one by one."""
    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by ranges of by, with the number of their range as part: what is counted within ranges needs only one sum a range besides, however large a group is."""
    return checkpoint(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))


@dataclass
class Walk:
    """visited: node, depth and, with paths, edge_path (kinds) and trail (edge ids); expanded: edges that were looked at."""

    visited: DataFrame
    expanded: int
    reached: int

    @property
    def cycle_detected(self) -> bool:
        """An edge led to a node seen before: each new node takes one edge, so any surplus is such an edge."""
        return self.expanded > self.reached


class Parts:
    """Rows that come level by level, as about log n parts: two of a size are made one, and written once they are of a few levels."""

    def __init__(self) -> None:
        self.held: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            rows = self.held.pop()[1].unionByName(rows)
            size *= 2
            rows = checkpoint(rows) if size >= 4 else rows
        self.held.append((size, rows))

    def union(self) -> DataFrame:
        out = self.held[0][1]
        for _, rows in self.held[1:]:
            out = out.unionByName(rows)
        return out


def walk(edges: DataFrame, root: int, max_depth: int | None, reverse: bool = False, until: int | None = None, stored: bool = False, paths: bool = True) -> Walk:
    """Everything within max_depth steps of root (None: no bound); a node at max_depth is not expanded. Stops early once the node until is reached. stored: edges are a stored table, which needs no copy. Without paths only ends of edges are stored and joined, and only depths found."""
    spark: SparkSession = edges.sparkSession
    source, target = ("target_node_id", "source_node_id") if reverse else ("source_node_id", "target_node_id")
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("next"), *(["kind", F.col("id").alias("edge")] if paths else []))
    steps = steps if stored else checkpoint(steps)
    none = F.array()
    empty = [none.cast("array<string>").alias("edge_path"), none.cast("array<long>").alias("trail")] if paths else []
    way = [F.struct(F.array_append("trail", F.col("edge")).alias("trail"), F.array_append("edge_path", F.col("kind")).alias("edge_path")).alias("way")] if paths else []
    frontier = spark.range(1).select(F.lit(root).cast("long").alias("node"), F.lit(0).alias("depth"), *empty)
    visited, depth, expanded, reached = Parts(), 0, 0, 0
    visited.add(frontier)
    while max_depth is None or depth < max_depth:
        # The trail ends in the edge, and an edge has one target in this direction, so the least trail is one row.
        seen = steps.join(frontier, "node").select("next", *way)
        found = seen.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"), *([F.min("way").alias("way")] if paths else []))
        level = checkpoint(found.join(visited.union().select("node", F.lit(True).alias("old")), "node", "left"))
        sums = level.agg(F.sum("n"), F.count_if(F.col("old").isNull()), F.count_if(F.col("old").isNull() & (F.col("node") == (until if until is not None else -1)))).first()
        expanded += sums[0] or 0
        if not sums[1]:
            break
        depth, reached = depth + 1, reached + sums[1]
        frontier = level.filter("old IS NULL").select("node", F.lit(depth).alias("depth"), *(["way.edge_path", "way.trail"] if paths else []))
        visited.add(frontier)
        if until is not None and sums[2]:
            break
    return Walk(visited.union(), expanded, reached)


def impact(graph: CodeGraph, root: int, max_depth: int = 10, reverse: bool = False, paths: bool = True) -> DataFrame:
    """Known nodes that the root reaches (or that reach it): node_id, name, kind, file_id, depth and, with paths, edge_path."""
    return _reported(graph, walk(graph.edges, root, max_depth, reverse, stored=graph.stored, paths=paths), root)


def _reported(graph: CodeGraph, found: Walk, root: int) -> DataFrame:
    names = graph.nodes.select(F.col("id").alias("node"), "name", "kind", "file_id")
    return found.visited.filter(F.col("node") != root).join(names, "node").select(F.col("node").alias("node_id"), "name", "kind", "file_id", "depth", *(c for c in ("edge_path",) if c in found.visited.columns))


def impact_summary(graph: CodeGraph, root: int, max_depth: int = 10, reverse: bool = False) -> DataFrame:
    """One row: root, root_name ("" if unknown), total_affected, max_depth, cycle_detected."""
    found = walk(graph.edges, root, max_depth, reverse, stored=graph.stored, paths=False)
    one = _reported(graph, found, root).agg(F.count("*").alias("total_affected"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    name = graph.nodes.filter(F.col("id") == root).agg(F.coalesce(F.first("name"), F.lit("")).alias("root_name"))
    return one.join(F.broadcast(name)).select(F.lit(root).cast("long").alias("root"), "root_name", "total_affected", "max_depth", F.lit(found.cycle_detected).alias("cycle_detected"))


def affected_files(graph: CodeGraph, root: int, max_depth: int = 10) -> DataFrame:
    return impact(graph, root, max_depth, paths=False).select("file_id").distinct()


def subtree(graph: CodeGraph, root: int, max_depth: int = 5, callers: bool = True, callees: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes within max_depth (20 at most) steps in the chosen directions, and the distinct edges incident to an expanded node there. The edges are computed once, into a stored table."""
    max_depth = min(max_depth, 20)
    out = graph.edges.select("source_node_id", "target_node_id", "kind")
    out = out if graph.stored else checkpoint(out)
    back = out.select(F.col("target_node_id").alias("source_node_id"), F.col("source_node_id").alias("target_node_id"), "kind")
    both = (out.union(back) if callers and callees else out if callees else back) if callers or callees else out.limit(0)
    visited = walk(both, root, max_depth, stored=True, paths=False).visited
    nodes = graph.nodes.join(visited, F.col("id") == F.col("node")).drop("node")
    inner = visited.filter(F.col("depth") < max_depth).select("node")
    parts = [out.join(inner, out[end] == inner["node"], "left_semi") for end, wanted in (("source_node_id", callees), ("target_node_id", callers)) if wanted]
    edges = parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else out.limit(0)
    return nodes, edges.select("source_node_id", "target_node_id", "kind").distinct()


def shortest_path(graph: CodeGraph, source: int, target: int) -> DataFrame | None:
    """The nodes of the first shortest path, source included: node_id, depth, edge_path up to it. No rows if both are one node; None if there is no way.

    The path is walked back along the trail of the target, whose length is the path's.
    """
    spark = graph.edges.sparkSession
    schema = "node_id long, depth int, edge_path array<string>"
    if source == target:
        return spark.createDataFrame([], schema)
    visited = walk(graph.edges, source, None, until=target, stored=graph.stored).visited
    goal = visited.filter(F.col("node") == target).select(F.col("trail").alias("goal"))
    if goal.isEmpty():
        return None
    on_path = visited.join(F.broadcast(goal)).filter(F.slice("goal", F.lit(1), F.size("trail")) == F.col("trail"))  # the goal is one row
    return on_path.select(F.col("node").alias("node_id"), "depth", "edge_path")
