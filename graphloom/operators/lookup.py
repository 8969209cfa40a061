"""Filters, projections, lookups and name joins over the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import contains_like
from graphloom.operators.places import holding
from graphloom.operators.traverse import checkpoint
from graphloom.schema import CONTAINER_KINDS, EDGE_KINDS, LIST_LIMIT, NODE_KINDS, CodeGraph


def known_kind(kind: Column, kinds: tuple[str, ...] = NODE_KINDS, fallback: str = "Anonymous") -> Column:
    return F.when(kind.isin(*kinds), kind).otherwise(F.lit(fallback))


def known_edge_kind(kind: Column) -> Column:
    return known_kind(kind, EDGE_KINDS, "References")


def symbols(nodes: DataFrame, kind: str | None = None, name: str | None = None, file_id: int | None = None, prefix: str | None = None, limit: int | None = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """Nodes by any of kind, part of the name (case-insensitive, % and _ are wildcards), file and prefix of the name; by name, then id, or, without a limit, all in no order."""
    for given, test in ((kind, F.col("kind") == kind), (file_id, F.col("file_id") == file_id)):
        nodes = nodes.filter(test) if given is not None else nodes
    if name is not None:
        nodes = nodes.filter(contains_like(F.col("name"), name))
    if prefix is not None:
        nodes = nodes.filter(F.col("name").startswith(prefix))
    if limit is None and not offset:
        return nodes
    rows = nodes.orderBy("name", "id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def edges_where(edges: DataFrame, kind: str | None = None, source: int | None = None, target: int | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    for column, value in (("kind", kind), ("source_node_id", source), ("target_node_id", target)):
        edges = edges.filter(F.col(column) == value) if value is not None else edges
    return edges.orderBy("id").limit(limit)


def symbol(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("id") == node_id).limit(1)


def files_list(files: DataFrame, language: str | None = None) -> DataFrame:
    return (files.filter(F.col("language") == language) if language else files).orderBy("relative_path")


def files_matching(files: DataFrame, part: str) -> DataFrame:
    """Files whose path holds the part, whatever the case."""
    return files.filter(F.instr(F.lower("relative_path"), part.lower()) > 0)


def broken_refs_by_kind(refs: DataFrame, kind: str | None = None) -> DataFrame:
    return (refs.filter(F.col("kind") == kind) if kind else refs).orderBy("file_id", "line", "ref_name")


def symbols_with_path(graph: CodeGraph) -> DataFrame:
    """Nodes with their file's path, "?" if the file is missing."""
    paths = graph.files.select(F.col("id").alias("file_id"), F.col("relative_path").alias("path"))
    return graph.nodes.join(paths, "file_id", "left").withColumn("path", F.coalesce("path", F.lit("?")))


def edges_named(graph: CodeGraph) -> DataFrame:
    """Edges with "name [kind]" of both ends, or "id:n" for an unknown one."""
    label = graph.nodes.select("id", F.format_string("%s [%s]", "name", "kind").alias("label"))
    rows = graph.edges
    for end in ("source", "target"):
        side = label.select(F.col("id").alias(f"{end}_node_id"), F.col("label").alias(f"{end}_label"))
        rows = rows.join(side, f"{end}_node_id", "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.concat(F.lit("id:"), F.col(f"{end}_node_id").cast("string"))))
    return rows


def covering_symbols(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For points (file_id, line and, if it has one, col) each node whose span holds the point, ends included."""
    place = ["start_col", "end_col"] if "col" in points.columns else []
    return holding(points, nodes.select("file_id", F.col("id").alias("node_id"), "name", "kind", "start_line", "end_line", *place))


def span_contains(start_line: Column, start_col: Column, end_line: Column, end_col: Column, line: Column, col: Column) -> Column:
    """Whether an inclusive span holds a place; an empty span holds nothing."""
    empty = (start_line == end_line) & (start_col == end_col)
    after = (line > start_line) | ((line == start_line) & (col >= start_col))
    before = (line < end_line) | ((line == end_line) & (col <= end_col))
    return ~empty & after & before


def child_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'Contains'").groupBy(F.col("source_node_id").alias("id")).agg(F.count("*").alias("child_count"))


def containers(graph: CodeGraph, importance: DataFrame) -> DataFrame:
    """Container nodes with their number of children and importance (0.3 where unknown)."""
    rows = graph.nodes.filter(F.col("kind").isin(*CONTAINER_KINDS)).join(child_counts(graph.edges), "id", "left").join(importance.select("id", "importance"), "id", "left")
    return rows.select("id", "kind", "name", "file_id", F.coalesce("child_count", F.lit(0).cast("long")).alias("child_count"), F.coalesce("importance", F.lit(0.3)).alias("importance"))


def graph_rows(graph: CodeGraph, importance: DataFrame) -> DataFrame:
    rows = graph.nodes.join(importance.select("id", "importance"), "id", "left")
    return rows.select("id", "kind", "name", "file_id", "start_line", "end_line", F.coalesce("importance", F.lit(0.3)).alias("importance"))


def children(graph: CodeGraph, parent: int) -> DataFrame:
    """The parent's children by Contains edges; place 0 is the parent itself, then by name."""
    below = graph.edges.filter((F.col("kind") == "Contains") & (F.col("source_node_id") == parent)).select(F.col("target_node_id").alias("id")).distinct()
    found = graph.nodes.join(below, "id", "left_semi").withColumn("is_parent", F.lit(False))
    return graph.nodes.filter(F.col("id") == parent).withColumn("is_parent", F.lit(True)).unionByName(found)


def children_edges(graph: CodeGraph, parent: int) -> DataFrame:
    """Edges that touch a child at either end: two left joins over one pass of the edges, never a join on OR. The children are stored first, so a few of them are sent to the edges and these are not shuffled."""
    below = checkpoint(graph.edges.filter((F.col("kind") == "Contains") & (F.col("source_node_id") == parent)).select(F.col("target_node_id").alias("child")).distinct())
    rows = graph.edges
    for end in ("source", "target"):
        rows = rows.join(below.select(F.col("child").alias(f"{end}_node_id"), F.lit(True).alias(f"{end}_is_child")), f"{end}_node_id", "left")
    return rows.filter("source_is_child OR target_is_child").select(*graph.edges.columns).dropDuplicates(["id"])


def induced(graph: CodeGraph, visible: DataFrame) -> DataFrame:
    """Edges with both ends among the visible ids."""
    ids = visible.select(F.col("id").alias("seen"))
    return graph.edges.join(ids, F.col("source_node_id") == F.col("seen"), "left_semi").join(ids, F.col("target_node_id") == F.col("seen"), "left_semi")


def merge_visible(shown: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What is shown, then the new rows whose keys are not."""
    return shown.unionByName(new.join(shown.select(*keys), keys, "left_anti"))


def neighbours(edges: DataFrame, node_id: int) -> DataFrame:
    """Ids one step away in either direction."""
    out = edges.filter(F.col("source_node_id") == node_id).select(F.col("target_node_id").alias("id"))
    into = edges.filter(F.col("target_node_id") == node_id).select(F.col("source_node_id").alias("id"))
    return out.union(into).distinct()


def detail_filter(rows: DataFrame, distance: float, level_distance: float, level_importance: float) -> DataFrame:
    """Level of detail: all rows when near; else those of an importance above a cut that grows with the distance, 0.7 at most."""
    if distance < level_distance / 2:
        return rows
    return rows.filter(F.col("importance") >= min(level_importance * distance / (2 * level_distance), 0.7))


def symbol_tree(nodes: DataFrame) -> DataFrame:
    """Nodes with the module and class that their properties name as parents."""
    return nodes.select("id", "name", "kind", F.get_json_object("properties", "$.parent_module").alias("parent_module"), F.get_json_object("properties", "$.parent_class").alias("parent_class"))
