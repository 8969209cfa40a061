"""Exports of a graph: JSON, CSV and DOT, written by all tasks; a folder of parts each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import CodeGraph

# Colours and styles of the drawing.
NODE_COLOURS = {"Function": "#4fc3f7", "Method": "#29b6f6", "Class": "#ab47bc", "Interface": "#ce93d8", "Enum": "#ffa726", "Module": "#66bb6a", "Variable": "#ef5350", "Import": "#78909c", "File": "#546e7a"}
EDGE_COLOURS = {"Calls": "#e53935", "Contains": "#43a047", "References": "#1e88e5", "Imports": "#8e24aa", "DependsOn": "#f4511e", "Inherits": "#ffb300"}
EDGE_STYLES = {"Calls": "bold", "Contains": "dashed", "References": "dotted"}
NODE_FIELDS = ("id", "kind", "name", "file_id", "start_line", "start_col", "end_line", "end_col")
EDGE_FIELDS = ("id", "source_node_id", "target_node_id", "kind")


def _chosen(kind: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[kind], F.lit(other))


def dot_lines(graph: CodeGraph) -> DataFrame:
    """section (0 head, 1 nodes, 2 edges, 3 end), id, line."""
    spark = graph.nodes.sparkSession
    frame = [(0, 0, "digraph code {"), (0, 1, "  rankdir=LR;"), (0, 2, '  node [shape=box, style=filled, fontname="monospace"];'), (3, 0, "}")]
    label = F.replace(F.col("name"), F.lit('"'), F.lit('\\"'))
    nodes = graph.nodes.select(F.lit(1).alias("section"), "id", F.format_string('  n%d [label="%s\\n%s", fillcolor="%s"];', "id", label, "kind", _chosen(F.col("kind"), NODE_COLOURS, "#90a4ae")).alias("line"))
    text = F.format_string('  n%d -> n%d [color="%s", style=%s, label="%s"];', "source_node_id", "target_node_id", _chosen(F.col("kind"), EDGE_COLOURS, "#757575"), _chosen(F.col("kind"), EDGE_STYLES, "solid"), "kind")
    edges = graph.edges.select(F.lit(2).alias("section"), "id", text.alias("line"))
    return spark.createDataFrame(frame, "section int, id long, line string").unionByName(nodes).unionByName(edges)


def json_lines(graph: CodeGraph) -> DataFrame:
    """One JSON object a row: {"node": {...}} or {"edge": {...}}."""
    fields = lambda df, names: F.struct(*[F.col(c) for c in names if c in df.columns])
    nodes = graph.nodes.select(F.to_json(F.struct(fields(graph.nodes, NODE_FIELDS).alias("node"))).alias("line"))
    return nodes.union(graph.edges.select(F.to_json(F.struct(fields(graph.edges, EDGE_FIELDS).alias("edge"))).alias("line")))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("line"))


def export(graph: CodeGraph, path: str) -> None:
    """By the path's extension: .json, .csv (folders nodes and edges) or .dot / .gv."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        json_lines(graph).write.mode("overwrite").text(path)
    elif kind == "csv":
        for name, df, fields in (("nodes", graph.nodes, NODE_FIELDS), ("edges", graph.edges, EDGE_FIELDS)):
            df.select(*[c for c in fields if c in df.columns]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    elif kind in ("dot", "gv"):
        dot_lines(graph).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no export for .{kind}: json, csv, dot or gv")
