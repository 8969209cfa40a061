"""Counts, metrics and importance. Every edge counts, duplicates too; there is no cap inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import FUNCTION_KINDS, MODULE_KINDS, CodeGraph

# Weight of a node's kind in its importance; 0.5 for others.
KIND_WEIGHTS = {"Module": 1.0, "Class": 0.9, "Interface": 0.9, "Function": 0.7, "Method": 0.7, "Enum": 0.6, "Variable": 0.3, "Field": 0.3, "Import": 0.1, "File": 0.1}


def counts(graph: CodeGraph) -> DataFrame:
    tables = (("files", graph.files), ("nodes", graph.nodes), ("edges", graph.edges))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables]
    return rows[0].union(rows[1]).union(rows[2])


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, the most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def workspace_rollup(graph: CodeGraph) -> DataFrame:
    """Files, nodes and languages by repository, and in all (repository null)."""
    nodes = graph.nodes.groupBy("file_id").agg(F.count("*").alias("nodes"))
    rows = graph.files.join(nodes, graph.files.id == nodes.file_id, "left")
    languages = F.array_join(F.array_sort(F.collect_set("language")), ",")
    return rows.rollup("repo_root").agg(F.count("*").alias("files"), F.sum(F.coalesce("nodes", F.lit(0).cast("long"))).alias("nodes"), languages.alias("languages"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: edges out and in, over all kinds and by kind, from one pass over each end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_node_id").alias("id"), F.lit(True).alias("out")), F.struct(F.col("target_node_id").alias("id"), F.lit(False).alias("out")))).alias("end"), "kind")
    n = lambda test: F.count_if(test)
    out, kind = F.col("end.out"), F.col("kind")
    return ends.groupBy(F.col("end.id").alias("id")).agg(
        n(out).alias("fan_out"),
        n(~out).alias("fan_in"),
        n(out & (kind == "Calls")).alias("calls_out"),
        n(~out & (kind == "Calls")).alias("calls_in"),
        n(out & (kind == "DependsOn")).alias("depends_out"),
        n(~out & (kind == "DependsOn")).alias("depends_in"),
        n(out & (kind == "Contains")).alias("contains_out"),
    )


def _with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.join(degrees(edges), "id", "left")
    return rows.fillna(0, subset=["fan_out", "fan_in", "calls_out", "calls_in", "depends_out", "depends_in", "contains_out"])


def lines_between(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def function_metrics(graph: CodeGraph) -> DataFrame:
    rows = _with_degrees(graph.nodes.filter(F.col("kind").isin(*FUNCTION_KINDS)), graph.edges)
    lines = (lines_between(F.col("start_line"), F.col("end_line")) + 1).cast("long")
    parameters = F.coalesce(F.json_array_length(F.get_json_object("properties", "$.parameters")), F.lit(0))
    return rows.select(
        "id",
        "name",
        lines.alias("line_count"),
        F.greatest(F.lit(1).cast("long"), F.col("contains_out") + 1).alias("cyclomatic"),
        F.greatest(F.lit(1).cast("long"), F.col("contains_out") + F.floor(lines / 10)).alias("cognitive"),
        parameters.cast("long").alias("parameter_count"),
        F.col("calls_out").alias("fan_out"),
        F.col("calls_in").alias("fan_in"),
    )


def module_metrics(graph: CodeGraph) -> DataFrame:
    members = graph.edges.filter("kind = 'Contains'").join(graph.nodes.select(F.col("id").alias("target_node_id"), F.col("kind").alias("member")), "target_node_id")
    members = members.groupBy(F.col("source_node_id").alias("id")).agg(F.count_if(F.col("member") == "Method").alias("num_methods"), F.count_if(F.col("member") == "Field").alias("num_fields"))
    rows = _with_degrees(graph.nodes.filter(F.col("kind").isin(*MODULE_KINDS)), graph.edges).join(members, "id", "left").fillna(0, subset=["num_methods", "num_fields"])
    both = F.col("depends_in") + F.col("depends_out")
    return rows.select(
        "id", "name", F.col("calls_in").alias("fan_in"), F.col("calls_out").alias("fan_out"), F.col("depends_in").alias("afferent"), F.col("depends_out").alias("efferent"),
        F.when(both > 0, F.col("depends_out").cast("double") / both).otherwise(0.0).alias("instability"), "num_methods", "num_fields",
    )


def aggregate_metrics(graph: CodeGraph) -> DataFrame:
    """One row. Nodes carry their own complexity, so nodes and edges are each read once."""
    nodes = graph.nodes.join(graph.edges.filter("kind = 'Contains'").groupBy(F.col("source_node_id").alias("id")).agg(F.count("*").alias("below")), "id", "left")
    function = F.col("kind").isin(*FUNCTION_KINDS)
    cyclomatic = F.when(function, F.coalesce("below", F.lit(0).cast("long")) + 1)
    one = nodes.agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("kind") == "File").alias("total_files"),
        F.coalesce(F.avg(cyclomatic), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.max(cyclomatic), F.lit(0).cast("long")).alias("max_complexity"),
        F.count_if(function).alias("function_count"),
        F.count_if(F.col("kind").isin(*MODULE_KINDS)).alias("module_count"),
    )
    return one.join(F.broadcast(graph.edges.agg(F.count("*").alias("total_edges"))))  # one row by one row


def importance(graph: CodeGraph) -> DataFrame:
    """Per node a score in [0, 1] of degree, callers, length, callees and kind. The maxima are one row, sent to all."""
    rows = _with_degrees(graph.nodes, graph.edges.select("source_node_id", "target_node_id", "kind")).withColumn("lines", lines_between(F.col("start_line"), F.col("end_line")))
    top = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.max("fan_in"), F.lit(1)).alias("max_in"), F.greatest(F.max("lines"), F.lit(1)).alias("max_lines"))
    return scored(rows.join(F.broadcast(top)))


def scored(rows: DataFrame) -> DataFrame:
    """id, name, kind and importance of rows with fan_in, fan_out, lines and, of all rows, n, max_in and max_lines."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair])[F.col("kind")], F.lit(0.5))
    degree = F.col("fan_in") + F.col("fan_out")
    part = lambda value, most: value.cast("double") / F.col(most).cast("double")
    score = part(degree, "n") * 0.3 + part(F.col("fan_in"), "max_in") * 0.2 + part(F.col("lines"), "max_lines") * 0.15 + part(F.col("fan_out"), "max_in") * 0.15 + weight * 0.1 + F.when(degree > 0, 0.1).otherwise(0.0)
    return rows.select("id", "name", "kind", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("importance"))


def complexity_band(cyclomatic: Column) -> Column:
    return F.when(cyclomatic > 10, "high").when(cyclomatic > 5, "medium").otherwise("low")
