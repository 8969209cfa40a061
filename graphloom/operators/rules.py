"""Architecture rules: layers by path patterns, and dependencies between layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import glob_regex
from graphloom.schema import CodeGraph


@dataclass(frozen=True)
class ArchRule:
    name: str
    layer: str
    patterns: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    description: str = field(default="", compare=False)


def file_layers(files: DataFrame, rules: list[ArchRule]) -> DataFrame:
    """file_id, layer: every layer with a pattern that matches the path. Rules are code, so this is one projection, not a join."""
    by_layer: dict[str, list[str]] = {}
    for rule in rules:
        by_layer.setdefault(rule.layer, []).extend(map(glob_regex, rule.patterns))
    tests = [F.when(F.col("relative_path").rlike("|".join(f"(?:{p})" for p in patterns)), layer) for layer, patterns in by_layer.items() if patterns]
    if not tests:
        return files.select(F.col("id").alias("file_id"), F.lit("").alias("layer")).limit(0)
    return files.select(F.col("id").alias("file_id"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("layer"))


def violations(graph: CodeGraph, rules: list[ArchRule]) -> DataFrame:
    """Edges from a layer to another that it does not allow, one for each rule and pair of files (of the edge with the least id).

    Of rules for one layer the first gives the name and the last the allowed layers.
    """
    names = {r.layer: r.name for r in reversed(rules)}
    allowed = {r.layer: r.allowed for r in rules}
    layers = file_layers(graph.files, rules)
    node = graph.nodes.select("id", "file_id").join(layers, "file_id")
    rows = graph.edges.select("id", "source_node_id", "target_node_id", "kind")
    for end in ("source", "target"):
        side = node.select(F.col("id").alias(f"{end}_node_id"), F.col("file_id").alias(f"{end}_file"), F.col("layer").alias(f"{end}_layer"))
        rows = rows.join(side, f"{end}_node_id")
    fine = F.col("source_layer") == F.col("target_layer")
    for layer, targets in allowed.items():
        if targets:
            fine = fine | ((F.col("source_layer") == layer) & F.col("target_layer").isin(*targets))
    rule = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("source_layer")] if names else F.lit("")
    first = rows.filter(~fine).withColumn("rule_name", rule).groupBy("rule_name", "source_file", "target_file")
    best = first.agg(F.min(F.struct("id", "source_layer", "target_layer", "kind")).alias("e"))
    return best.select("rule_name", "e.source_layer", "e.target_layer", "source_file", "target_file", F.col("e.kind").alias("edge_kind"))
