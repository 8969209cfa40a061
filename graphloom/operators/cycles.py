"""Strongly connected components among file nodes, by trimming and colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.operators.traverse import checkpoint, in_ranges
from graphloom.schema import CodeGraph


def file_dependencies(graph: CodeGraph) -> DataFrame:
    """DependsOn edges between file nodes: a, b."""
    files = graph.nodes.filter("kind = 'File'").select(F.col("id").alias("f"))
    edges = graph.edges.filter("kind = 'DependsOn'").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    return edges.join(files, edges.a == files.f, "left_semi").join(files, edges.b == files.f, "left_semi").filter("a <> b").distinct()


def _spread(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node along links (a to b): node, label."""
    while True:
        near = links.join(labels, links.a == labels.node).groupBy("b").agg(F.min("label").alias("near"))
        turned = checkpoint(labels.join(near, labels.node == near.b, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new")))
        labels = turned.select("node", F.col("new").alias("label"))
        if turned.filter("new < label").isEmpty():
            return labels


def strong_components(links: DataFrame) -> DataFrame:
    """Components of two nodes or more: node_id, component (its least node).

    Nodes without a way in or out are trimmed. Each other node takes as its
    colour the least node that reaches it; what of a colour also reaches that node is
    a component. Links between colours join no component and go; then again.
    """
    links, done = checkpoint(links), None
    while True:
        while True:
            into, out = links.select(F.col("b").alias("n")).distinct(), links.select(F.col("a").alias("n")).distinct()
            left = checkpoint(links.join(into, links.a == into.n, "left_semi").join(out, links.b == out.n, "left_semi"))
            trimmed, links = links.count() - left.count(), left
            if not trimmed:
                break
        if links.isEmpty():
            return done if done is not None else links.select(F.col("a").alias("node_id"), F.col("b").alias("component")).limit(0)
        nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
        colours = _spread(links, nodes.withColumn("label", F.col("node")))
        a, b = (colours.select(F.col("node").alias(x), F.col("label").alias(f"{x}_colour")) for x in ("a", "b"))
        links = checkpoint(links.join(a, "a").join(b, "b").filter("a_colour = b_colour"))
        # Backward from the colour's own node, inside the colour.
        back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        far = F.lit((1 << 63) - 1)
        home = _spread(back, colours.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).otherwise(far).alias("label")))
        found = checkpoint(home.filter(F.col("label") != far).select(F.col("node").alias("node_id"), F.col("label").alias("component")))
        large = found.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1").select("component")
        found_large = found.join(large, "component", "left_semi").select("node_id", "component")
        done = found_large if done is None else done.union(found_large)
        gone = found.select("node_id")
        links = checkpoint(links.select("a", "b").join(gone, links.a == gone.node_id, "left_anti").join(gone, links.b == gone.node_id, "left_anti"))


def circular_dependencies(components: DataFrame) -> DataFrame:
    """Neighbours by id inside each component: a component of n nodes gives n - 1 pairs."""
    rows = in_ranges(components, "component", "node_id")
    # The last of a range is followed by the first of the component's next range.
    starts = rows.groupBy("component", "part").agg(F.min("node_id").alias("least"))
    nexts = starts.select("component", "part", F.lead("least").over(W.partitionBy("component").orderBy("part")).alias("after")).filter("after IS NOT NULL")
    follow = F.lead("node_id").over(W.partitionBy("component", "part").orderBy("node_id"))
    pairs = rows.select("component", "part", F.col("node_id").alias("a"), follow.alias("b")).join(F.broadcast(nexts), ["component", "part"], "left")
    return pairs.select("a", F.coalesce("b", "after").alias("b")).filter("b IS NOT NULL")
