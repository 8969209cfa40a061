"""Snapshots of a graph's metrics and their trends: append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.cycles import file_dependencies, strong_components
from graphloom.operators.metrics import aggregate_metrics
from graphloom.schema import CodeGraph

METRICS = ("total_nodes", "total_edges", "total_files", "avg_complexity", "max_complexity", "circular_deps")


def snapshot(graph: CodeGraph, snapshot_id: int, commit: str | None = None) -> DataFrame:
    """One row of the snapshots table."""
    pairs = strong_components(file_dependencies(graph)).groupBy("component").agg((F.count("*") - 1).alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("int").alias("circular_deps"))
    one = aggregate_metrics(graph).join(F.broadcast(pairs))
    return one.select(
        F.lit(snapshot_id).cast("long").alias("id"), F.current_timestamp().alias("timestamp"), F.lit(commit).cast("string").alias("commit_hash"),
        "total_files", "total_nodes", "total_edges", "avg_complexity", F.col("max_complexity").cast("int").alias("max_complexity"), "circular_deps",
    )


def metric_rows(snapshots: DataFrame) -> DataFrame:
    """The six metrics of each snapshot as rows of the metric history."""
    pairs = [F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in METRICS]
    return snapshots.select(F.col("id").alias("snapshot_id"), F.explode(F.array(*pairs)).alias("m")).select("snapshot_id", "m.*")


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("id"))


def get_snapshot(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    return snapshots.filter(F.col("id") == snapshot_id)


def latest_commit(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("id")).limit(1).select("commit_hash")


def trend(snapshots: DataFrame, history: DataFrame, metric: str) -> DataFrame:
    """Times and values of a metric, the oldest snapshot first."""
    rows = history.filter(F.col("metric_name") == metric).join(snapshots.select(F.col("id").alias("snapshot_id"), "timestamp"), "snapshot_id")
    return rows.orderBy("snapshot_id").select("snapshot_id", "timestamp", F.col("metric_value").alias("value"))
