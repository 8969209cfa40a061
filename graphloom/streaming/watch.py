"""Watching a source folder: change events, debounced by event time, each batch brings the stored graph up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.expressions import language_of
from graphloom.operators.store import GraphStore
from graphloom.operators.traverse import checkpoint
from graphloom.plans.index import refresh
from graphloom.sources.files import EXCLUDED, discover, wanted

#: So many changed paths of a batch are read by name.
MOST_PATHS = 10_000
EVENTS = "ts timestamp, repo_root string, relative_path string, event string"


def is_watchable(path: Column) -> Column:
    """A path of a known language that no rule leaves out; excluded folders count at any depth."""
    inside = F.lit(False)
    for name in EXCLUDED:
        inside = inside | path.contains(f"/{name}/") | path.startswith(f"{name}/")
    return language_of(path).isNotNull() & wanted(path) & ~inside


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events from JSON files that a notifier drops into a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Bursts of changes of one repository (null: ""), closed by a quiet gap of event time: first and last time, and the paths.

    The same for a stream and a table. State is one row for each open burst of a repository.
    """
    rows = events.filter(is_watchable(F.col("relative_path"))).withWatermark("ts", late)
    rows = rows.withColumn("repo_root", F.coalesce("repo_root", F.lit("")))
    burst = rows.groupBy("repo_root", F.session_window("ts", gap).alias("w")).agg(F.collect_set("relative_path").alias("paths"), F.count("*").alias("n_events"))
    return burst.select("repo_root", F.col("w.start").alias("first_ts"), F.col("w.end").alias("last_ts"), "paths", "n_events")


def reindexer(spark: SparkSession, root: str, store: str, log: str | None = None, most_paths: int = MOST_PATHS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch with bursts brings the graph in store up to date. Only the batch's paths are read, and compared with the store's files by hash; past most_paths the folder is walked instead, with the same result.

    Repeating a batch changes nothing. An event is written for a batch that changed the graph.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = checkpoint(batch.select(F.explode("paths").alias("relative_path")).distinct())
        named = [r["relative_path"] for r in paths.limit(most_paths + 1).collect()]
        if not named:
            return
        some = len(named) <= most_paths and GraphStore(spark, store).generation() > 0
        done = refresh(spark, discover(spark, root, paths=named if some else None), store, examined=paths if some else None).filter("version > 0")
        if log and not done.isEmpty():
            event = done.select(F.lit("index_updated").alias("event"), F.lit(batch_id).alias("batch"), "files_changed", "nodes_removed", F.concat(F.lit("graph is at version "), "version").alias("message"))
            event.write.mode("append").json(log)

    return run


def watch(spark: SparkSession, events: str, root: str, store: str, state: str, log: str | None = None, every: str = "500 milliseconds") -> StreamingQuery:
    """Starts the watch; state is its checkpoint folder."""
    bursts = debounced(change_events(spark, events))
    return bursts.writeStream.outputMode("append").foreachBatch(reindexer(spark, root, store, log)).option("checkpointLocation", state).trigger(processingTime=every).start()
