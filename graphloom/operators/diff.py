"""Unified diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.expressions import language_of
from graphloom.schema import CodeGraph


def diff_files(diffs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each diff and file: additions, deletions and change_type (always Modified). The file is what follows the last " b/" of its header; lines before a header count nowhere."""
    lines = diffs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
    header = F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r"^.* b/(.*)$", 1))
    rows = lines.withColumn("file", F.last(header, ignorenulls=True).over(W.partitionBy(id_col).orderBy("place"))).filter("file IS NOT NULL")
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    return rows.groupBy(id_col, "file").agg(F.count_if(plus).alias("additions"), F.count_if(minus).alias("deletions")).withColumn("change_type", F.lit("Modified"))


def diff_totals(found: DataFrame, id_col: str) -> DataFrame:
    return found.groupBy(id_col).agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def affected_symbols(found: DataFrame, graph: CodeGraph) -> DataFrame:
    """The symbols of each changed file, with the file's language."""
    files = graph.files.select(F.col("relative_path").alias("file"), F.col("id").alias("file_id"))
    return found.join(files, "file").join(graph.nodes.select("file_id", "name", "kind"), "file_id").withColumn("language", language_of(F.col("file")))
