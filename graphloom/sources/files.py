"""Source files as tables: discovery with hidden, excluded and ignored paths left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401 (used as pa.fs)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.expressions import language_of, line_count
from graphloom.sources.ignore import IGNORE_FILES, ignored_paths, rules_of

# Folders that are left out at the root, beside the index's own.
EXCLUDED = (".git", "node_modules", "target", "build", "dist", ".graphloom", ".claude")
MOST_BYTES = 10 << 20


def ignore_regex(pattern: str) -> str:
    """Pattern of a line of an ignore file: a slash inside or in front ties it to the root, one at the end to folders."""
    body = pattern.rstrip("/")
    tied = "/" in body
    shapes = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    text = "".join(shapes.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body.lstrip("/")))
    return ("^" if tied else "(?:^|.*/)") + text + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Of the lines that match, the last decides; one with "!" takes a path back in."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if line and not line.startswith("#"):
            out = F.when(path.rlike(ignore_regex(line.removeprefix("!"))), F.lit(not line.startswith("!"))).otherwise(out)
    return out


def wanted(path: Column, exclude: tuple[str, ...] = EXCLUDED, patterns: list[str] | None = None) -> Column:
    """path: relative to the root. No part may start with a dot; an excluded name counts only at the root."""
    keep = ~path.rlike(r"(^|/)\.")
    for name in exclude:
        keep = keep & (path != name) & ~path.startswith(f"{name}/")
    return keep & ~ignored(path, patterns or [])


def excluded_anywhere(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder on the path, at any depth, has one of the names."""
    return path.rlike("(^|/)(" + "|".join(map(re.escape, names)) + ")/")


def beside_spark(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length and content of files whose names Spark's own reader passes over: those that begin with an underscore, and ignore files.

    They are found by name patterns, one folder depth after the other, and read in tasks by Arrow's file systems.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, depth, names = [], root.rstrip("/"), "{_*," + ",".join(IGNORE_FILES) + "}"
    while True:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{depth}/{names}")) or []:
            if status.isFile():
                found.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
        if not any(s.isDirectory() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{depth}/*")) or []):
            break
        depth += "/*"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, place = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with source.open_input_stream(place) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stream.read()], pa.binary())], names=["path", "content"])

    listed = spark.createDataFrame(found, "path string, at long, length long")
    contents = listed.select("path").mapInArrow(read, "path string, content binary")
    return listed.join(contents, "path").select("path", F.timestamp_millis("at").alias("modificationTime"), "length", "content")


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED, patterns: list[str] | None = None, most_bytes: int | None = None, content: bool = True, anywhere: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Files of known languages below root: repo_root, relative_path, language, hash, size, line_count, last_modified, and the content if wanted.

    Ignore files below root count (ignore.py), then patterns. anywhere: excluded names count at any depth, and files
    beyond MOST_BYTES are left out. paths: only these, which need no walk; ignore files are still looked for.
    """
    base = root.rstrip("/")
    hidden = beside_spark(spark, root)
    if paths is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    else:
        jvm = spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f"{base}/{p}" for p in paths if not p.rpartition("/")[2].startswith(("_", ".")) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{p}"))]
        files = spark.read.format("binaryFile").load(there) if there else hidden.limit(0)
    every = files.select("path", "modificationTime", "length", "content").unionByName(hidden)
    every = every.withColumn("relative_path", F.element_at(F.split("path", re.escape(base) + "/", 2), -1)).withColumn("language", language_of(F.col("relative_path")))
    rows = every.filter(F.col("language").isNotNull() & wanted(F.col("relative_path"), exclude, patterns))
    if paths is not None:
        rows = rows.filter(F.col("relative_path").isin(paths))
    if anywhere:
        rows, most_bytes = rows.filter(~excluded_anywhere(F.col("relative_path"), exclude)), MOST_BYTES if most_bytes is None else most_bytes
    if most_bytes is not None:
        rows = rows.filter(F.col("length") <= most_bytes)
    rules = rules_of(hidden.withColumn("relative_path", F.element_at(F.split("path", re.escape(base) + "/", 2), -1)).select("relative_path", F.col("content").cast("string").alias("content")))
    rows = rows.join(ignored_paths(rows.select("relative_path"), rules), "relative_path", "left_anti")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = rows.select(
        F.lit(root).alias("repo_root"), "relative_path", "language", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"),
        line_count(text).alias("line_count"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified"), text.alias("content"),
    )
    return rows if content else rows.drop("content")
