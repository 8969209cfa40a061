"""Ignore files: each rules the paths below its folder, and the nearest, and in it the last, rule that fits decides.

Paths and rules meet in a join on folder: a path is tried by the rules of each folder around
it, and the greatest of (depth of the rule's folder, kind of file, line) wins. What lies in an ignored folder
is ignored, whatever rules say of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of ignore files; of two in a folder, the rules of the later name go before those of the other.
IGNORE_FILES = (".gitignore", ".ignore")


#: Private marks that stand for parts of a pattern while the rest is written as a regular expression, and what they mean.
MARKS = {"\ue001": "(?:.*/)?", "\ue002": "/.+", "\ue003": "[^/]*", "\ue004": "[^", "\ue011": r"\\*", "\ue012": r"\\?", "\ue013": r"\\["}


def glob_regex(body: Column) -> Column:
    """A regular expression for a pattern without negation and closing slash, for the path from the rule's folder on."""
    tied = body.contains("/")
    text = F.regexp_replace(body, "^/", "")
    for shape, put in (
        (r"\\\*", "\ue011"), (r"\\\?", "\ue012"), (r"\\\[", "\ue013"), (r"\\(.)", "$1"), (r"\[[!^]", "\ue004"), (r"([.+^$(){}|])", r"\\$1"),
        (r"(^|/)(?:\*\*/)+", "$1\ue001"), (r"/\*\*$", "\ue002"), (r"\*+", "\ue003"), (r"\?", "[^/]"), *MARKS.items(),
    ):
        text = F.regexp_replace(text, shape, put)
    return F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), text, F.lit("$"))


def rules_of(files: DataFrame) -> DataFrame:
    """folder, place, pattern, negated and folders_only of each rule. files: relative_path and content of ignore files."""
    name = F.substring_index("relative_path", "/", -1)
    rows = files.filter(name.isin(*IGNORE_FILES)).select(F.regexp_replace("relative_path", r"/?[^/]*$", "").alias("folder"), F.array_position(F.array(*map(F.lit, IGNORE_FILES)), name).alias("kind"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.when(F.col("text").rlike(r"\\ +$"), F.col("text")).otherwise(F.regexp_replace("text", r"[ \t]+$", ""))
    rows = rows.withColumn("text", text).filter("text <> '' and not startswith(text, '#')")
    negated = F.col("text").startswith("!")
    body = F.regexp_replace(F.when(negated, F.substr("text", F.lit(2))).otherwise(F.col("text")), r"^\\([#!])", "$1")
    only = body.endswith("/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    pattern = glob_regex(F.regexp_replace(body, "/$", ""))
    return rows.select("folder", F.struct(depth.alias("depth"), "kind", "line").alias("place"), pattern.alias("pattern"), negated.alias("negated"), only.alias("folders_only")).filter(pattern != "^(?:.*/)?$")


def folders_around(path: Column) -> Column:
    """The folders around a path, the outermost ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of paths (relative_path, of files) that are ignored."""
    own = paths.select("relative_path").distinct()
    around = own.select("relative_path", F.explode(folders_around(F.col("relative_path"))).alias("path"))
    things = own.select(F.col("relative_path").alias("path"), F.lit(False).alias("is_folder")).union(around.filter("path <> ''").select("path", F.lit(True))).distinct()
    tried = things.select("path", "is_folder", F.explode(folders_around(F.col("path"))).alias("folder")).join(rules, "folder")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    fits = tried.filter((~F.col("folders_only") | F.col("is_folder")) & F.rlike(rest, F.col("pattern")))
    out = fits.groupBy("path", "is_folder").agg(F.max_by("negated", "place").alias("negated")).filter("not negated").select("path", "is_folder")
    every = around.withColumn("is_folder", F.lit(True)).union(own.select("relative_path", F.col("relative_path").alias("path"), F.lit(False)))
    return every.join(out, ["path", "is_folder"], "left_semi").select("relative_path").distinct()
