"""Benchmark results: regressions against a baseline, reports, baselines as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.expressions import format_ns
from graphloom.operators.traverse import in_ranges

SEVERITIES = ("Critical", "Significant", "Warning", "Improvement")


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Results (name, mean_ns) that differ from the baseline by more than the threshold (per cent), the worst severity first."""
    pct = (F.col("mean_ns") - F.col("base_ns")) / F.col("base_ns") * 100
    severity = F.when(pct > 50, "Critical").when(pct > 25, "Significant").when(pct > threshold, "Warning").when(pct < -threshold, "Improvement")
    rows = current.select("name", "mean_ns").join(baseline.select("name", F.col("mean_ns").alias("base_ns")), "name")
    found = rows.select("name", "base_ns", "mean_ns", pct.alias("change_pct"), severity.alias("severity")).filter("severity IS NOT NULL")
    return found.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "name")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def exit_code(found: DataFrame) -> int:
    """2 with a critical regression, 1 with a significant one, else 0."""
    n = severity_counts(found).first()
    return 2 if n["critical"] else 1 if n["significant"] else 0


def group_report(results: DataFrame) -> DataFrame:
    """By the first part of the name: results, least, most and upper median of the means."""
    counts = in_ranges(results.groupBy(F.split("name", "/")[0].alias("group_name"), "mean_ns").agg(F.count("*").alias("k")), "group_name", "mean_ns")
    groups = counts.groupBy("group_name").agg(F.sum("k").alias("n"), F.min("mean_ns").alias("min_ns"), F.max("mean_ns").alias("max_ns"))
    known = counts.filter("mean_ns IS NOT NULL")
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = known.groupBy("group_name", "part").agg(F.sum("k").alias("k")).select(F.col("group_name").alias("g"), F.col("part").alias("p"), before(W.partitionBy("group_name").orderBy("part")).alias("start"))
    inside = known.withColumn("inside", before(W.partitionBy("group_name", "part").orderBy("mean_ns")))
    placed = inside.join(ranges, F.col("group_name").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).select("g", "mean_ns", "k", (F.col("start") + F.col("inside")).alias("first"))
    middle = F.expr("n div 2")
    at = F.col("group_name").eqNullSafe(F.col("g")) & (F.col("first") <= middle) & (middle < F.col("first") + F.col("k"))
    return placed.join(F.broadcast(groups), at, "right").select("group_name", "n", "min_ns", "max_ns", F.col("mean_ns").alias("median_ns"))


#: Lines of code that the names of parse benchmarks stand for; 200 for others.
PARSED_LINES = {"typescript_small": 100, "typescript_medium": 500, "typescript_large": 5000, "python_small": 80, "python_medium": 400, "go_medium": 300, "rust_medium": 350}


def _place(n: int) -> Column:
    return F.try_element_at(F.split("name", "/"), F.lit(n))


def per_second(mean_ns: Column, count: Column | float = 1.0) -> Column:
    return F.when(mean_ns > 0, (count if isinstance(count, Column) else F.lit(count)) / mean_ns * 1e9).otherwise(0.0)


def report_lines(results: DataFrame) -> DataFrame:
    """Each result by group and rest of its name, with its mean, deviation and throughput as text. results: name, mean_ns, std_dev_ns, iterations."""
    rate = F.when(F.col("mean_ns") > 0, 1e9 / F.col("mean_ns")).otherwise(0.0)
    tenth = lambda v: F.floor(v * 10 + 0.5) / 10
    shown = F.when(rate >= 1e6, F.format_string("%.1fM ops/s", tenth(rate / 1e6))).when(rate >= 1e3, F.format_string("%.1fK ops/s", tenth(rate / 1e3))).otherwise(F.format_string("%.1f ops/s", tenth(rate)))
    rest = F.when(F.col("name").contains("/"), F.regexp_replace("name", "^[^/]*/", "")).otherwise(F.col("name"))
    return results.select(_place(1).alias("group_name"), rest.alias("benchmark"), "mean_ns", format_ns(F.col("mean_ns")).alias("mean"), F.concat(F.lit("±"), format_ns(F.col("std_dev_ns"))).alias("deviation"), "iterations", shown.alias("throughput"))


def parse_rates(results: DataFrame) -> DataFrame:
    """Estimated lines of code a second of the parse benchmarks."""
    language = F.coalesce(_place(2), F.lit("unknown"))
    lines = F.coalesce(F.create_map(*(F.lit(x) for pair in PARSED_LINES.items() for x in pair))[language], F.lit(200))
    return results.filter(F.col("name").contains("parse_throughput")).select("name", language.alias("language"), lines.alias("lines"), format_ns(F.col("mean_ns")).alias("time"), F.floor(per_second(F.col("mean_ns"), lines.cast("double")) + 0.5).alias("lines_per_second"))


def report(results: DataFrame) -> DataFrame:
    """The report's lines as section, group_name, place and text: a summary by group, the results of each group from the fastest on, and the parse rates."""
    def row(section: int, group: Column, place: Column, *cells: Column) -> list[Column]:
        return [F.lit(section).alias("section"), group.alias("group_name"), place.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text")]

    groups, lines, rates = group_report(results), report_lines(results), parse_rates(results)
    group = F.col("group_name")
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    summary = groups.select(*row(1, group, F.lit(0.0), code(group), F.col("n").cast("string"), *(format_ns(F.col(c)) for c in ("min_ns", "max_ns", "median_ns"))))
    details = lines.select(*row(2, group, F.col("mean_ns"), code(F.col("benchmark")), F.col("mean"), F.col("deviation"), F.col("iterations").cast("string"), F.col("throughput")))
    speeds = rates.select(*row(3, F.lit(""), F.lit(0.0), F.col("language"), F.format_string("~%d LOC", "lines"), F.col("time"), F.format_string("%d LOC/s", "lines_per_second")))
    return summary.unionByName(details).unionByName(speeds)


def write_report(results: DataFrame, path: str) -> None:
    """The report as text files whose lines, file after file, are in order."""
    report(results).orderBy("section", "group_name", "place", "text").select("text").write.mode("overwrite").text(path)


def save_baseline(results: DataFrame, path: str) -> None:
    """One row for each name; of repeated names the last by order of the rows' place, where there is one."""
    placed = results if "place" in results.columns else results.withColumn("place", F.monotonically_increasing_id())
    rows = placed.groupBy("name").agg(F.max_by(F.struct(*results.columns), "place").alias("r"))
    rows.select("r.*").write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, mean_ns double, std_dev_ns double, iterations long").json(path)


def read_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all new/estimates.json below a folder; the name is the path without that."""
    schema = "mean struct<point_estimate:double, standard_error:double>"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "estimates.json").option("multiLine", True).json(folder)
    path = F.col("_metadata.file_path")
    rows = rows.select(F.col("mean.point_estimate").alias("mean_ns"), F.col("mean.standard_error").alias("std_dev_ns"), path.alias("path")).filter(F.col("path").endswith("/new/estimates.json"))
    root = folder.rstrip("/").split("/")[-1]
    return rows.select(F.regexp_extract("path", f"/{root}/(.*)/new/estimates.json$", 1).alias("name"), "mean_ns", "std_dev_ns", F.lit(0).cast("long").alias("iterations"))
