"""Findings over a graph. A plugin is a function from a graph to findings; built-in ones check name patterns and sum up."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import search_tokens
from graphloom.operators.traverse import checkpoint
from graphloom.schema import CodeGraph

FINDINGS = "severity string, message string, file string, line int, symbol string, rule string"


@dataclass(frozen=True)
class PatternRule:
    """pattern: literal parts of a name, between bars."""

    name: str
    pattern: str
    severity: str
    message: str


# Fixed value: the rule for unfinished code.
DEFAULT_RULES = (PatternRule("todo_fixme", "TODO|FIXME|HACK", "Warning", "Found TODO/FIXME marker"),)


def pattern_findings(graph: CodeGraph, rules: tuple[PatternRule, ...] = DEFAULT_RULES) -> DataFrame:
    """One finding for each rule and node whose name holds one of the rule's parts."""
    hits = []
    for i, rule in enumerate(rules):
        test = F.lit(False)
        for part in rule.pattern.split("|"):
            test = test | F.col("name").contains(part)
        finding = F.struct(F.lit(i).alias("place"), F.lit(rule.severity).alias("severity"), F.concat(F.lit(f"{rule.message}: "), "name").alias("message"), F.lit(rule.name).alias("rule"))
        hits.append(F.when(test, finding))
    rows = graph.nodes.select("id", "name", "start_line", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("f"))
    return rows.select("f.severity", "f.message", F.lit(None).cast("string").alias("file"), F.col("start_line").cast("int").alias("line"), F.col("name").alias("symbol"), "f.rule")


def summary_findings(graph: CodeGraph, many: int = 50_000, ratio: float = 0.8) -> DataFrame:
    """The summary, and warnings of very many symbols and of a high share of methods, in one row of counts."""
    files = graph.files.agg(F.count("*").alias("files"))
    edges = graph.edges.agg(F.count("*").alias("edges"))
    one = graph.nodes.agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "Function").alias("functions"), F.count_if(F.col("kind") == "Method").alias("methods"))
    one = one.join(F.broadcast(files)).join(F.broadcast(edges))  # one row each
    mean = F.when(F.col("files") > 0, F.col("symbols") / F.col("files")).otherwise(0.0)
    share = F.when(F.col("functions") + F.col("methods") > 0, F.col("methods") / (F.col("functions") + F.col("methods"))).otherwise(0.0)
    found = lambda severity, rule, *text: F.struct(F.lit(severity).alias("severity"), F.format_string(*text).alias("message"), F.lit(rule).alias("rule"))
    findings = F.array(
        found("Info", "summary", "Repository summary: %d files, %d symbols, %d edges (avg %.1f symbols/file)", "files", "symbols", "edges", mean),
        F.when(F.col("symbols") > many, found("Warning", "large_codebase", "High symbol count (%d) — consider splitting large modules", "symbols")),
        F.when(share > ratio, found("Info", "oop_ratio", "High method ratio (%.0f%%) — strongly object-oriented codebase", share * 100)),
    )
    rows = one.select(F.explode(F.filter(findings, lambda f: f.isNotNull())).alias("f"))
    none = F.lit(None)
    return rows.select("f.severity", "f.message", none.cast("string").alias("file"), none.cast("int").alias("line"), none.cast("string").alias("symbol"), "f.rule")


Plugin = Callable[[CodeGraph], DataFrame]
#: Packages name their plugins under this group: each a function of a graph that returns findings.
ENTRY_POINTS = "graphloom.plugins"


@dataclass
class Registry:
    """Plugins by name, in order of registration. One that fails is logged and left out; the others run."""

    plugins: dict[str, Plugin] = field(default_factory=lambda: {"pattern-checker": pattern_findings, "metrics-summary": summary_findings})

    def register(self, name: str, plugin: Plugin) -> None:
        self.plugins[name] = plugin

    def names(self) -> list[str]:
        return list(self.plugins)

    def discover(self, group: str = ENTRY_POINTS) -> list[str]:
        """Registers the plugins that installed packages name under this group of entry points, by name; one that cannot be loaded is logged and left out. Names of what was registered."""
        found = []
        for point in sorted(entry_points(group=group), key=lambda p: p.name):
            try:
                self.register(point.name, point.load())
                found.append(point.name)
            except Exception:  # whatever a package raises when it is imported
                logging.getLogger(__name__).exception("plugin %s cannot be loaded", point.name)
        return found

    def run_all(self, graph: CodeGraph) -> DataFrame:
        """Findings of all plugins. Each is run by itself into the checkpoint folder, so one whose plan or rows fail takes nothing with it."""
        out = graph.nodes.sparkSession.createDataFrame([], f"plugin string, {FINDINGS}")
        for name, plugin in self.plugins.items():
            try:
                found = checkpoint(plugin(graph).select(F.lit(name).alias("plugin"), "severity", "message", "file", "line", "symbol", "rule"))
                out = out.unionByName(found)
            except Exception:  # a plugin's own error, of any kind
                logging.getLogger(__name__).exception("plugin %s failed", name)
        return out


def high_impact(changed_paths: DataFrame, nodes: DataFrame, many: int = 10) -> DataFrame:
    """Changed files all terms of whose base name are in more than so many names. Both are cut into their terms, so this is an equi-join."""
    base = F.array_distinct(search_tokens(F.regexp_extract("relative_path", r"([^/]+?)(\.[^./]*)?$", 1)))
    parts = nodes.select("id", F.explode(F.array_distinct(search_tokens(F.col("name")))).alias("part"))
    terms = changed_paths.select("relative_path").distinct().select("relative_path", F.size(base).alias("terms"), F.explode(base).alias("part"))
    rows = terms.join(parts, "part").groupBy("relative_path", "terms", "id").agg(F.count("*").alias("found")).filter("found = terms")
    return rows.groupBy("relative_path").agg(F.count("*").alias("n")).filter(F.col("n") > many)
