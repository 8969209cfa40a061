"""Operators on the small graphs of the fixtures and on random ones."""

import math
import random
from collections import deque

import pytest

from graphloom.functions import expressions as X
from graphloom.operators import cycles, diff, export, history, incremental, lookup, metrics, plugins, regress, resolve, rules, search, traverse
from graphloom.schema import CodeGraph
from pyspark.sql import functions as F

NODE = "id long, kind string, name string, file_id long, start_line int, end_line int, properties string"
EDGE = "id long, source_node_id long, target_node_id long, kind string"
FILE = "id long, repo_root string, relative_path string, language string, hash string"


def graph(spark, nodes, edges, files=((1, "r", "src/main.rs", "rust", "h"),)):
    nodes = [(i, k, n, f, a, b, p) for i, k, n, f, a, b, p in nodes]
    return CodeGraph(spark.createDataFrame(list(files), FILE), spark.createDataFrame(nodes, NODE), spark.createDataFrame([(i, *e) for i, e in enumerate(edges, 1)], EDGE))


def functions(n):
    return [(i, "Function", f"f{i}", 1, 1, 5, "{}") for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def api3(spark):
    return graph(spark, [(1, "Function", "main", 1, 1, 5, "{}"), (2, "Function", "helper", 1, 7, 10, "{}"), (3, "Class", "Config", 1, 12, 20, "{}")], [(1, 2, "Calls"), (3, 1, "Contains")])


def test_api3(spark, api3):
    assert {r.what: r.n for r in metrics.counts(api3).collect()} == {"files": 1, "nodes": 3, "edges": 2}
    assert lookup.symbols(api3.nodes, kind="Function").count() == 2
    assert [r.name for r in search.search(api3.nodes, "helper").collect()] == ["helper"]
    assert lookup.symbol(api3.nodes, 999).count() == 0
    assert [(r.name, r.is_parent) for r in lookup.children(api3, 3).orderBy(F.desc("is_parent"), "name").collect()] == [("Config", True), ("main", False)]
    one = metrics.aggregate_metrics(api3).first()
    assert (one.function_count, one.module_count, one.total_files) == (2, 1, 0)
    assert [(r.name, r.child_count, r.importance > 0) for r in lookup.containers(api3, metrics.importance(api3)).collect()] == [("Config", 1, True)]
    assert sum(r.line.startswith("  n") and "->" in r.line for r in export.dot_lines(api3).collect()) == 2


@pytest.mark.parametrize(
    ("edges", "root", "reverse", "affected", "depth", "cycle"),
    [
        ([(1, 2), (2, 3)], 1, False, 2, 2, False),
        ([(1, 2), (2, 3)], 3, True, 2, 2, False),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], 1, False, 3, 2, True),
        ([(1, 2), (2, 3), (3, 1)], 1, False, 2, 2, True),
        ([(1, 2), (1, 2)], 1, False, 1, 1, True),
        ([(1, 1)], 1, False, 0, 0, True),
        ([(1, 2)], 9, False, 0, 0, False),
        ([(1, 77), (77, 2)], 1, False, 1, 2, False),
    ],
)
def test_impact(spark, edges, root, reverse, affected, depth, cycle):
    g = graph(spark, functions(4), [(a, b, "Calls") for a, b in edges])
    one = traverse.impact_summary(g, root, 10, reverse).first()
    assert (one.total_affected, one.max_depth, one.cycle_detected) == (affected, depth, cycle)
    assert one.root_name == ("" if root == 9 else f"f{root}")


def test_random_walks_agree_with_a_queue(spark):
    rng = random.Random(5)
    edges = [(rng.randint(1, 12), rng.randint(1, 12), rng.choice(["Calls", "Contains"])) for _ in range(30)]
    g = graph(spark, functions(12), edges)
    seen, order = {1: []}, deque([(1, 0)])
    while order:
        node, depth = order.popleft()
        for a, b, k in edges:
            if a == node and b not in seen and depth < 3:
                seen[b] = [*seen[node], k]
                order.append((b, depth + 1))
    found = {r.node_id: r.edge_path for r in traverse.impact(g, 1, 3).collect()}
    assert found == {n: p for n, p in seen.items() if n != 1}


def test_shortest_path(spark):
    g = graph(spark, functions(5), [(1, 2, "Calls"), (2, 4, "Calls"), (1, 3, "Contains"), (3, 4, "Calls")])
    assert [(r.node_id, r.depth, r.edge_path) for r in traverse.shortest_path(g, 1, 4).orderBy("depth").collect()] == [(1, 0, []), (2, 1, ["Calls"]), (4, 2, ["Calls", "Calls"])]
    assert traverse.shortest_path(g, 2, 2).count() == 0
    assert traverse.shortest_path(g, 1, 5) is None


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7)]
    g = graph(spark, [(i, "File", f"{i}.ts", i, 1, 1, "{}") for i in range(1, 8)], [(a, b, "DependsOn") for a, b in links])
    found = cycles.strong_components(cycles.file_dependencies(g))
    assert {(r.node_id, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {(r.a, r.b) for r in cycles.circular_dependencies(found).collect()} == {(1, 2), (2, 3), (4, 5)}
    snap = history.snapshot(g, 1).first()
    assert snap.circular_deps == 3 and snap.total_files == 7


IMPORTS = {
    "import { foo, bar as b } from './module';": ("Named", "./module", ["foo", "bar"]),
    "import React from 'react'": ("Default", "react", ["React"]),
    "import * as utils from './utils'": ("Wildcard", "./utils", []),
    "from pathlib import Path, PosixPath": ("Named", "pathlib", ["Path", "PosixPath"]),
    "from os import *": ("Wildcard", "os", []),
    "import os": ("Named", "os", ["os"]),
    "import a, b": ("Named", "a, b", ["a, b"]),
    "use std::collections::HashMap;": ("Use", "std::collections::HashMap", ["HashMap"]),
    "use std::collections::*;": ("Wildcard", "std::collections", []),
    "use a::{b, c};": ("Use", "a::{b, c}", ["{b, c}"]),
    'import "fmt"': ("Named", "fmt", []),
    "import java.util.List;": ("Named", "java.util.List", ["java.util.List"]),
    "#include <stdio.h>": ("Named", "#include <stdio.h>", []),
    "from m import a as b": ("Named", "m", ["a as b"]),
}


def test_parse_import(spark):
    rows = spark.createDataFrame([(t,) for t in IMPORTS], "t string").select("t", X.parse_import(F.col("t")).alias("i")).collect()
    assert {r.t: (r.i.kind, r.i.module, r.i.names) for r in rows} == IMPORTS


def test_expressions(spark):
    paths = {"a.ts": "typescript", "b.TSX": "tsx", "x/y.hpp": "cpp", "Makefile": None, ".py": None, "a.b/c": None, "q.MJS": "javascript"}
    assert {r.p: r.l for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.language_of(F.col("p")).alias("l")).collect()} == paths
    globs = [("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/x/y.ts", True), ("src/*.ts", "src/x/y.ts", False), ("src/**/app.ts", "src/myapp.ts", True), ("a?b", "a/b", True), ("a.b", "axb", False)]
    for glob, path, match in globs:
        assert spark.range(1).select(X.matches_glob(F.lit(path), glob).alias("m")).first().m is match
    shown = spark.createDataFrame([(5.0,), (1500.0,), (2.5e6,), (3e9,)], "v double").select(X.format_ns(F.col("v")).alias("s")).collect()
    assert [r.s for r in shown] == ["5.00ns", "1.50µs", "2.50ms", "3.00s"]
    counts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb\n",)], "v string").select(X.line_count(F.col("v")).alias("n")).collect()
    assert [r.n for r in counts] == [0, 0, 1, 2]
    spans = spark.range(1).select(*[lookup.span_contains(*(F.lit(x) for x in s)).alias(f"c{i}") for i, s in enumerate([(1, 1, 3, 5, 3, 5), (1, 1, 3, 5, 3, 6), (2, 2, 2, 2, 2, 2)])]).first()
    assert tuple(spans) == (True, False, False)


def test_resolution_kinds(spark):
    nodes = [(1, "Function", "foo", 1, 1, 2, "{}"), (2, "Anonymous", "foo", 1, 3, 3, "{}"), (3, "Anonymous", "println", 1, 4, 4, "{}"), (4, "Anonymous", "bar", 1, 5, 5, "{}"), (5, "Anonymous", "lost", 1, 6, 6, "{}"), (6, "Import", "import { bar, foo } from './m'", 1, 7, 7, "{}"), (7, "Macro", "gone", 1, 8, 8, "{}")]
    g = graph(spark, nodes, [(2, 1, "References"), (3, 1, "References"), (4, 1, "References"), (5, 1, "References"), (1, 7, "Calls")])
    assert {(r.source_node_id, r.kind) for r in resolve.resolve_references(g).collect()} == {(2, "Local"), (3, "Builtin"), (4, "Module")}
    assert {(r.kind, r.ref_name, r.target_name) for r in resolve.broken_refs(g).collect()} == {("UnresolvedRef", "lost", None), ("UnresolvedCall", "gone", None), ("DeadImport", "bar", "./m")}


def test_rules(spark):
    files = [(1, "r", "ui/a.ts", "typescript", "h"), (2, "r", "service/b.ts", "typescript", "h"), (3, "r", "storage/c.ts", "typescript", "h")]
    nodes = [(i, "Function", f"f{i}", i, 1, 1, "{}") for i in (1, 2, 3)]
    layers = [rules.ArchRule("ui", "ui", ("ui/**",), ("service",)), rules.ArchRule("service", "service", ("service/**",), ("storage",)), rules.ArchRule("storage", "storage", ("storage/**",))]
    fine = graph(spark, nodes, [(1, 2, "Calls"), (2, 3, "Calls"), (1, 1, "Calls")], files)
    assert rules.violations(fine, layers).count() == 0
    bad = rules.violations(graph(spark, nodes, [(1, 3, "Calls"), (1, 3, "Contains")], files), layers).collect()
    assert [(r.rule_name, r.source_layer, r.target_layer, r.edge_kind) for r in bad] == [("ui", "ui", "storage", "Calls")]


def test_plugins(spark):
    g = graph(spark, [(1, "Function", "TODO_fix", 1, 1, 1, "{}"), *[(i, "Method", f"m{i}", 1, 1, 1, "{}") for i in range(2, 7)]], [(1, 2, "Calls")])
    registry = plugins.Registry()
    registry.register("broken", lambda graph: 1 / 0)
    found = registry.run_all(g).collect()
    assert {(r.plugin, r.rule) for r in found} == {("pattern-checker", "todo_fixme"), ("metrics-summary", "summary"), ("metrics-summary", "oop_ratio")}
    assert registry.names()[-1] == "broken"


def test_regressions(spark, tmp_path):
    base = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", 100.0), ("e", 100.0)], "name string, mean_ns double")
    now = spark.createDataFrame([("a", 200.0), ("b", 115.0), ("c", 80.0), ("d", 105.0), ("new", 1.0), ("e", 130.0)], "name string, mean_ns double")
    found = regress.regressions(now, base)
    assert [(r.name, r.severity) for r in found.collect()] == [("a", "Critical"), ("e", "Significant"), ("b", "Warning"), ("c", "Improvement")]
    assert regress.exit_code(found) == 2
    regress.save_baseline(base, str(tmp_path / "base"))
    assert regress.load_baseline(spark, str(tmp_path / "base")).count() == 5
    (tmp_path / "crit/g/x/new").mkdir(parents=True)
    (tmp_path / "crit/g/x/new/estimates.json").write_text('{"mean": {"point_estimate": 12.5, "standard_error": 0.5}}')
    assert regress.read_estimates(spark, str(tmp_path / "crit")).first()[:2] == ("g/x", 12.5)


def test_diff(spark):
    text = "diff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n+new\n-old\n+more\ndiff --git a/y b/y\n+one\n"
    rows = diff.diff_files(spark.createDataFrame([(1, text), (2, "")], "id int, t string"), "id", "t")
    assert {(r.file, r.additions, r.deletions) for r in rows.collect()} == {("x.rs", 2, 1), ("y", 1, 0)}
    assert diff.diff_totals(rows, "id").first()[1:] == (2, 3, 1)


def test_cascade(spark):
    files = [(1, "r", "a", "c", "h"), (2, "r", "b", "c", "h")]
    g = graph(spark, [(1, "Function", "x", 1, 1, 1, "{}"), (2, "Function", "y", 2, 1, 1, "{}")], [(1, 2, "Calls"), (2, 2, "Calls")], files)
    g.edges = g.edges.withColumn("file_id", F.lit(1).cast("long"))
    left = incremental.remove_files(g, g.files.filter("id = 1"))
    assert (left.files.count(), left.nodes.count()) == (1, 1)
    assert [(r.id, r.file_id) for r in left.edges.collect()] == [(2, None)]


def test_ranked_search_and_like(spark):
    rows = [(1, "Function", "get_user", 1, 1, 1, "{}"), (2, "Function", "user_user", 1, 1, 1, "{}"), (3, "Function", "getUserById", 1, 1, 1, "{}")]
    nodes = spark.createDataFrame(rows, NODE)
    assert [r.id for r in search.search(nodes, "user").collect()] == [1, 2]
    assert [r.id for r in search.search_ranked(nodes, "user").collect()] == [2, 1]
    assert [r.name for r in search.search(nodes, "ById").collect()] == ["getUserById"]
    assert [r.name for r in lookup.symbols(nodes, name="%USER%").collect()] == ["getUserById", "get_user", "user_user"]


def test_exports(spark, api3, tmp_path):
    for name in ("g.json", "g.csv", "g.dot"):
        export.export(api3, str(tmp_path / name))
    assert spark.read.text(str(tmp_path / "g.json")).count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "g.csv/nodes")).count() == 3
    with pytest.raises(ValueError):
        export.export(api3, "x.png")
    odd = spark.createDataFrame([('a,"b"', 1)], "x string, y int")
    assert export.csv_lines(odd, ["x", "y"]).first().line == '"a,""b""",1'


def test_benchmark_report(spark, tmp_path):
    rows = [("g/fast", 250.0, 10.0, 7), ("g/slow", 2_500_000.0, 0.0, 1), ("parse_throughput/go_medium/1", 3_000.0, 1.0, 2), ("plain", 0.0, 0.0, 0)]
    results = spark.createDataFrame(rows, "name string, mean_ns double, std_dev_ns double, iterations long")
    lines = {r.benchmark: (r.group_name, r.mean, r.deviation, r.throughput) for r in regress.report_lines(results).collect()}
    assert lines["fast"] == ("g", "250.00ns", "±10.00ns", "4.0M ops/s") and lines["slow"] == ("g", "2.50ms", "±0.00ns", "400.0 ops/s") and lines["plain"][3] == "0.0 ops/s"
    assert [(r.language, r.lines, r.lines_per_second) for r in regress.parse_rates(results).collect()] == [("go_medium", 300, 100_000_000)]
    regress.write_report(results, str(tmp_path / "report"))
    text = [line for part in sorted((tmp_path / "report").glob("part-*")) for line in part.read_text().splitlines()]
    assert text == [
        "| `g` | 2 | 250.00ns | 2.50ms | 2.50ms |", "| `parse_throughput` | 1 | 3.00µs | 3.00µs | 3.00µs |", "| `plain` | 1 | 0.00ns | 0.00ns | 0.00ns |", "| `fast` | 250.00ns | ±10.00ns | 7 | 4.0M ops/s |",
        "| `slow` | 2.50ms | ±0.00ns | 1 | 400.0 ops/s |", "| `go_medium/1` | 3.00µs | ±1.00ns | 2 | 333.3K ops/s |", "| `plain` | 0.00ns | ±0.00ns | 0 | 0.0 ops/s |", "| go_medium | ~300 LOC | 3.00µs | 100000000 LOC/s |",
    ]


def test_imports_edges_without_an_import_node(spark):
    """An Imports edge counts where no import node of its file names the same module."""
    nodes = spark.createDataFrame([(1, "Import", "import os", 1, 1), (2, "Function", "f", 1, 5), (3, "Module", "os", 2, 1), (4, "Module", "other", 2, 9)], "id long, kind string, name string, file_id long, start_line int")
    edges = spark.createDataFrame([(1, 2, 3, "Imports"), (2, 2, 4, "Imports"), (3, 4, 3, "Imports")], "id long, source_node_id long, target_node_id long, kind string")
    found = resolve.imports(CodeGraph(nodes, nodes, edges)).collect()
    assert sorted((r.file_id, r.node_id, r.kind, r.module, tuple(r.names)) for r in found) == [(1, 1, "Named", "os", ("os",)), (1, 2, "Named", "other", ()), (2, 4, "Named", "os", ())]


def test_durations_round_the_exact_number(spark):
    """As printf does: 1.005 is a little less than that, 0.125 lies half-way, 0.995 and more carry over."""
    values = [1005.0, 1115.0, 2675.0, 1125.0, 1375.0, 999_996.0, 1000.0, 1_002_500.0, 1e9, 59_999_995e3, 0.125, 0.01, 0.0, 999.996, 123_456_789_012_345.0]
    draw = random.Random(3)
    values += [draw.randrange(1, 10**9) * 5.0 for _ in range(300)]
    shown = {r.v: r.s for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", X.format_ns(F.col("v")).alias("s")).collect()}
    unit = lambda v: (1e9, "s") if v >= 1e9 else (1e6, "ms") if v >= 1e6 else (1e3, "µs") if v >= 1e3 else (1.0, "ns")
    assert shown == {v: "%.2f%s" % (v / unit(v)[0], unit(v)[1]) for v in values}


def test_throughput_is_of_the_mean_at_once(spark):
    """1e9 / mean, rounded once: for 57 ns 17543859.6 and not what 1 / 57 times 1e9 may give."""
    means = [float(m) for m in range(1, 4000)]
    rows = spark.createDataFrame([(f"g/{m}", m, m, 1) for m in means], "name string, mean_ns double, std_dev_ns double, iterations int")
    found = {r.mean_ns: r.throughput for r in regress.report_lines(rows).collect()}
    shown = lambda r: f"{math.floor(r / 1e6 * 10 + 0.5) / 10:.1f}M" if r >= 1e6 else f"{math.floor(r / 1e3 * 10 + 0.5) / 10:.1f}K"
    assert found == {m: shown(1e9 / m) + " ops/s" for m in means}


def test_symbols_without_a_limit_are_all(spark):
    nodes = spark.range(60_000).select("id", F.lit("Function").alias("kind"), F.lit("red_rod").alias("name"), F.lit(3).cast("long").alias("file_id"))
    assert lookup.symbols(nodes, name="RED%r", limit=None).count() == lookup.symbols(nodes, file_id=3, limit=None).count() == 60_000
    assert lookup.symbols(nodes, file_id=3).count() == 50_000 and lookup.symbols(nodes, file_id=3, limit=None, offset=59_990).count() == 10
