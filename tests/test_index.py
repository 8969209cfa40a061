"""Discovery, stored versions, incremental refresh and the watch stream."""

import json
import pathlib
import time

from graphloom.operators import metrics, search, traverse
from graphloom.operators.store import GraphStore
from graphloom.plans.index import refresh
from graphloom.sources.files import discover, ignored
from graphloom.sources.workspace import Workspace
from graphloom.streaming.watch import is_watchable, watch
from pyspark.sql import functions as F


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def names(graph):
    return {(r.kind, r.name) for r in graph.nodes.collect()}


def test_discover(spark, tmp_path):
    write(tmp_path, a_dot_py="def f():\n  pass\n", target__b_dot_py="", sub__target__c_dot_py="x", _dot_hidden__d_dot_py="", e_dot_txt="", gen__f_dot_js="//")
    found = {r.relative_path: r for r in discover(spark, str(tmp_path), patterns=["*.js", "!keep.js"]).collect()}
    assert set(found) == {"a.py", "sub/target/c.py"}
    assert (found["a.py"].line_count, len(found["a.py"].hash), found["a.py"].language) == (2, 64, "python")
    rules = [("a.log", ["*.log"], True), ("x/a.log", ["*.log"], True), ("a.log", ["*.log", "!a.log"], False), ("x/build/y", ["build/"], True), ("x/doc/y", ["/doc"], False), ("doc/y", ["/doc"], True)]
    for path, lines, out in rules:
        assert spark.range(1).select(ignored(F.lit(path), lines).alias("i")).first().i is out


def test_workspace(tmp_path):
    space = Workspace("w")
    space.add("/a/b"), space.add("/a/b"), space.add("/c", "named")
    space.save(tmp_path / "w.toml")
    back = Workspace.load(tmp_path / "w.toml")
    assert [r["name"] for r in back.repos] == ["b", "named"]
    assert back.find("named")["path"] == "/c" and back.remove("/c") and not back.remove("/zzz")


def test_watchable(spark):
    paths = {"a.rs": True, "src/x.tsx": True, "target/a.rs": False, "x/node_modules/b.js": False, ".git/a.py": False, "a.md": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_watchable(F.col("p")).alias("w")).collect()
    assert {r.p: r.w for r in rows} == paths


def test_refresh_equals_rebuild_and_stream(spark, tmp_path):
    root, store, events = tmp_path / "src", str(tmp_path / "store"), tmp_path / "events"
    write(root, a_dot_py="def f():\n    g()\n\ndef g():\n    pass\n", b_dot_py="import gone\n", c_dot_py="class C:\n    def m(self):\n        pass\n")
    assert refresh(spark, discover(spark, str(root)), store).first()[1:] == (3, 0, 0)
    first = GraphStore(spark, store).read()
    assert {r.kind for r in first.broken_refs.collect()} == {"DeadImport"}
    write(root, a_dot_py="def f():\n    h()\n\ndef h():\n    pass\n", d_dot_py="def d():\n    pass\n")
    (root / "b.py").unlink()
    events.mkdir()
    query = watch(spark, str(events), str(root), store, str(tmp_path / "state"), str(tmp_path / "log"))
    try:
        for i, (second, path) in enumerate((("00", "a.py"), ("00", "b.py"), ("00", "d.py"), ("30", "a.py"))):  # the last event only moves the watermark on
            line = {"ts": f"2024-01-01T00:00:{second}", "relative_path": path, "event": "modified"}
            (events / f"{i}.json").write_text(json.dumps(line))
            query.processAllAvailable()
        for _ in range(20):
            if GraphStore(spark, store).generation() > 1:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    now = GraphStore(spark, store).read()
    refresh(spark, discover(spark, str(root)), str(tmp_path / "fresh"))
    rebuilt = GraphStore(spark, str(tmp_path / "fresh")).read()
    assert names(now) == names(rebuilt) == {("Function", "f"), ("Function", "h"), ("Class", "C"), ("Function", "m"), ("Function", "d")}
    assert now.edges.count() == rebuilt.edges.count() == 2
    assert now.broken_refs.count() == 0
    assert now.nodes.select("id").distinct().count() == now.nodes.count()
    assert spark.read.json(str(tmp_path / "log")).first().event == "index_updated"


def same_rows(store, fresh):
    """All that the stored graph says, ids aside."""

    def said(g):
        place = {r.id: r.relative_path for r in g.files.collect()}
        node = {r.id: (place[r.file_id], r.kind, r.name, r.start_line, r.start_col, r.end_line, r.end_col) for r in g.nodes.collect()}
        edges = sorted((node[r.source_node_id], node[r.target_node_id], r.kind) for r in g.edges.collect())
        refs = sorted((node[r.source_node_id], r.ref_name, r.kind, r.line, r.target_name) for r in g.broken_refs.collect())
        return sorted(place.values()), sorted(node.values()), edges, refs

    return said(store.read()) == said(fresh.read())


def test_versions_touch_only_what_changed(spark, tmp_path):
    """Versions equal a rebuild in rows, search, importance and snapshot, and write only the groups of their files."""
    root, store = tmp_path / "src", GraphStore(spark, str(tmp_path / "store"))
    write(root, **{f"m{i}_dot_py": f"import lib{i}\nfrom x import helper{i % 3}\nclass C{i}:\n    def run_{i}(self):\n        go()\ndef go(): pass\n" for i in range(8)})
    changes = [{}, {"m1_dot_py": "def helper1():\n    pass\n"}, {"m2_dot_py": None, "n_dot_ts": "function helper2() { other(); }\nfunction other() {}\nclass Lib3 { get() { } }\n"}, {"m1_dot_py": "def another():\n    pass\n"}]
    for k, change in enumerate(changes):
        write(root, **{n: t for n, t in change.items() if t is not None})
        for name, text in change.items():
            if text is None:
                (root / name.replace("_dot_", ".")).unlink()
        before = store.manifest()
        row = refresh(spark, discover(spark, str(root)), store.folder, most_segments=3).first()
        after = store.manifest()
        assert row.version == after.version == k + 1 == store.generation()
        assert row.files_changed == (8 if not k else sum(t is not None for t in change.values())) and row.files_deleted == sum(t is None for t in change.values())
        written = {g for g, v in after.tables["nodes"].items() if v == k + 1} | (before.tables["nodes"].keys() - after.tables["nodes"].keys())
        assert k == 0 or 0 < len(written) <= len(change)
        assert len(after.segments) == (k + 1 if k < 3 else 1)
    fresh = GraphStore(spark, str(tmp_path / "fresh"))
    refresh(spark, discover(spark, str(root)), fresh.folder)
    assert same_rows(store, fresh)
    graph, imp = store.read(), {r.id: r.importance for r in store.importance().collect()}
    assert imp == {r.id: r.importance for r in metrics.importance(graph).collect()}
    one, whole = store.snapshot().first(), metrics.aggregate_metrics(graph).first()
    assert [one[c] for c in ("total_nodes", "total_edges", "total_files", "avg_complexity", "max_complexity")] == [whole[c] for c in ("total_nodes", "total_edges", "total_files", "avg_complexity", "max_complexity")]
    for version in (None, 3):  # before and after the segments were merged
        graph, manifest = store.read(version), store.manifest(version)
        for query in ("helper1", "import lib3", "go", "nothing", ""):
            assert {r.id for r in store.search(query, manifest).collect()} == {r.id for r in search.matching(graph.nodes, query).collect()}
    assert {r.ref_name for r in store.read(2).broken_refs.collect()} == {*(f"lib{i}" for i in range(8) if i != 1), "helper0", "helper2"}  # older versions stay
    assert {r.ref_name for r in store.read().broken_refs.collect()} == {*(f"lib{i}" for i in range(8) if i not in (1, 2)), "helper0", "helper1"}
    assert refresh(spark, discover(spark, str(root)), store.folder).first().version == 0 and store.generation() == 4
    some = spark.createDataFrame([("m5.py",), ("none.py",)], "relative_path string")
    (root / "m5.py").unlink()
    (root / "m6.py").unlink()
    assert refresh(spark, discover(spark, str(root), paths=["m5.py", "none.py"]), store.folder, examined=some).first()[1:3] == (0, 1)
    assert {"m6.py"} == {r.relative_path for r in store.read().files.collect()} & {"m5.py", "m6.py"}
    assert store.has_table("nodes") and not GraphStore(spark, str(tmp_path / "none")).has_table("nodes")


def test_a_refresh_writes_texts_and_store_rows_once(spark, tmp_path):
    """Beside the store no table holds its rows with their group, and one table the texts."""
    root, held = tmp_path / "src", pathlib.Path(traverse.checkpoint_dir(spark).removeprefix("file:"))
    write(root, a_dot_py="def f():\n    g()\n\ndef g():\n    pass\n", b_dot_py="class C:\n    def m(self):\n        pass\n")
    before = set(held.glob("table-*"))
    refresh(spark, discover(spark, str(root)), str(tmp_path / "store"))
    columns = [set(spark.read.parquet(str(t)).columns) for t in set(held.glob("table-*")) - before]
    assert sum("content" in c for c in columns) == 1
    assert not [c for c in columns if "grp" in c and c & {"indexed_at", "properties", "fan_in"}]
