"""Ignore files against git itself, files with unusual names, stems, plugins of packages."""

import subprocess
import sys

from graphloom.functions.stemming import stems
from graphloom.operators import plugins, search
from graphloom.schema import CodeGraph
from graphloom.sources.files import discover
from graphloom.sources.ignore import ignored_paths, rules_of
from pyspark.sql import functions as F

IGNORE = {
    ".gitignore": "# a comment\n*.log\n!keep.log\nbuild/\n/top.py\ndoc/**/draft.py\n**/deep/*.js\nexact/one.py\n\\#odd.py\n\\!bang.py\ntrail.py   \nq?.py\n[ab]x.py\n[!c]y.go\nout/**\na.b+(c).py\n\nnode*/\nabc/**/\n",
    "sub/.gitignore": "!*.log\n*.tmp.py\n/here.py\ninner/\n!build/\n",
    "sub/inner/.gitignore": "!z.py\n",
    "sub/more/.gitignore": "*.log\n!/b.log\nonly.py/\n",
    "build/.gitignore": "!*\n",
}
PATHS = [
    "a.log", "keep.log", "x/keep.log", "sub/a.log", "sub/more/a.log", "sub/more/b.log", "sub/more/c/b.log", "build/a.py", "x/build/b.py", "sub/build/c.py", "buildx/a.py", "top.py", "x/top.py",
    "doc/draft.py", "doc/a/draft.py", "doc/a/b/draft.py", "x/doc/draft.py", "deep/a.js", "x/deep/b.js", "x/deep/y/b.js", "exact/one.py", "x/exact/one.py", "#odd.py", "!bang.py", "trail.py", "q1.py", "q12.py", "q.py",
    "ax.py", "cx.py", "cy.go", "dy.go", "out/a.py", "out/b/c.py", "xout/a.py", "a.b+(c).py", "aXb+(c).py", "node_x/a.py", "nodes", "sub/here.py", "sub/x/here.py", "sub/x.tmp.py", "x.tmp.py", "sub/inner/z.py", "sub/x/inner/z.py", "sub/more/only.py", "sub/more/d/only.py", "abc/d/e.py", "abc/f.py",
]


def test_ignore_files_as_git_reads_them(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in IGNORE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for name in PATHS:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(PATHS), capture_output=True, text=True).stdout
    rules = rules_of(spark.createDataFrame(list(IGNORE.items()), "relative_path string, content string"))
    found = {r[0] for r in ignored_paths(spark.createDataFrame([(p,) for p in PATHS], "relative_path string"), rules).collect()}
    expected = {line.removeprefix('"').removesuffix('"') for line in said.splitlines()}
    assert found == expected and 20 < len(found) < len(PATHS) - 15


def test_discovery_with_ignore_files(spark, tmp_path):
    """Names that begin with an underscore are found, ignored paths are not; of both kinds of ignore file the later name decides."""
    texts = {"a.py": "x", "_b.py": "y", "p/__init__.py": "z", "p/q/_r.ts": "t", "p/q/s.js": "u", "p/.gitignore": "*.ts\n*.js\n", "p/.ignore": "!s.js\n", ".hidden.py": "h", "_c.txt": "-"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.relative_path: r.content for r in discover(spark, str(tmp_path)).collect()}
    assert found == {"a.py": "x", "_b.py": "y", "p/__init__.py": "z", "p/q/s.js": "u"}
    some = {r.relative_path for r in discover(spark, str(tmp_path), paths=["a.py", "p/__init__.py", "p/q/_r.ts", "gone.py"]).collect()}
    assert some == {"a.py", "p/__init__.py"}


# Words and stems of Porter's paper.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is by by x1s x1s straße straße yes ye youth youth generalizations gener oscillators oscil""".split()


def test_stems(spark):
    words, expected = STEMS[::2], STEMS[1::2]
    assert spark.range(1).select(stems(F.array(*map(F.lit, words)))).first()[0] == expected


def test_ranked_search_finds_other_forms(spark):
    nodes = spark.createDataFrame([(1, "connect_nodes"), (2, "connection"), (3, "connecting_things"), (4, "other")], "id long, name string")
    assert {r.id for r in search.search_ranked(nodes, "connected").collect()} == {1, 2, 3}


def test_plugins_of_packages(spark, tmp_path, monkeypatch):
    """A plugin that fails when it is loaded, in its plan or in its rows takes no other with it."""
    (tmp_path / "found_plugin.py").write_text(
        "from pyspark.sql import functions as F\n\n\ndef ok(graph):\n    return graph.nodes.select(F.lit('Info').alias('severity'), F.col('name').alias('message'), F.lit(None).cast('string').alias('file'), F.lit(1).alias('line'), F.col('name').alias('symbol'), F.lit('ok').alias('rule'))\n\n\n"
        "def bad_rows(graph):\n    return ok(graph).withColumn('line', F.raise_error(F.lit('row')).cast('int'))\n\n\ndef bad_plan(graph):\n    return graph.nodes.select('no_such_column')\n"
    )
    info = tmp_path / "found_plugin-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: found-plugin\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[graphloom.plugins]\na-rows = found_plugin:bad_rows\nb-plan = found_plugin:bad_plan\nc-none = found_plugin:missing\nd-ok = found_plugin:ok\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    nodes = spark.createDataFrame([(1, "Function", "f", 1, 1, 2, "{}")], "id long, kind string, name string, file_id long, start_line int, end_line int, properties string")
    registry = plugins.Registry({})
    assert registry.discover() == ["a-rows", "b-plan", "d-ok"] == registry.names()
    found = registry.run_all(CodeGraph(nodes, nodes, nodes)).collect()
    assert [(r.plugin, r.symbol) for r in found] == [("d-ok", "f")]
    sys.modules.pop("found_plugin", None)
