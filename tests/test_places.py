"""Spans that hold a place, and names in nested scopes, against plain loops."""

import random

from graphloom import queries
from graphloom.operators import places
from pyspark.sql import functions as F


def test_subtrees_make_up_the_lines(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)] + [(0, (1 << 30) - 1), (7, 7), ((1 << 29) - 1, (1 << 29) + 1)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", places.subtrees(F.col("a"), F.col("b")).alias("t")).collect()
    for r in rows:
        runs = sorted((t.tree << t.level, (t.tree + 1) << t.level) for t in r.t)
        assert runs[0][0] == r.a and runs[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(runs, runs[1:])) and len(runs) <= 62


def test_holding_against_all_pairs(spark):
    draw = random.Random(4)
    spans = [(draw.randrange(3), i, *draw.choice([(5, 3, 5, 3), (9, 1, 4, 1), (0, 0, 900, 9)] + [(a := draw.randrange(300), draw.randrange(9), a + draw.randrange(40), draw.randrange(9))] * 9)) for i in range(300)]
    points = [(draw.randrange(4), draw.randrange(340), draw.randrange(10)) for _ in range(200)] + [(None, 3, 3), (1, None, 1)]
    s = spark.createDataFrame(spans, "file_id long, id long, start_line int, start_col int, end_line int, end_col int")
    p = spark.createDataFrame(points, "file_id long, line int, col int").distinct()
    found = {(r.file_id, r.line, r.col, r.id) for r in places.holding(p, s).collect()}
    expected = {(f, l, c, i) for f, l, c in set(points) if l is not None for g, i, a, b, x, y in spans if f == g and (a, b) != (x, y) and a <= x and (l, c) >= (a, b) and (l, c) <= (x, y)}
    assert found == expected and len(found) > 500
    lines = {(r.file_id, r.line, r.id) for r in places.holding(p.select("file_id", "line").distinct(), s).collect()}
    assert lines == {(f, l, i) for f, l, _ in set(points) if l is not None for g, i, a, b, x, y in spans if f == g and a <= l <= x}


class Chain:
    """Scopes as a stack: names of the innermost first."""

    def __init__(self):
        self.scopes = [{}]

    def resolve(self, name):
        return next((s[name] for s in reversed(self.scopes) if name in s), None)


def nested(draw, depth, nodes, uses, chain, line, file_id):
    """A block of definitions, inner scopes and uses of all names at its end, when everything is defined; returns the next line."""
    for _ in range(draw.randrange(1, 4)):
        node, first = [len(nodes), draw.choice(["Function", "Class", "Variable"]), draw.choice("abcd"), file_id, line, 1, line, 9], line
        nodes.append(node)
        chain.scopes[-1][node[2]] = node[0]
        line += 1
        if node[1] != "Variable" and depth:
            chain.scopes.append({})
            line = nested(draw, depth - 1, nodes, uses, chain, line, file_id)
            chain.scopes.pop()
            node[6] = line
            line += 1
        assert first <= node[6]
    uses.extend((file_id, name, line, 5, dict(enumerate(map(dict, chain.scopes)))) for name in "abcde")
    return line + 1


def test_names_in_nested_scopes(spark):
    """Shadowing, names of outer scopes, names bound twice and names of nothing; a use sees all its scopes bind, before it or after."""
    draw, nodes, uses = random.Random(11), [], []
    for file_id in range(3):
        nested(draw, 4, nodes, uses, Chain(), 1, file_id)
    # What a scope binds in the end, as later definitions of it count too.
    spans = {n[0]: n for n in nodes}

    def scope_of(file_id, line, skip=None):
        inside = [n for n in nodes if n[3] == file_id and n[1] != "Variable" and n[0] != skip and n[4] <= line <= n[6] and (n[4], 1) != (n[6], 9) and not (n[6] == line and n[4] == line and skip is None)]
        return sorted(inside, key=lambda n: (n[4], -n[6]))

    bound = {}
    for n in nodes:
        inside = [s for s in scope_of(n[3], n[4], n[0]) if (s[4], s[5]) <= (n[4], n[5]) <= (s[6], s[7])]
        bound[(n[3], inside[-1][0] if inside else None, n[2])] = n[0]
    asked, expected = [], {}
    for k, (file_id, name, line, col, _) in enumerate(uses):
        asked.append((k, file_id, name, line, col))
        inside = [s[0] for s in scope_of(file_id, line) if (s[4], s[5]) <= (line, col) <= (s[6], s[7])]
        expected[k] = next((bound[(file_id, s, name)] for s in [*reversed(inside), None] if (file_id, s, name) in bound), None)
    df = spark.createDataFrame([tuple(n) for n in nodes], "id long, kind string, name string, file_id long, start_line int, start_col int, end_line int, end_col int")
    found = places.resolve_names(spark.createDataFrame(asked, "use_id long, file_id long, name string, line int, col int"), df)
    assert {r.use_id: r.node_id for r in found.collect()} == expected
    assert len({v for v in expected.values()}) > 10 and None in expected.values() and len(spans) > 20


def test_shadowing(spark):
    nodes = [(1, "Variable", "x", 1, 1, 1, 1, 9), (2, "Function", "f", 1, 2, 1, 6, 2), (3, "Variable", "x", 1, 3, 5, 3, 9), (4, "Function", "g", 1, 7, 1, 9, 2)]
    uses = [(0, 1, "x", 4, 5), (1, 1, "x", 8, 5), (2, 1, "f", 8, 5), (3, 1, "g", 4, 5), (4, 1, "z", 4, 5), (5, 1, "", 4, 5), (6, 2, "x", 1, 1)]
    found = places.resolve_names(spark.createDataFrame(uses, "use_id long, file_id long, name string, line int, col int"), spark.createDataFrame(nodes, "id long, kind string, name string, file_id long, start_line int, start_col int, end_line int, end_col int"))
    assert {r.use_id: r.node_id for r in found.collect()} == {0: 3, 1: 1, 2: 2, 3: 4, 4: None, 5: None, 6: None}


def test_a_place_is_dealt_only_to_levels_that_spans_have(spark):
    """One row a place for its block, where no span holds a whole block; pieces of a span make up its lines."""
    line = spark.createDataFrame([(37,)], "line int")
    assert [tuple(x) for x in line.select(places.around(F.col("line"), F.array(F.lit(-1), F.lit(1))).alias("t")).first().t] == [(-1, 2), (1, 1)]
    for a, b in ((0, 15), (3, 7), (5, 100), (16, 47), (0, places.LAST_LINE)):
        found = spark.range(1).select(places.pieces(F.lit(a), F.lit(b)).alias("t")).first().t
        lines = [(t.tree * 16, t.tree * 16 + 15) if t.level < 0 else ((t.tree << t.level) * 16, ((t.tree + 1) << t.level) * 16 - 1) for t in found]
        assert len(lines) == len(set(lines)) and min(x for x, _ in lines) == a // 16 * 16 and max(y for _, y in lines) == b // 16 * 16 + 15
        assert all(a <= x and y <= b for (x, y), t in zip(lines, found) if t.level >= 0)
    assert found == [(26, 0)]


def shuffles(df):
    """What the plan shuffles beside the rows dealt by files."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_what_is_extracted_is_shuffled_once_by_files(spark):
    """Joins and groups within files leave the rows where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("span_covering_place", "scope_resolution", "extracted_edges"):
            found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert not shuffles(found) and all("/table-" in f for f in found.inputFiles()), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_and_spans_meet_by_more_than_the_file(spark):
    spans = spark.createDataFrame([(1, "a", 1, 1, 9), (1, "b", 2, 1, 40), (2, "a", 3, 1, 9)], "file_id long, name string, id long, start_line int, end_line int")
    points = spark.createDataFrame([(1, "a", 5), (1, "b", 20), (1, "b", 41), (2, "b", 5)], "file_id long, name string, line int")
    for like in (None, spans.unionByName(spans.withColumn("end_line", F.lit(900)))):
        found = places.holding(points, spans, ("file_id", "name"), like)
        assert sorted((r.file_id, r.name, r.line, r.id) for r in found.collect()) == [(1, "a", 5, 1), (1, "b", 20, 2)]


def test_scopes_are_the_same_with_places_in_the_file(spark):
    rows = [(1, 1, "Variable", 0), (2, 1, "Function", 1), (3, 2, "Class", 0)]
    nodes = spark.createDataFrame([(i, f, k, n, 1, 1, 9, 9) for i, f, k, n in rows], "id long, file_id long, kind string, local_idx int, start_line int, start_col int, end_line int, end_col int")
    key = lambda r: str(tuple(r))
    assert sorted(places.scopes_of(nodes).collect(), key=key) == sorted(places.scopes_of(nodes.drop("local_idx")).collect(), key=key)
