"""Work on one large group is dealt over ranges, with the results of the plain definition."""

import pytest

from graphloom.operators import cycles, incremental, regress


@pytest.fixture
def tasks(spark, monkeypatch):
    """The numbers of ranges that were used."""
    seen = []
    for module in (cycles, incremental, regress):
        def ranged(df, *by, f=module.in_ranges):
            out = f(df.repartitionByRange(3, *by), *by)
            seen.append(out.select("part").distinct().count())
            return out

        monkeypatch.setattr(module, "in_ranges", ranged)
    monkeypatch.setattr("graphloom.operators.traverse.checkpoint", lambda df: df.localCheckpoint())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield seen
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_group_report(spark, tasks):
    rows = [(f"g{i % 2}/{i}", float(i * 37 % 50)) for i in range(301)]
    found = {r.group_name: tuple(r)[1:] for r in regress.group_report(spark.createDataFrame(rows, "name string, mean_ns double")).collect()}
    of = {g: sorted(m for n, m in rows if n.startswith(g)) for g in ("g0", "g1")}
    assert found == {g: (len(m), m[0], m[-1], m[len(m) // 2]) for g, m in of.items()}
    assert min(tasks) > 1


def test_circular_dependencies(spark, tasks):
    rows = [(i, 0) for i in range(200)] + [(i, 300) for i in range(300, 303)]
    pairs = cycles.circular_dependencies(spark.createDataFrame(rows, "node_id long, component long")).collect()
    assert sorted(map(tuple, pairs)) == [(i, i + 1) for i in range(199)] + [(300, 301), (301, 302)]
    assert min(tasks) > 1


def test_numbered(spark, tasks):
    rows = [(f"f{i:03d}", k) for i in range(100) for k in range(i % 4)]
    found = incremental.numbered(spark.createDataFrame(rows, "path string, k int"), 7, ["path", "k"]).collect()
    assert sorted((r.path, r.k, r.id) for r in found) == [(p, k, n) for n, (p, k) in enumerate(sorted(rows), 8)]
    assert min(tasks) > 1
