import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as h

DDL = "version_id string, block_id string, parent_block_id string, loaded_at timestamp_ntz, root string, depth int"
MORE = ("path", "children", "interval", "back")


def forest(seed, groups=6, n=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(n):
            parent = rng.choice([None, "", " ", "missing", *(f"b{rng.randrange(n)}" for _ in range(30))]) if rng.random() < 0.5 else f"b{max(0, i - 1)}" if i else None
            rows.append((f"v{g}", f"b{i}", parent))
    return rows


def brute(rows):
    parent = {(g, n): p for g, n, p in rows}
    parent = {(g, n): p if p is not None and (g, p) in parent else None for (g, n), p in parent.items()}
    out = {}
    for g, n in parent:
        line = [n]
        while parent[g, line[-1]] is not None and parent[g, line[-1]] not in line:
            line.append(parent[g, line[-1]])
        out[g, n] = (line[-1], len(line) - 1) if parent[g, line[-1]] is None else ("", -1)
    return out, parent


@pytest.mark.parametrize(("seed", "bound"), [(1, 10**6), (2, 10**6), (3, 3), (4, 20), (5, 0)])
def test_brute_force(spark, seed, bound):
    rows = forest(seed)
    want, parent = brute(rows)
    links = h.links(spark.createDataFrame([(*r, None, "x", 1) for r in rows], DDL), "version_id", "block_id", "parent_block_id", "loaded_at")
    got = {(r.grp, r.node): r for r in h.hierarchies(links, MORE, bound).collect()}
    assert {k: (r.root, r.depth) for k, r in got.items()} == want
    backs = {}
    for (g, n), r in got.items():
        if r.depth >= 0:
            assert len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == n and not r.back_edge and r.top == r.root
            assert all(parent[g, b] == a for a, b in zip(r.path, r.path[1:]))
            assert r.n_descendants == sum(1 for (g2, m), x in got.items() if g2 == g and x.depth > r.depth and n in x.path)
        else:
            assert r.n_descendants is None and r.path[-1] == n and r.path[0] == r.top
            if r.back_edge:
                backs.setdefault((g, n), r)
    comps = {}
    for (g, n), r in got.items():
        comps.setdefault((g, r.top), []).append(r)
    for members in comps.values():
        line = sorted(members, key=lambda r: r.path)
        assert [r.first for r in line] == [*range(len(line))]
        for r in line:
            assert r.last == r.first + sum(1 for x in members if r.node in x.path) - 1
    cycles = set()
    for (g, n), (_, d) in want.items():
        if d < 0:
            seen, m = [], n
            while m not in seen:
                seen.append(m)
                m = parent[g, m]
            cycles.add((g, min(seen[seen.index(m):])))
    assert {*backs} == cycles
    pairs = h.descendants(links, bound)
    assert pairs.count() == sum(d for _, d in want.values() if d > 0)
    assert pairs.agg(F.sum("distance")).first()[0] == sum(d * (d + 1) // 2 for _, d in want.values() if d > 0)


def test_deep_chain(spark):
    rows = [("v", f"b{i}", f"b{i - 1}" if i else None) for i in range(3000)]
    links = spark.createDataFrame(rows, "grp string, node string, parent string")
    for bound in (10**6, 100):
        assert h.hierarchies(links, (), bound).agg(F.max("depth")).first()[0] == 2999


def test_chain_as_deep_as_the_bound(spark):
    """Ranges of a chain of 100,000 fit a task easily; its paths would be five thousand million names."""
    n = 100_000
    links = spark.range(n).select(F.lit("v").alias("grp"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    got = h.hierarchies(links, ("interval", "children")).agg(F.max("depth"), F.sum("n_descendants"), F.min("last"), F.count("*")).first()
    assert tuple(got) == (n - 1, n * (n - 1) // 2, n - 1, n)


def test_wide_paths_leave_in_small_batches(spark, monkeypatch):
    rows = [("v", f"b{i}", f"b{i - 1}" if i else None) for i in range(900)]
    got = h.hierarchies(spark.createDataFrame(rows, "grp string, node string, parent string"), ("path",))
    assert got.agg(F.sum(F.size("path"))).first()[0] == 900 * 901 // 2


def test_star_of_hot_parents(spark):
    links = spark.range(4_000).select(F.lit("v").alias("grp"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, F.lit("0")).alias("parent"))
    ends = h.jumped(links, hot_rows=100)
    assert ends.where("done and far = '0'").count() == 4_000 and ends.agg(F.sum("depth")).first()[0] == 3_999
    tour = {r.node: (r.first, r.last) for r in h.toured(links, hot_rows=100).collect()}
    assert tour["0"] == (0, 3_999) and {a for a, _ in tour.values()} == {*range(4_000)} and all(a == b for k, (a, b) in tour.items() if k != "0")


def test_defined_cases(spark):
    t = lambda x: __import__("datetime").datetime(2025, 1, x)
    rows = [("v", "a", "b", t(1)), ("v", "a", None, t(2)), ("v", "b", "a", None), ("v", "s", "s", t(1)), ("v", None, "a", t(1)), (None, "z", "a", t(1)), ("w", "b", "a", t(1)), ("v", "b", "a", None)]
    got = {tuple(r) for r in h.block_roots(spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)).collect()}
    assert got == {("v", "a", "a", 0), ("v", "b", "a", 1), ("v", "s", "", -1), ("w", "b", "b", 0)}
    assert h.block_roots(spark.createDataFrame([], DDL)).count() == 0
