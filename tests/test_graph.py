import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import findings, graph, guidance, membrane, scope, topology


def graphs(seed, groups=4, n=14, m=20):
    rng = random.Random(seed)
    nodes = [(f"g{g}", f"n{i:02d}") for g in range(groups) for i in range(n)]
    edges = [(f"g{g}", f"n{rng.randrange(n + 1):02d}", f"n{rng.randrange(n + 1):02d}", "calls") for g in range(groups) for _ in range(m)]
    return nodes, edges


@pytest.fixture(params=[1, 2])
def world(request, spark):
    nodes, edges = graphs(request.param)
    return nodes, edges, spark.createDataFrame(nodes, "k string, node_id string"), spark.createDataFrame(edges, "k string, from_node string, to_node string, type string")


def test_components_and_reach(world):
    nodes, edges, n, e = world
    known = {*nodes}
    near = {x: set() for x in nodes}
    for k, a, b, _ in edges:
        if a != b and (k, a) in known and (k, b) in known:
            near[k, a].add((k, b))
            near[k, b].add((k, a))
    want = {}
    for x in nodes:
        seen, stack = {x}, [x]
        while stack:
            for y in near[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        want[x] = min(seen)[1]
    assert {(r.k, r.node_id): r.component for r in graph.components(n, e, ["k"]).collect()} == want
    out = {}
    for k, a, b, _ in edges:
        out.setdefault((k, a), set()).add(b)
    for most in (2, None):
        got = {(r.k, r.source, r.node_id): r.hops for r in graph.reach(n.select("k", F.col("node_id").alias("source"), "node_id"), e, ["k"], most).collect()}
        for k, s in nodes:
            hops, front, d = {s: 0}, {s}, 0
            while front and (most is None or d < most):
                d += 1
                front = {t for x in front for t in out.get((k, x), ())} - {*hops}
                hops |= dict.fromkeys(front, d)
            assert {t: h for (kk, ss, t), h in got.items() if (kk, ss) == (k, s)} == hops


def test_pruned_is_the_least_fixpoint(world):
    nodes, edges, n, e = world
    up = {}
    for k, a, b, _ in edges:
        up.setdefault((k, b), set()).add((k, a))
    done = {x for x in nodes if x[1] in ("n00", "n01", "n02", "n03", "n04", "n05", "n06")}
    seeds = {*done}
    while True:
        new = {x for x, above in up.items() if x not in done and above <= done}
        if not new:
            break
        done |= new
    got = graph.pruned(n.where("node_id < 'n07'"), e, ["k"]).collect()
    assert {(r.k, r.node_id) for r in got} == done and {(r.k, r.node_id) for r in got if r.round == 0} == seeds


def test_merged_chunks(spark):
    rows = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", None), ("c3", ""), ("c3", "d")], "chunk_id string, feature_id string")
    union, errors = graph.merged_chunks(rows)
    assert sorted(r.feature_id for r in union.collect()) == ["a", "a", "b", "d"]
    assert {(r.error, r.feature_id, r.first_chunk, r.last_chunk, r.n) for r in errors.collect()} == {("duplicate_id", "a", "c1", "c2", 2), ("missing_id", None, "c2", None, 1), ("missing_id", None, "c3", None, 1)}
    assert graph.merged_chunks(rows.where("chunk_id = 'c1'"))[1].count() == 0


def test_columns(spark):
    e = spark.createDataFrame([("p", "A", "B"), ("p", "B", "C"), ("p", "D", "C"), ("p", "B", "B"), ("q", "a", "b"), ("q", "b", "c"), ("q", "c", "a"), ("q", "c", "d")], "k string, from_node string, to_node string")
    got = {(r.k, r.node_id): (r.depth, r.column) for r in graph.columns(e, ["k"]).collect()}
    assert got == {
        ("p", "A"): (2, 0), ("p", "B"): (1, 1), ("p", "C"): (0, 2), ("p", "D"): (1, 1),
        ("q", "a"): (3, 0), ("q", "b"): (2, 1), ("q", "c"): (1, 2), ("q", "d"): (0, 3),
    }
    assert [tuple(r) for r in graph.back_edges(e, ["k"]).collect()] == [("q", "c", "a")]
    assert graph.columns(e.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        graph.columns(e, ["k"], most=2)


@pytest.mark.parametrize("seed", range(8))
def test_walk_down_leaves_no_cycle(seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)]
    found = graph.walk_down(edges)
    back = {(a, b) for a, b, d in found if d is None}
    rest = {(a, b) for a, b in edges if a != b} - back
    depth = {a: d for a, _, d in found if d is not None}
    assert all(depth[a] > depth[b] for a, b in rest)
    assert all(d == 0 or any(depth[b] == d - 1 for a, b in rest if a == n) for n, d in depth.items())


@pytest.mark.parametrize("seed", range(10))
def test_chunk_plan(seed):
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.randrange(1, 12)) for i in range(30)]
    near = {n: set() for n, _ in nodes}
    for _ in range(rng.choice([5, 25, 60])):
        a, b = rng.sample([*near], 2)
        near[a].add(b)
        near[b].add(a)
    plan = graph.chunk_plan(nodes, near, {n: len(x) for n, x in near.items()}, 10)
    assert sorted(n for n, _, _ in plan) == sorted(n for n, _ in nodes)
    size = dict(nodes)
    for chunk in {c for _, c, _ in plan}:
        held = [(n, t) for n, c, t in plan if c == chunk]
        assert len({t for _, t in held}) == 1
        assert sum(size[n] for n, _ in held) <= 10 or (len(held) == 1 and held[0][1] == "oversized")
    assert plan == graph.chunk_plan(nodes[::-1], near, {n: len(x) for n, x in near.items()}, 10)


def test_topology_of_empty_and_loops(spark):
    nodes = spark.createDataFrame([("a.py::main", "main", "cli/a.py", None, 1), ("a.py::f", "f", "a.py", ["@app.route('/')"], 2), ("b.py::g", "g", "b.py", [], 3)], "node_id string, name string, file string, decorators array<string>, node_ord int")
    edges = spark.createDataFrame([("a.py::main", "b.py::g"), ("a.py::main", "b.py::g"), ("b.py::g", "gone")], "from_node string, to_node string")
    got = {r.name: (r.in_degree, r.out_degree, r.is_entry_point, r.batch, r.topology_rank) for r in topology.topology(nodes, edges).collect()}
    assert got == {"main": (0, 2, True, 1, 1), "f": (0, 0, True, 1, 2), "g": (2, 0, False, 2, 3)}
    assert topology.topology(nodes.limit(0), edges.limit(0)).count() == 0


def test_findings_from_documents(spark):
    from graphloom.operators.findings import SCAN_SCHEMA

    v = [("GHSA-1", ["X", "CVE-2", "CVE-3"], [("CVSS_V3", "bad"), ("CVSS_V3", "7.5"), ("CVSS_V2", "1.0"), ("CVSS_V3", "")], ("HIGH",)), ("GHSA-2", None, None, None)]
    df = spark.createDataFrame([([(("p", "t"), [(("lib", "1.0", "PyPI"), v)])],), (None,)], SCAN_SCHEMA)
    got = {tuple(r) for r in findings.flattened(df).collect()}
    assert got == {("CVE-2", "lib", "1.0", "high", 7.5, "7.5"), ("GHSA-2", "lib", "1.0", None, None, "")}


def test_doubt_moves(spark):
    doubts = spark.createDataFrame([("d", "discovered", [], None)], "doubt_id string, current_state string, state_history array<struct<from_state string, to_state string, ts string, actor string, reason string>>, assigned_to string")
    move = spark.createDataFrame([("d", "investigating", "t", "me", None, "you", None)], "doubt_id string, to_state string, ts string, actor string, reason string, assignee string, description string")
    row = scope.moved(doubts, move).first()
    assert row.current_state == "investigating" and row.assigned_to == "you" and len(row.state_history) == 1 and row.resolution is None
    assert scope.argument_errors(move.withColumn("assignee", F.lit(None).cast("string"))).count() == 1


def test_elements(spark):
    df = spark.createDataFrame([("high", ["a"], "e", 5.0), (None, ["vulnerability"], "", 11.0), ("odd", [], "e", 11.0)], "v string, f array<string>, e string, s double")
    rows = df.select(membrane.signal(F.col("v"), "confidence").alias("a"), membrane.flags(F.col("f"), "risk_flag").alias("b"), membrane.relayed(F.col("v"), F.col("e"), F.col("s")).alias("c")).collect()
    assert [(r.a.kind, r.b.kind, r.c.kind) for r in rows] == [("signal", "noise", "relayed"), ("noise", "flags", "noise"), ("noise", "flags", "noise")]


def test_guidance(spark):
    states = spark.createDataFrame([("p", False, False, False, 0, 0, 0), ("q", True, True, True, 0, 0, 0)], "project_id string, initialised boolean, has_structure boolean, residue_done boolean, n_snapshots int, n_with_structure int, n_drifts int")
    got = {(r.project_id, r.action): r.priority for r in guidance.next_actions(states, "after_error", "no_snapshot_for_baseline").collect()}
    assert got["q", "snapshot.write_first"] == 1 and ("p", "snapshot.write_first") not in got and got["p", "onboarding.read_claude_md"] == 99
    assert guidance.decision(["Keep", "Drop"], " keep ") == "Keep"
    for options, answer in (([], "x"), (["a", "A"], "a"), (["a"], "b")):
        with pytest.raises(ValueError):
            guidance.decision(options, answer)
