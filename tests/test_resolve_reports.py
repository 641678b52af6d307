import pytest
from pyspark.sql import functions as F

from graphloom.operators import diff, projection, reports, resolve, views

DEFS = "node_id string, name string, file string, package string, node_ord int, type string"


def definitions(spark):
    return spark.createDataFrame(
        [
            ("a.py::A", "A", "a.py", "", 0, "class"), ("a.py::A.run", "run", "a.py", "", 1, "method"), ("b/b.py::B", "B", "b/b.py", "b", 2, "class"), ("b/b.py::B.run", "run", "b/b.py", "b", 3, "method"),
            ("b/c.py::help", "help", "b/c.py", "b", 4, "function"), ("c/d.py::many", "many", "c/d.py", "c", 5, "function"), ("c/e.py::many", "many", "c/e.py", "c", 6, "function"), ("c/f.py::many", "many", "c/f.py", "c", 7, "function"), ("c/g.py::many", "many", "c/g.py", "c", 8, "function"),
        ],
        DEFS,
    )


def test_cascade(spark):
    calls = spark.createDataFrame([("x", "run", "a.py", ""), ("x", "help", "b/b.py", "b"), ("x", "many", "z.py", "z"), ("x", "help", "z.py", "z"), ("x", "alias", "z.py", "z"), ("x", "nothing", "z.py", "z"), (None, "help", None, None)], "caller string, name string, file string, package string")
    aliases = spark.createDataFrame([("z.py", "help", "many")], "file string, alias string, original string")
    def edges(**more):
        found = {}
        for r in resolve.expanded(resolve.resolve(calls, definitions(spark), aliases, **more), definitions(spark)).collect():
            found.setdefault((r.name, r.file), set()).add((r.target, r.resolution))
        return found

    many = {f"c/{x}.py::many" for x in "defg"}
    runs = {"a.py::A.run", "b/b.py::B.run"}
    assert edges() == {
        ("run", "a.py"): {("a.py::A.run", "scope_rule")}, ("help", "b/b.py"): {("b/c.py::help", "name_match")}, ("many", "z.py"): {(x, "name_match_ambiguous") for x in many},
        ("help", "z.py"): {("c/d.py::many", "import_alias")}, ("help", None): {("b/c.py::help", "name_match")},
    }
    assert edges(strategy=F.lit("package"))["help", "b/b.py"] == {("b/c.py::help", "scope_rule")}
    assert edges(strategy=F.lit("global"))["run", "a.py"] == {(x, "name_match") for x in runs}
    alone = edges(strategy=F.lit(None).cast("string"), dynamic=F.lit(True))
    assert alone["help", "z.py"] == {("b/c.py::help", "name_match")} and alone["run", "a.py"] == {(x, "name_match") for x in runs}
    dynamic = edges(dynamic=F.col("file") == "a.py")
    assert dynamic["run", "a.py"] == {(x, "skipped_dynamic") for x in runs} and dynamic["many", "z.py"] == {(x, "name_match_ambiguous") for x in many}
    renamed = spark.createDataFrame([("z.py", "alias", "many")], "file string, alias string, original string")
    assert [r.target for r in resolve.resolve(calls, definitions(spark), renamed).where("name = 'alias'").collect()] == ["c/d.py::many"]


@pytest.mark.parametrize(("n", "how"), [(1, "name_match"), (2, "name_match"), (3, "name_match"), (4, "name_match_ambiguous")])
def test_every_candidate_is_an_edge(spark, n, how):
    defs = spark.createDataFrame([(f"f{i}.py::go", "go", f"f{i}.py", "", i, "function") for i in range(n)], DEFS)
    calls = spark.createDataFrame([("m.py::main", "go", "m.py", "")], "caller string, name string, file string, package string")
    found = resolve.call_edges(resolve.expanded(resolve.resolve(calls, defs), defs)).collect()
    assert {(r.to_node, r.resolution) for r in found} == {(f"f{i}.py::go", how) for i in range(n)}


def test_pairs_are_counted_without_being_moved(spark):
    defs = spark.createDataFrame([(f"n{i}", "go", f"f{i}.py", "", i, "function") for i in (0, 1, 1, 2, 3)] + [("n1", "also", "f1.py", "", 4, "function"), ("n0", "n0", "f0.py", "", 5, "function")], DEFS)
    rows = [("n2", "go", "m.py", ""), ("n2", "go", "m.py", ""), ("n2", "go", "o.py", ""), ("n2", "also", "m.py", ""), ("n0", "n0", "f0.py", ""), ("n2", "mine", "m.py", ""), ("n2", None, "m.py", "")]
    calls = spark.createDataFrame(rows, "caller string, name string, file string, package string")
    aliases = spark.createDataFrame([("m.py", "mine", "also")], "file string, alias string, original string")
    found = resolve.resolve(calls, defs, aliases, distinct=True)
    twice = resolve.resolve(calls.distinct(), defs, aliases)
    assert sorted(found.collect()) == sorted(twice.collect()) and found.count() == 5
    pairs = resolve.expanded(twice, defs)
    keys = ["caller", "name", "resolution"]
    counts = resolve.counted(found, defs, keys)
    assert sorted(counts.collect()) == sorted(pairs.groupBy(*keys, "target").count().collect())
    edges = resolve.edge_counts(found, defs, aliases)
    by = ["from_node", "to_node", "type", "resolution"]
    assert sorted(edges.collect()) == sorted(resolve.call_edges(pairs).groupBy(*by).count().collect())
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(caller" not in plan and "target" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_nodes_of_several_names_move_no_pairs_of_others(spark):
    n = 150
    nodes = [(f"n{i}", "go", f"f{i}.py", "", i, "function") for i in range(n)]
    more = [("n0", "also", "f0.py", "", n, "function"), ("n1", "also", "f1.py", "", n + 1, "function"), ("n1", "also", "f1.py", "", n + 2, "function"), (None, "go", "f.py", "", n + 3, "function"), ("n3", None, "f3.py", "", n + 4, "function")]
    defs = spark.createDataFrame(nodes + more, DEFS)
    rows = [(f"n{i}", "go", f"{x}.py", "") for i in range(n) for x in "xy"] + [(f"n{i}", "also", "x.py", "") for i in range(0, n, 3)] + [("n7", "mine", "m.py", ""), ("n7", "go", "f2.py", ""), ("n7", "go", "m.py", ""), (None, "go", "x.py", "")]
    calls = spark.createDataFrame(rows, "caller string, name string, file string, package string")
    by = ["from_node", "to_node", "type", "resolution"]
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    for named in (defs, defs.where("name = 'go'")):
        for aliases in ([("m.py", "mine", "go")], [("m.py", "go", "go")]):
            aliases = spark.createDataFrame(aliases, "file string, alias string, original string")
            found = resolve.resolve(calls, named, aliases, strategy=F.expr("if(caller = 'n9', null, 'file')"))
            expected = resolve.call_edges(resolve.expanded(found, named)).groupBy(*by).count().collect()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            before = moved()
            edges = resolve.edge_counts(found, named, aliases).collect()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            assert sorted(edges) == sorted(expected) and len(edges) > n * (n - 2)
            assert moved() - before < n * n / 2


def test_receivers_and_bases(spark):
    rows = [("self", "a.py::A.f", "A"), ("A", "a.py::f", None), ("X", "a.py::f", None), ("odd", "a.py::f", None), (None, "a.py::f", None)]
    calls = spark.createDataFrame([(c, r, "run", "a.py", "", k) for r, c, k in rows] + [("b/c.py::g", "self", "run", "b/c.py", "b", "G"), ("b/c.py::g", "B", "gone", "b/c.py", "b", None)], "caller string, receiver string, method string, file string, package string, caller_class string")
    aliases = spark.createDataFrame([("a.py", "X", "B")], "file string, alias string, original string")
    found = resolve.expanded(resolve.resolve_receivers(calls, definitions(spark), aliases), definitions(spark), "method").collect()
    got = {}
    for r in found:
        got.setdefault((r.receiver, r.file), set()).add((r.target, r.resolution))
    local = {("a.py::A.run", "scope_rule")}
    assert got == {
        ("self", "a.py"): local, ("A", "a.py"): local, ("X", "a.py"): {("b/b.py::B.run", "import_alias")}, ("odd", "a.py"): local, (None, "a.py"): local,
        ("self", "b/c.py"): {("a.py::A.run", "name_match"), ("b/b.py::B.run", "name_match")},
    }
    skipped = resolve.resolve_receivers(calls, definitions(spark), aliases, dynamic=F.lit(True))
    assert {(r.resolution, r.target, r.n_candidates) for r in skipped.collect()} == {("skipped_dynamic", None, 2)}
    classes = spark.createDataFrame([("a.py::A", "a.py", "", ["pkg.B", "Unknown", "A"])], "node_id string, file string, package string, bases array<string>")
    assert [(r.from_node, r.to_node, r.type) for r in resolve.extends_edges(classes, definitions(spark)).collect()] == [("a.py::A", "b/b.py::B", "extends")]


def test_projection_keeps_every_edge(spark):
    rows = [("a", f"x.m{i % 3}", r) for i, r in enumerate(["scope_rule", "skipped_dynamic", "skipped_dynamic", "name_match_ambiguous", "skipped_dynamic"])] + [("b", "y", "name_match")]
    edges = spark.createDataFrame(rows, "from_node string, to_node string, resolution string")
    got = {(r.from_node, r.method): (r.n, r.cardinality, r.n_all) for r in projection.residue(edges, "indeterminate").collect()}
    assert got == {("a", "m1"): (2, 3, 6), ("a", "m2"): (1, 3, 6)}
    row = projection.residue_counters(edges).first()
    assert (row.n_edges, row.n_kept, row.indeterminate_callers, row.ambiguous_callers) == (6, 2, 1, 1)
    assert projection.residue(edges.limit(0), "ambiguous").count() == 0


def test_risk_filter(spark):
    cards = spark.createDataFrame([("a", 1, "high"), ("b", 0, "low"), ("c", None, None), ("d", 0, "medium")], "feature_id string, anomaly_count int, confidence string")
    assert [r.feature_id for r in cards.where(views.risk_filter()).collect()] == ["a", "b"]


def test_diff_of_a_version_with_itself_and_backwards(spark):
    f = spark.createDataFrame([("1", "a", "l", None), ("1", "b", "l", "d"), ("2", "a", "l", ""), ("2", "c", None, None), ("1", None, "x", "y")], "version_id string, feature_id string, label string, description string")
    pairs = lambda a, b: spark.createDataFrame([(a, b)], "version_id string, previous_id string")
    state = lambda a, b: {r.feature_id: r.diff_state for r in diff.node_diff(f, pairs(a, b)).collect()}
    assert state("2", "1") == {"a": "attribute_changed", "b": "removed", "c": "added", None: "removed"}
    assert state("1", "2") == {"a": "attribute_changed", "b": "added", "c": "removed", None: "added"}
    assert {*state("1", "1").values()} == {"unchanged"}


def test_notes_and_texts(spark):
    ddl = "author string, text string, mode string, feature_id string, layer string, baseline string, current string, project_id string"
    notes = spark.createDataFrame([("me", "hi", "feature", "f", None, None, None, None), ("", "hi", "feature", "f", None, None, None, None), ("m" * 41, "hi", "feature", "f", None, None, None, None), ("me", "x" * 2001, "layer", "f", "l", None, None, None), ("me", "hi", "odd", None, None, None, None, None), ("me", "hi", "layer", "f", None, None, None, None)], ddl)
    assert [r[0] for r in notes.select(reports.note_error()).collect()] == [None, "author_required", "author_too_long", "text_too_long", "unknown_mode", "layer_required"]
    assert reports.notes_of(notes, "feature", feature_id="f").count() == 3 and reports.notes_of(notes, "layer", feature_id="f", layer="l").count() == 1
    log = spark.createDataFrame([("t", "batch", 1, "ok", None, None, None, None, None), ("t", "structural_change", None, None, None, None, ["a"], [], None), ("t", None, None, None, None, None, None, None, None)], "timestamp string, record_type string, batch int, llm_judgment string, feature_id string, new_summary string, added_nodes array<string>, removed_nodes array<string>, modified_nodes array<string>")
    assert [r.line for r in reports.narrative_text(log).collect()] == ["batch 1: ok", "structure +1 -0 ~0", "? "]
    df = spark.createDataFrame([(["semantic_drift", "out_of_scope"], "removed"), ([], "added"), (None, None)], "f array<string>, c string")
    assert [tuple(r) for r in df.select(*views.risk_order(F.col("f"), F.col("c"))).collect()] == [(0, 6), (3, 3), (3, 7)]
