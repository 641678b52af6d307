import pytest

from graphloom.operators import graph, validate

EDGES = "project_id string, from_node string, to_node string"
RELATION = "`from` string, `to` string, relation string, relation_type string, inferred_reason string"
FEATURE = "feature_id string, label string, description string, trigger string, trigger_description string, confidence string, confidence_reason string, source_nodes array<string>, needs_source_review boolean, review_reason string"
L1 = f"output_id string, project_id string, l1 struct<summary string, features array<struct<{FEATURE.replace(' string', ': string').replace(' array', ': array').replace(' boolean', ': boolean')}>>, feature_relations array<struct<{RELATION.replace(' string', ': string')}>>, unclassified_nodes array<string>, infrastructure_nodes array<string>>"


def test_static_relation_without_path(spark):
    edges = spark.createDataFrame([("p", f"n{i}", f"n{i + 1}") for i in range(9)] + [("q", "n9", "x")], EDGES)
    owned = spark.createDataFrame([("v", "p", "a", "n0"), ("v", "p", "b", "n9"), ("v", "p", "c", "x"), ("v", "p", "d", "n0"), ("v", "p", "e", None)], "version_id string, project_id string, feature_id string, node_id string")
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("a", "e"), ("a", "gone")]
    relations = spark.createDataFrame([("v", a, b, "static", None) for a, b in pairs] + [("v", "b", "a", "inferred", "why"), ("v", "c", "a", "inferred", "")], "version_id string, from_feature string, to_feature string, relation_type string, inferred_reason string")
    joined = graph.linked(relations.where("relation_type = 'static'"), owned, edges, ["version_id"], ["project_id"])
    assert {(r.from_feature, r.to_feature) for r in joined.collect()} == {("a", "b"), ("a", "d")}
    errors = validate.relation_errors(relations, owned.select("version_id", "feature_id"), joined, ["version_id"])
    assert {(r.from_feature, r.to_feature, r.error) for r in errors.collect()} == {("b", "a", "no_path"), ("b", "c", "no_path"), ("a", "e", "no_path"), ("a", "gone", "unknown_to"), ("c", "a", "no_reason")}


def test_each_of_the_five_checks_fails_an_output(spark):
    def output(name, label="Send the bill", trigger="user_action", b=("n2",), other=("n3",), relation=("a", "b", "uses", "static", None)):
        of = lambda i, nodes, text: (i, text, "It sends.", trigger, "When asked.", None, "Read.", list(nodes), False, None)
        return name, "p", ("All.", [of("a", ["n1"], label), of("b", b, "Keep the bill")], [relation], list(other), [])

    outputs = [
        output("good"), output("schema", trigger="sometimes"), output("coverage", other=()), output("language", label="The billing module of all"),
        output("anchor", b=("n2", "nowhere")), output("relation", relation=("b", "a", "uses", "static", None)),
    ]
    nodes = spark.createDataFrame([("p", "n1"), ("p", "n2"), ("p", "n3")], "project_id string, node_id string")
    edges = spark.createDataFrame([("p", "n1", "n3"), ("p", "n3", "n2")], EDGES)
    rows = validate.output_checks(spark.createDataFrame(outputs, L1), nodes, nodes, edges).collect()
    failed = {r.output_id: {c for c in ("schema", "coverage", "language", "anchor", "relation") if not r[f"{c}_passed"]} for r in rows}
    assert failed == {"good": set()} | {c: {c} for c in ("schema", "coverage", "language", "anchor", "relation")}
    assert {r.output_id for r in rows if r.passed} == {"good"}


@pytest.mark.parametrize(("most", "walked"), [(100, 100), (3, 100), (3, 4)])
def test_pairs_are_linked_by_scope_component_and_rounds(spark, monkeypatch, most, walked):
    monkeypatch.setattr(graph, "MOST_WALKED", walked)
    rows = [("p", f"n{i}", f"n{i + 1}") for i in range(9)] + [("p", "n9", "n5"), ("p", "m0", "m1"), ("p", "m0", "m1"), ("q", "n3", "n0"), ("q", "n0", "m1")]
    owned = [(s, f"f{n}", n) for s in "pq" for n in ("n0", "n3", "n5", "n9", "m0", "m1", "alone")] + [("p", "both", "n3"), ("p", "both", "alone"), ("p", "none", None)]
    spec = "version_id string, project_id string, feature_id string, node_id string"
    own = spark.createDataFrame([("v" + s, s, f, n) for s, f, n in owned] + [("vq", "q", "gone", "x")], spec)
    names = sorted({f for _, f, _ in owned})
    pairs = spark.createDataFrame([("v" + s, a, b) for s in "pq" for a in names for b in names], "version_id string, from_feature string, to_feature string")
    nodes, ahead = {}, {}
    for s, f, n in owned:
        nodes.setdefault((s, f), set()).update([n] if n else [])
    for s, a, b in rows:
        ahead.setdefault((s, a), set()).add(b)

    def after(s, found):
        while more := {m for n in found for m in ahead.get((s, n), ())} - found:
            found = found | more
        return found

    want = {("v" + s, a, b) for s in "pq" for a in names for b in names if after(s, nodes.get((s, a), set())) & nodes.get((s, b), set())}
    edges = spark.createDataFrame(rows, EDGES)
    monkeypatch.setattr(graph, "reach", graph.reach if most == 3 and walked == 4 else None)  # rounds are for huge components only
    found = graph.linked(pairs, own, edges, ["version_id"], ["project_id"], most).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_outputs_never_meet_all_nodes(spark):
    outputs = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "r")], "output_id string, project_id string")
    nodes = spark.createDataFrame([("p", "n1"), ("p", "n1"), ("p", "n2"), ("q", None)], "project_id string, node_id string")
    covered = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("a", "n2"), ("a", "other"), ("b", "n1"), ("b", "n1"), ("b", "other"), ("c", None)], "output_id string, node_id string")
    left = validate.incomplete(outputs, nodes, covered, ["output_id"], ["project_id"])
    wanted = outputs.join(nodes, "project_id")
    assert sorted(left.collect()) == sorted(validate.uncovered(wanted, covered, ["output_id"]).select("output_id").distinct().collect()) == [("b",), ("c",)]
