import json

import pytest

from graphloom.operators import flatten as f

L1 = {"features": [{"feature_id": "f0", "label": "ü\ud800", "source_nodes": ["a", None, {"node_id": "b"}, {"other": 1}, {"node_id": None}, 7]}, None, {"feature_id": "f2", "source_nodes": "c", "previous": {"source_nodes": ["no"]}}, {"source_nodes": None}],
      "feature_relations": {"from": "x", "to": "y", "relation_type": None}}
DOC = {"meta": {"features": [{"source_nodes": ["no"]}]}, "l1": L1, "l2": {"anomalies": [{"anomaly_type": "t", "affected_node_ids": ["n", ["deep"], "m"]}]}}
KEYS = {("feature_node", 0, 0, "a"), ("feature_node", 0, 2, "b"), ("feature_node", 0, 5, "7"), ("feature_node", 2, 0, "c"), ("relation", 0, 0, ""), ("anomaly_node", 0, 0, "n"), ("anomaly_node", 0, 2, "m")}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (json.dumps(DOC), True), ("﻿\r\n " + json.dumps(DOC, indent=1), True), ("Here {it} is:\n```json\n" + json.dumps(DOC) + "\n```\nbye {x}", True),
        (json.dumps(json.dumps(DOC)), True), (json.dumps([DOC]), True), (json.dumps(DOC)[:-1], False), (json.dumps(DOC)[:300], False), ("", False), (" ", False),
        ("no record", False), ("null", False), ("[]", False), ("3", False), ('"text"', False), ("{" * 5000, False), ("[" * 200_000, False),
    ],
)
def test_record(text, found):
    assert (f.record(text) == DOC) if found else f.record(text) is None


def test_nested_keys(spark):
    rows = [(1, json.dumps(DOC)), (1, json.dumps(DOC)), (2, json.dumps(L1)), (3, None), (4, "{}"), (None, json.dumps({"l1": "x", "l2": {"anomalies": [3, {"affected_node_ids": 5}]}}))]
    got = [tuple(r) for r in f.nested_keys(spark.createDataFrame([(*r, "x") for r in rows], "raw_id bigint, payload string, tag string")).collect()]
    want = {(1, *k) for k in KEYS} | {(2, *k) for k in KEYS if k[0] != "anomaly_node"} | {(None, "anomaly_node", 1, 0, "5")}
    assert len(got) == len(want) and {*got} == want
    assert f.nested_keys(spark.createDataFrame([], "raw_id bigint, payload string")).count() == 0


def test_tables_written_and_linked(spark, tmp_path):
    rows = f.tagged(spark.createDataFrame([(1, json.dumps(DOC))], "raw_id bigint, payload string"))
    f.write_tables(rows, str(tmp_path / "flat"))
    back = spark.read.parquet(str(tmp_path / "flat"))
    features, nodes = f.with_schema(back, "feature"), f.with_schema(back, "feature_node")
    joined = nodes.join(features.select("feature_id", features.pk.alias("parent_pk")), "parent_pk").select("feature_id", "node_id", "child_pos")
    assert {tuple(r) for r in joined.collect()} == {("f0", "a", 0), ("f0", "b", 2), ("f0", "7", 5), ("f2", "c", 0)}
    assert features.where("feature_id = 'f0'").first().label == "ü�"


def test_every_field_and_list_comes_out(spark, tmp_path):
    l1 = {"summary": "s", "features": [{"feature_id": "f", "needs_source_review": True, "review_reason": "r"}], "feature_relations": [], "unclassified_nodes": ["u", None, "v"], "infrastructure_nodes": "w"}
    l15 = {"blocks": [{"block_id": "b", "trigger_mechanism": "t", "related_features": ["f"]}], "block_relations": [{"from": "b", "to": "c"}], "infrastructure_block": {"label": "i", "components": ["x", "y"]}}
    l2 = {"modules": [{"module_id": "m", "confidence_reason": "c", "source_nodes": ["n"]}], "module_interactions": [{"from": "m", "to": "k", "inferred_reason": "why"}]}
    rows = f.tables(spark.createDataFrame([(1, json.dumps({"l1": l1, "l1_5": l15, "l2": l2})), (2, json.dumps({"l1": 3, "l1_5": {"infrastructure_block": 5}}))], "raw_id bigint, payload string"), str(tmp_path / "flat"))
    one = lambda tag: [r.asDict() for r in f.with_schema(rows, tag).where("raw_id = 1").orderBy("child_pos").collect()]
    assert (one("feature")[0]["needs_source_review"], one("feature")[0]["review_reason"], one("output")[0]["summary"], one("output")[0]["infrastructure_label"]) == (True, "r", "s", "i")
    assert [(r["child_pos"], r["node_id"]) for r in one("unclassified_node")] == [(0, "u"), (2, "v")] and one("infrastructure_node")[0]["node_id"] == "w"
    assert one("block")[0]["trigger_mechanism"] == "t" and one("block_feature")[0]["feature_id"] == "f" and one("block_relation")[0]["to"] == "c"
    assert [r["component"] for r in one("infrastructure_component")] == ["x", "y"] and one("module")[0]["confidence_reason"] == "c" and one("interaction")[0]["inferred_reason"] == "why"
