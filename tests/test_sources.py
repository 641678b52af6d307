import json

from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.sources import documents, tree

SOURCE = '''from a.b import c as d
import os.path as p, sys

@route("/x")
class A(Base, mixin.Other):
    def f(self, x, *y, **z) -> int:
        """Doc."""
        # TODO later
        self.g(); d(1); os.path.join(1)
        def inner(): pass

def main(): pass
'''


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"src/a.py": SOURCE.replace("\n", "\r\n").encode(), "src/bad.py": b"def (", "src/latin.py": b"\xff\xfe", "src/b.TS": b"x", "node_modules/c.py": b"x", "d.txt": b"x", "e.pyc": b"x", "skip.py": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    files = tree.texts(tree.discover(spark, str(tmp_path), ["/skip.py"]))
    assert {(r.path, r.language, r.error) for r in files.collect()} == {("src/a.py", "python", None), ("src/bad.py", "python", None), ("src/latin.py", "python", "not UTF-8"), ("src/b.TS", "typescript", None)}
    rows = {r.name or r.error: r for r in tree.nodes(files).collect()}
    assert {*rows} == {"A", "f", "main", "SyntaxError"}
    assert rows["A"].bases == ["Base", "mixin.Other"] and rows["A"].decorators == ["route('/x')"] and rows["A"].type == "class"
    assert rows["f"].node_id == "src/a.py::A.f" and rows["f"].parameters == ["self", "x", "y", "z"] and rows["f"].return_type == "int" and rows["f"].docstring == "Doc." and rows["f"].comments == ["TODO later"]
    assert {(r.receiver, r.method) for r in tree.call_sites(files).where("caller like '%A.f'").collect()} == {("self", "g"), (None, "d"), ("path", "join")}
    assert {(r.alias, r.original) for r in tree.aliases(files).collect()} == {("d", "c"), ("p", "path"), ("sys", "sys")}
    assert tree.snippet(SOURCE.split("\n"), 6).startswith("    def f") and "inner" in tree.snippet(SOURCE.split("\n"), 6) and "main" not in tree.snippet(SOURCE.split("\n"), 6)


def test_definitions_inside_any_statement():
    source = """
try:
    def a(): pass
except OSError:
    def b(): pass
else:
    def c(): pass
for x in y:
    def d(): pass
while x:
    class E:
        if x:
            async def f(self): pass
match x:
    case 1:
        def g(): pass
async def h():
    async with z:
        def inner(): pass
"""
    assert [n["node_id"] for n in tree.python_nodes("m.py", source)] == [f"m.py::{n}" for n in ("a", "b", "c", "d", "E", "E.f", "g", "h")]


def test_documents(spark, tmp_path):
    doc = {"files": [{"path": "a.py", "language": "python"}], "nodes": [{"node_id": "a.py::f", "name": "f"}], "edges": [{"from": "a.py::f", "to": "x", "type": "calls"}], "topology": []}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "s" / "2.json").write_text("{broken")
    got = documents.structures(spark, str(tmp_path / "s"))
    assert got["edges"].first().resolution == "name_match" and got["nodes"].first().decorators == [] and got["files"].count() == 1
    (tmp_path / "log.jsonl").write_text('{"record_type": "batch", "batch": 1}\nnot json\n{"record_type": "structural_change", "added_nodes": ["a"]}\n')
    rows, bad = documents.log(spark, str(tmp_path / "log.jsonl"))
    assert rows.count() == 2 and [r.value for r in bad.collect()] == ["not json"]
    snap = {"version_id": "v", "timestamp": "t", "l1_snapshot": {"f": {"label": "l", "source_node_count": 3, "source_nodes": []}, "g": {"source_node_count": 1, "source_nodes": ["n"]}}}
    (tmp_path / "snap.json").write_text(json.dumps(snap))
    assert {r.feature_id: r.source_node_count for r in documents.snapshot_features(documents.snapshots(spark, str(tmp_path / "snap.json"))).collect()} == {"f": 0, "g": 1}


def test_versioned_and_regional_folders(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "a/x::f"), ("v2", "b/y::g")], "version_id string, node_id string")
    documents.write_versions(rows, str(tmp_path / "v"))
    assert [r.node_id for r in documents.read_version(spark, str(tmp_path / "v"), "node_id string", "v2").collect()] == ["b/y::g"]
    documents.write_regions(rows, str(tmp_path / "r"))
    assert [r.node_id for r in documents.read_regions(spark, str(tmp_path / "r"), ["a"]).collect()] == ["a/x::f"]
    assert documents.read_regions(spark, str(tmp_path / "r")).count() == 2
    edges = spark.createDataFrame([("a/x::f", "a/x::g"), ("a/x::f", "b/y::h"), ("c::z", "a/x::f")], "from_node string, to_node string")
    documents.region_index(rows.withColumn("file", F.substring_index("node_id", "::", 1)), edges, str(tmp_path / "i"))
    index = {r.region: (r.n_nodes, r.n_inside, r.n_outbound, r.n_inbound) for r in spark.read.parquet(str(tmp_path / "i")).collect()}
    assert index["a"][1:] == (1, 1, 1) and index["_root_"] == (0, 0, 1, 0)


def test_structure_is_written_as_it_is_read(spark, tmp_path):
    import json

    given = {"files": [{"path": "a.py", "language": "python"}], "nodes": [{"node_id": "a.py::g", "name": "g"}, {"node_id": "a.py::f", "name": "f"}], "edges": [{"from": "a.py::g", "to": "a.py::f", "type": "calls"}], "topology": [{"node_id": "a.py::f", "in_degree": 1}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(given))
    tables = {k: v.withColumn("document", F.lit("one")) for k, v in documents.structures(spark, str(tmp_path / "in")).items()}
    documents.write_structure(tables["files"], tables["nodes"], tables["edges"], tables["topology"], str(tmp_path / "out"))
    again = documents.structures(spark, str(tmp_path / "out" / "document=one"))
    for name, order in (("nodes", "node_ord"), ("edges", "edge_ord")):
        a, b = [[r.asDict() | {"document": ""} for r in t[name].orderBy(order).collect()] for t in (tables, again)]
        assert a == b and len(a) == len(given[name])


def test_small_stores(spark):
    reports = spark.createDataFrame([("a", None, "2025-01-09"), ("b", "2025-01-02", "2025-01-01"), ("c", "2025-01-03", "2025-01-01")], "path string, generated_at string, mtime string")
    assert documents.latest_report(reports).first().path == "c"
    stamps = spark.createDataFrame([("zz", 1, "x"), ("diff", 1, "x"), ("extract_structure", 1, "old"), ("extract_structure", 2, "new")], "stage string, stamped_at int, detail string")
    assert [(r.stage, r.detail) for r in documents.ledger(stamps).collect()] == [("extract_structure", "new"), ("diff", "x"), ("zz", "x")]
    state = documents.store_state(F.col("e"), F.col("n"), F.col("r"), F.col("o"))
    df = spark.createDataFrame([(True, 1, True, False), (True, 0, True, False), (False, 0, True, False), (True, 1, False, False), (True, 1, True, True)], "e boolean, n int, r boolean, o boolean")
    assert [x[0] for x in df.select(state).collect()] == ["ok", "empty", "not_found", "path_error", "legacy"]
    assert documents.snapshot_row("v", "2025-01-02T03:04:05Z", "manual")["label"] == "manual-2025-01-02T03:04:05"


def test_texts(spark):
    df = spark.createDataFrame([("kitten", "sitting"), (None, "abc"), ("a b", "a c"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.edit_magnitude("a", "b")).collect()] == [2, 3, 1, 0]
    assert text.word_changes("我 a", "我們 a") == [("equal", "我"), ("add", "們"), ("equal", " a")]
    df = spark.createDataFrame([("Service層 my_API API",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.term_hits(F.col("t"))).collect()] == [["API"], [], []]
    assert [r[0] for r in df.select(text.token_estimate(F.col("t"))).collect()] == [6, None, 0]
    ignored = paths.ignore_regex(["build/", "*.pyc", "/top.py", "# note", "a.b/c"])
    df = spark.createDataFrame([("x/build/y.py",), ("rebuild/y.py",), ("a.pyc",), ("top.py",), ("x/top.py",), ("a.b/c/d",), ("axb/c/d",)], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(ignored)).collect()] == [True, False, True, True, False, True, False]
