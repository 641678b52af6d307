"""Queries of timelines, traversal, validation, scope, findings, guidance and views; see reference_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.text import PROHIBITED_TERMS
from graphloom.operators import diff, findings, graph, guidance, membrane, reports, resolve, scope, timeline, validate, views
from graphloom.operators.skew import spread
from graphloom.operators.flatten import with_schema
from graphloom.plans.bridge import view as V
from graphloom.plans.problem_queries import raw_tables
from graphloom.plans.reference_queries import _GRAPH, _ND, _OWN, _SD, _UP, NOW, ORACLES, QUERIES, P, VER, _base, _graph, _nodes, _owned, _raised, _structures, query
from graphloom.session import checkpoint
from graphloom.sources import documents, frontends, tree
from graphloom.streaming import logs

__all__ = ["ORACLES", "QUERIES"]
OUT = ["output_id"]

# --- timelines ---


def _yearly_versions(s, d):
    return V(s, d, "yearly").select("version_id", F.col("version_id").alias("made_at")).distinct()


def _seen(s, d):
    return timeline.appearances(V(s, d, "yearly"), _yearly_versions(s, d), [])


_SEEN = """seen AS (SELECT *, lag(label) OVER w AS l0, lag(description) OVER w AS d0, row_number() OVER w AS k FROM yearly WINDOW w AS (PARTITION BY feature_id ORDER BY version_id))"""
_LINES = f"""{_SEEN}, lines AS (SELECT feature_id, min(version_id) AS first_version, max(version_id) AS last_version, arg_max(label, version_id) AS label, count(*) AS n_versions,
 count(*) FILTER (WHERE k > 1 AND (l0 IS DISTINCT FROM label OR d0 IS DISTINCT FROM description)) AS n_changes, count(*) FILTER (WHERE k > 1 AND l0 IS NOT DISTINCT FROM label AND d0 IS DISTINCT FROM description) AS n_drifts,
 CASE WHEN max(version_id) = (SELECT max(version_id) FROM yearly) THEN 'active' ELSE 'removed' END AS state FROM seen GROUP BY 1)"""


@query("w01_timeline", "yearly", f"{_LINES} SELECT * FROM lines")
def w01(s, d):
    return timeline.timelines(_seen(s, d), [])


_PSEEN = """pv AS (SELECT f.feature_id, f.label, f.description, f.version_id, v.project_id, v.made_at FROM features f JOIN versions v ON v.version_id = f.version_id),
 pseen AS (SELECT *, lag(label) OVER w AS l0, lag(description) OVER w AS d0, row_number() OVER w AS k FROM pv WINDOW w AS (PARTITION BY project_id, feature_id ORDER BY made_at, version_id))"""


def _project_seen(s, d):
    return timeline.appearances(V(s, d, "features").select("version_id", "feature_id", "label", "description"), V(s, d, "versions").select("version_id", "project_id", "made_at"), P)


@query("w02_change_count", "features versions", f"{_PSEEN} SELECT project_id, feature_id, count(*) FILTER (WHERE k > 1 AND (l0 IS DISTINCT FROM label OR d0 IS DISTINCT FROM description)) AS n_changes FROM pseen GROUP BY 1, 2")
def w02(s, d):
    return timeline.timelines(_project_seen(s, d), P).select("project_id", "feature_id", "n_changes")


@query("w03_semantic_drift", "features versions", f"{_PSEEN} SELECT project_id, feature_id, version_id, d0 AS previous, description AS current FROM pseen WHERE k > 1 AND l0 IS NOT DISTINCT FROM label AND d0 IS DISTINCT FROM description")
def w03(s, d):
    return timeline.drift_events(_project_seen(s, d), P)


@query("w04_active_state", "features versions", """pv AS (SELECT f.feature_id, v.project_id, v.made_at, f.version_id FROM features f JOIN versions v ON v.version_id = f.version_id), top AS (SELECT project_id, arg_max(version_id, struct_pack(a := made_at, b := version_id)) AS latest FROM pv GROUP BY 1)
 SELECT project_id, feature_id, CASE WHEN bool_or(version_id = latest) THEN 'active' ELSE 'removed' END AS state FROM pv JOIN top USING (project_id) GROUP BY 1, 2""")
def w04(s, d):
    return timeline.timelines(_project_seen(s, d), P).select("project_id", "feature_id", "state")


@query("w05_timeline_summary", "yearly", f"{_LINES} SELECT count(*) AS n_features, count(*) FILTER (WHERE state = 'active') AS n_active, count(*) FILTER (WHERE n_changes > 0) AS n_changed, sum(n_drifts)::BIGINT AS n_drifts FROM lines")
def w05(s, d):
    return timeline.timeline_summary(timeline.timelines(_seen(s, d), []), [])


@query("w06_one_feature", "yearly", f"{_LINES} SELECT * FROM lines WHERE feature_id = '7'")
def w06(s, d):
    one = V(s, d, "yearly").where("feature_id = '7'")
    latest = _yearly_versions(s, d).agg(F.max("version_id").alias("latest"))
    rows = timeline.timelines(timeline.appearances(one, _yearly_versions(s, d), []), []).withColumn("latest", latest.scalar())
    return rows.withColumn("state", F.when(F.col("last_version") == F.col("latest"), "active").otherwise("removed")).drop("latest")


@query("w07_since", "features versions", "SELECT version_id, feature_id FROM features WHERE version_id IN (SELECT version_id FROM versions WHERE stamp >= '2025-06-01')")
def w07(s, d):
    return timeline.since(V(s, d, "features"), V(s, d, "versions"), "2025-06-01").select("version_id", "feature_id")


@query("w08_timeline_text", "yearly", f"{_LINES} SELECT feature_id, feature_id || ' [' || coalesce(label, '?') || '] ' || state || ' ' || n_changes || ' changes, ' || n_drifts || ' drifts' AS line FROM lines")
def w08(s, d):
    return timeline.rendered(timeline.timelines(_seen(s, d), []), [])


@query("w09_retention", "versions", """g AS (SELECT *, trigger = 'manual' OR len(git_tags) > 0 AS protected FROM versions), r AS (SELECT version_id, row_number() OVER (PARTITION BY project_id ORDER BY made_at DESC, version_id DESC) AS rn FROM g WHERE NOT coalesce(protected, false))
 SELECT g.project_id, g.version_id, CASE WHEN rn IS NULL OR rn <= 5 THEN 'keep' ELSE 'remove' END AS decision FROM g LEFT JOIN r USING (version_id)""")
def w09(s, d):
    return timeline.retention(V(s, d, "versions"), P, 5).select("project_id", "version_id", "decision")


@query("w12_latest_entry", "", "SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def w12(s, d):
    return timeline.latest_record(_base(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


# --- traversal ---


def _starts(nodes):
    return nodes.select("version_id", F.col("node_id").alias("source"), "node_id")


@query("g01_reachability", "features relations", f"RECURSIVE {_GRAPH}, r AS (SELECT version_id, node_id AS source, node_id FROM nodes_ UNION SELECT r.version_id, r.source, e.to_node FROM r JOIN edges_ e ON e.version_id = r.version_id AND e.from_node = r.node_id) SELECT * FROM r")
def g01(s, d):
    nodes, edges = _graph(s, d)
    return graph.reach(_starts(nodes), edges, VER).select("version_id", "source", "node_id")


@query("g02_bounded_path", "features relations", f"""{_GRAPH}, h1 AS (SELECT n.version_id, n.node_id AS source, e.to_node AS node_id FROM nodes_ n JOIN edges_ e ON e.version_id = n.version_id AND e.from_node = n.node_id),
 h2 AS (SELECT h.version_id, h.source, e.to_node AS node_id FROM h1 h JOIN edges_ e ON e.version_id = h.version_id AND e.from_node = h.node_id),
 al AS (SELECT version_id, node_id AS source, node_id, 0 AS hops FROM nodes_ UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT version_id, source, node_id, min(hops)::BIGINT AS hops FROM al GROUP BY 1, 2, 3""")
def g02(s, d):
    nodes, edges = _graph(s, d)
    return graph.reach(_starts(nodes), edges, VER, graph.MOST_HOPS)


_NEAR = "near_ AS (SELECT DISTINCT e.version_id, e.from_node AS a, e.to_node AS b FROM (SELECT version_id, from_node, to_node FROM edges_ UNION ALL SELECT version_id, to_node, from_node FROM edges_) e JOIN nodes_ x ON x.version_id = e.version_id AND x.node_id = e.from_node JOIN nodes_ y ON y.version_id = e.version_id AND y.node_id = e.to_node WHERE e.from_node <> e.to_node)"


@query("g03_adjacency", "features relations", f"{_GRAPH}, {_NEAR} SELECT * FROM near_")
def g03(s, d):
    nodes, edges = _graph(s, d)
    return graph.undirected(nodes, edges, VER)


@query("g04_components", "features relations", f"RECURSIVE {_GRAPH}, {_NEAR}, r AS (SELECT version_id, node_id AS source, node_id FROM nodes_ UNION SELECT r.version_id, r.source, n.b FROM r JOIN near_ n ON n.version_id = r.version_id AND n.a = r.node_id) SELECT version_id, node_id, min(source) AS component FROM r GROUP BY 1, 2")
def g04(s, d):
    nodes, edges = _graph(s, d)
    return graph.components(nodes, edges, VER)


def _chunks(s, d):
    nodes, edges = _graph(s, d)
    sized = nodes.withColumn("tokens", F.char_length("node_id").cast("bigint"))
    return sized, edges, graph.chunks(sized, edges, "version_id", 150, 2)


@query("g07_chunk_plan")
def g07(s, d):
    return _chunks(s, d)[2]


@query("g08_crossing_edges")
def g08(s, d):
    sized, edges, plan = _chunks(s, d)
    return graph.crossing(graph.undirected(sized, edges, VER), plan, VER)


@query("g09_regimes", "features", "SELECT version_id, sum(length(feature_id))::BIGINT AS total, CASE WHEN sum(length(feature_id)) > 2000000 THEN 'too_large' WHEN sum(length(feature_id)) <= 150 THEN 'small' WHEN sum(length(feature_id)) <= 300 THEN 'medium' ELSE 'large' END AS regime FROM features GROUP BY 1")
def g09(s, d):
    nodes, _ = _graph(s, d)
    return graph.regimes(nodes.withColumn("tokens", F.char_length("node_id").cast("bigint")), VER, 150, 2)


_L1OWN = "own AS (SELECT DISTINCT output_id, project_id, feature_id, unnest(source_nodes) AS node_id FROM l1_features), owned AS (SELECT * FROM own WHERE node_id IS NOT NULL AND feature_id IS NOT NULL)"


def _l1_owned(s, d):
    rows = V(s, d, "l1_features").select("output_id", "project_id", "feature_id", F.explode("source_nodes").alias("node_id"))
    return rows.where("node_id is not null and feature_id is not null").distinct()


@query("g12_node_features", "l1_features", f"{_L1OWN} SELECT output_id, node_id, min(feature_id) AS feature_id, count(DISTINCT feature_id) AS n_owners FROM owned GROUP BY 1, 2")
def g12(s, d):
    return graph.node_features(_l1_owned(s, d), ["output_id"])


_LIFT = f"{_L1OWN}, of_node AS (SELECT output_id, project_id, node_id, min(feature_id) AS feature_id FROM owned GROUP BY 1, 2, 3), oe AS (SELECT DISTINCT o.output_id, e.from_node, e.to_node, e.type FROM of_node o JOIN code_edges e ON e.project_id = o.project_id AND e.from_node = o.node_id)"


@query("g13_lifted_relations", "l1_features code_edges", f"{_LIFT} SELECT DISTINCT oe.output_id, a.feature_id AS from_feature, b.feature_id AS to_feature, oe.type FROM oe JOIN of_node a ON a.output_id = oe.output_id AND a.node_id = oe.from_node JOIN of_node b ON b.output_id = oe.output_id AND b.node_id = oe.to_node WHERE a.feature_id <> b.feature_id")
def g13(s, d):
    owned = _l1_owned(s, d)
    of_node = graph.node_features(owned, ["output_id", "project_id"])
    edges = of_node.select("output_id", "project_id", F.col("node_id").alias("from_node")).join(V(s, d, "code_edges"), ["project_id", "from_node"]).select("output_id", "from_node", "to_node", "type").distinct()
    return graph.lifted(edges, of_node, ["output_id"])[0]


@query("g14_prune_fixpoint")
def g14(s, d):
    nodes, edges = _graph(s, d)
    seeds = V(s, d, "features").where("confidence = 'high'").select("version_id", F.col("feature_id").alias("node_id"))
    return graph.pruned(seeds, edges, VER)


def _judged(s, d):
    owned = _l1_owned(s, d)
    nodes = V(s, d, "live_nodes").select("project_id", "node_id").distinct()
    there = owned.join(nodes, ["project_id", "node_id"]).select("output_id", "node_id").distinct()
    starts = owned.select("project_id", F.concat_ws("|", "output_id", "feature_id").alias("source"), "node_id")
    reached = graph.reach(starts, V(s, d, "code_edges"), P, graph.MOST_HOPS)
    reached = reached.select(F.substring_index("source", "|", 1).alias("output_id"), F.substring_index("source", "|", -1).alias("source"), "node_id", "hops")
    relations = _base(s, d, "l1_outputs").select("output_id", F.inline("l1.feature_relations")).select("output_id", F.col("from").alias("from_feature"), F.col("to").alias("to_feature"), "relation_type")
    relations = relations.where("from_feature is not null and to_feature is not null").distinct()
    return graph.verdicts(relations, owned.select("output_id", "feature_id", "node_id"), there, reached, OUT)


_JUDGED = f"""{_L1OWN}, nn AS (SELECT DISTINCT project_id, node_id FROM live_nodes), known AS (SELECT output_id, feature_id, o.node_id FROM owned o JOIN nn ON nn.project_id = o.project_id AND nn.node_id = o.node_id),
 h1 AS (SELECT output_id, o.project_id, feature_id, e.to_node AS node_id FROM owned o JOIN code_edges e ON e.project_id = o.project_id AND e.from_node = o.node_id),
 h2 AS (SELECT output_id, o.project_id, feature_id, e.to_node AS node_id FROM h1 o JOIN code_edges e ON e.project_id = o.project_id AND e.from_node = o.node_id),
 al AS (SELECT output_id, feature_id, node_id, 0 AS hops FROM owned UNION ALL SELECT output_id, feature_id, node_id, 1 FROM h1 UNION ALL SELECT output_id, feature_id, node_id, 2 FROM h2),
 rel AS (SELECT DISTINCT output_id, r."from" AS from_feature, r."to" AS to_feature, r.relation_type FROM (SELECT output_id, unnest(l1.feature_relations) AS r FROM l1_outputs) WHERE r."from" IS NOT NULL AND r."to" IS NOT NULL),
 hit AS (SELECT a.output_id, a.feature_id AS from_feature, k.feature_id AS to_feature, min(hops)::BIGINT AS hops FROM al a JOIN known k ON k.output_id = a.output_id AND k.node_id = a.node_id GROUP BY 1, 2, 3),
 jud AS (SELECT r.output_id, r.from_feature, r.to_feature, r.relation_type, CASE WHEN relation_type IS NULL THEN 'not_assessed' WHEN relation_type = 'inferred' THEN 'conceptual' WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.output_id = r.output_id AND k.feature_id = r.to_feature) THEN 'undetermined' WHEN h.hops IS NOT NULL THEN 'backed' ELSE 'gap' END AS verdict, h.hops
 FROM rel r LEFT JOIN hit h ON h.output_id = r.output_id AND h.from_feature = r.from_feature AND h.to_feature = r.to_feature)"""


@query("g16_integration_verdict", "l1_features live_nodes code_edges", f"{_JUDGED} SELECT output_id, from_feature, to_feature, relation_type, verdict, CASE WHEN verdict = 'backed' THEN hops END AS hops FROM jud")
def g16(s, d):
    return _judged(s, d)


@query("g17_feature_badges", "l1_features live_nodes code_edges", f"{_JUDGED} SELECT output_id, from_feature AS feature_id, CASE max(CASE verdict WHEN 'gap' THEN 3 WHEN 'undetermined' THEN 2 WHEN 'backed' THEN 1 ELSE 0 END) WHEN 3 THEN 'gap' WHEN 2 THEN 'undetermined' WHEN 1 THEN 'backed' ELSE 'none' END AS badge FROM jud GROUP BY 1, 2")
def g17(s, d):
    return graph.badges(_judged(s, d), OUT)


@query("g18_verdict_counts", "l1_features live_nodes code_edges", f"{_JUDGED} SELECT v.verdict, count(j.verdict) AS n_relations FROM (VALUES ('backed'), ('gap'), ('undetermined'), ('conceptual'), ('not_assessed')) v(verdict) LEFT JOIN jud j USING (verdict) GROUP BY 1")
def g18(s, d):
    return graph.verdict_counts(_judged(s, d))


@query("g20_isolated", "features relations", f"{_GRAPH} SELECT n.version_id, n.node_id, EXISTS (SELECT 1 FROM edges_ e WHERE e.version_id = n.version_id AND e.from_node <> e.to_node AND (e.from_node = n.node_id OR e.to_node = n.node_id)) AS linked FROM nodes_ n")
def g20(s, d):
    return graph.isolated(*_graph(s, d), VER)


# Paths of the graph without its back edges; what is below a node on the longest of them is its depth, and the deepest node's column is 0.
@query("g21_layers", "versions", """RECURSIVE e AS (SELECT DISTINCT l_suppkey % 97 AS a, l_suppkey % 97 + 1 + l_partkey % 7 AS b FROM lineitem),
 p AS (SELECT b AS node, 0 AS d FROM e UNION SELECT a, 0 FROM e UNION SELECT e.a, p.d + 1 FROM p JOIN e ON e.b = p.node),
 dep AS (SELECT node, max(d) AS depth FROM p GROUP BY 1) SELECT lpad(node::VARCHAR, 4, '0') AS node_id, depth::BIGINT AS depth, ((SELECT max(depth) FROM dep) - depth)::BIGINT AS column FROM dep""")
def g21(s, d):
    a = F.col("l_suppkey") % 97
    named = [F.lpad(x.cast("string"), 4, "0").alias(n) for x, n in ((a, "from_node"), (a + 1 + F.col("l_partkey") % 7, "to_node"))]
    return graph.columns(_base(s, d, "lineitem").select(*named).distinct(), [])


# A back edge leads from a node to one that the walk has not left; without them no path comes back to where it began.
@query("g19_back_edges")
def g19(s, d):
    edges = V(s, d, "relations").select("version_id", F.col("from_feature").alias("from_node"), F.col("to_feature").alias("to_node"))
    return graph.back_edges(edges, VER)


@query("g22_bands", "features", "SELECT version_id, feature_id, ((row_number() OVER (PARTITION BY version_id ORDER BY feature_id) - 1) // 8)::BIGINT AS band FROM features")
def g22(s, d):
    return graph.banded(V(s, d, "features").select("version_id", "feature_id"), VER, ["feature_id"])


# --- membrane ---


def _columns(element: str) -> list:
    return [F.col(f"{element}.{c}").alias(c) for c in ("value", "kind", "gap_kind")] + [F.array_join(f"{element}.contrasts", ",").alias("contrasts")]


@query("m07_confidence_element", "features", "SELECT version_id, feature_id, confidence AS value, CASE WHEN confidence IN ('high', 'medium', 'low') THEN 'signal' ELSE 'noise' END AS kind, CASE WHEN confidence IN ('high', 'medium', 'low') THEN NULL ELSE 'indeterminate' END AS gap_kind, CASE WHEN confidence IN ('high', 'medium', 'low') THEN 'high,medium,low' END AS contrasts FROM features")
def m07(s, d):
    return V(s, d, "features").withColumn("e", membrane.signal(F.col("confidence"), "confidence")).select("version_id", "feature_id", *_columns("e"))


@query("m09_diff_element", "features pairs", f"{_ND} SELECT version_id, feature_id, diff_state AS value, 'signal' AS kind, NULL::VARCHAR AS gap_kind, 'added,removed,attribute_changed,dependency_changed,unchanged' AS contrasts FROM met")
def m09(s, d):
    return _nodes(s, d).withColumn("e", membrane.signal(F.col("diff_state"), "node_state")).select("version_id", "feature_id", *_columns("e"))


@query("m11_finding_element", "findings", "SELECT CASE WHEN evidence <> '' AND coalesce(cvss, 0) <= 10 THEN 'relayed' ELSE 'noise' END AS kind, count(*) AS n FROM findings GROUP BY 1")
def m11(s, d):
    element = membrane.relayed(F.col("cve_id"), F.col("evidence"), F.col("cvss"))
    return V(s, d, "findings").select(element["kind"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("m12_doubt_element", "moves", """SELECT DISTINCT to_state AS value, CASE to_state WHEN 'investigating' THEN 'discovered' WHEN 'escalated' THEN 'discovered,investigating' WHEN 'explained' THEN 'investigating,escalated' WHEN 'fixed' THEN 'investigating,escalated' WHEN 'accepted_risk' THEN 'escalated' ELSE '' END AS preconditions,
 CASE to_state WHEN 'investigating' THEN 'explained,fixed,escalated' WHEN 'escalated' THEN 'explained,fixed,accepted_risk' ELSE '' END AS consequences FROM moves""")
def m12(s, d):
    element = membrane.doubt_state(F.col("to_state"))
    rows = V(s, d, "moves").select("to_state").distinct().select(element.alias("e"))
    return rows.select("e.value", F.array_join("e.preconditions", ",").alias("preconditions"), F.array_join("e.consequences", ",").alias("consequences"))


# --- validation ---

_L1NODES = "listed AS (SELECT DISTINCT project_id, output_id, feature_id, unnest(source_nodes) AS node_id FROM l1_features)"


@query("v01_schema_errors", "l1_features", """SELECT output_id, 'feature_id' AS path, 'required' AS error, count(*) AS n FROM l1_features WHERE feature_id IS NULL GROUP BY 1 UNION ALL SELECT output_id, 'label', 'required', count(*) FROM l1_features WHERE label IS NULL GROUP BY 1
 UNION ALL SELECT output_id, 'description', 'required', count(*) FROM l1_features WHERE description IS NULL GROUP BY 1 UNION ALL SELECT output_id, 'confidence', 'enum', count(*) FROM l1_features WHERE confidence NOT IN ('high', 'medium', 'low') GROUP BY 1""")
def v01(s, d):
    rows = validate.schema_errors(V(s, d, "l1_features"), OUT, ["feature_id", "label", "description"], {"confidence": "confidence"})
    return rows.groupBy("output_id", "path", "error").agg(F.count("*").alias("n"))


@query("v02_coverage", "live_nodes l1_features", f"{_L1NODES} SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, node_id FROM live_nodes) n WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.project_id = n.project_id AND l.node_id = n.node_id) GROUP BY 1")
def v02(s, d):
    covered = V(s, d, "l1_features").select("project_id", F.explode("source_nodes").alias("node_id"))
    return validate.uncovered(V(s, d, "live_nodes"), covered, P).groupBy("project_id").agg(F.count("*").alias("n"))


@query("v03_anchor", "code_nodes l1_features", f"""{_L1NODES} SELECT DISTINCT output_id, feature_id, NULL::VARCHAR AS node_id FROM l1_features WHERE coalesce(len(source_nodes), 0) = 0
 UNION SELECT output_id, feature_id, node_id FROM listed l WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code_nodes n WHERE n.project_id = l.project_id AND n.node_id = l.node_id)""")
def v03(s, d):
    return validate.anchor_errors(V(s, d, "l1_features"), V(s, d, "code_nodes"), OUT)


@query("v04_language", "l1_features", r"""h AS (SELECT output_id, feature_id, 'label' AS field, unnest(regexp_extract_all(coalesce(label, ''), '(?i)\b(module|loader|handler|class)\b', 1)) AS t FROM l1_features
 UNION ALL SELECT output_id, feature_id, 'description', unnest(regexp_extract_all(coalesce(description, ''), '(?i)\b(module|loader|handler|class)\b', 1)) FROM l1_features) SELECT output_id, feature_id, field, lower(t) AS term, count(*) AS n FROM h GROUP BY 1, 2, 3, 4""")
def v04(s, d):
    return validate.language_errors(V(s, d, "l1_features"), ["output_id", "feature_id"], ["module", "loader", "handler", "class"])


@query("v05_relations", "features relations", """SELECT version_id, from_feature, to_feature, error FROM (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.from_feature) THEN 'unknown_from'
 WHEN NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.to_feature) THEN 'unknown_to' WHEN relation_type = 'inferred' AND coalesce(inferred_reason, '') = '' THEN 'no_reason' END AS error FROM relations r) WHERE error IS NOT NULL""")
def v05(s, d):
    return validate.relation_errors(V(s, d, "relations"), V(s, d, "features"), None, VER)


_PATHS = """walk AS (SELECT DISTINCT project_id, node_id AS source, node_id FROM own UNION SELECT w.project_id, w.source, e.to_node FROM walk w JOIN code_edges e ON e.project_id = w.project_id AND e.from_node = w.node_id)"""


def _relation_ends(key):
    return f"linked AS (SELECT DISTINCT a.{key}, a.feature_id AS from_feature, b.feature_id AS to_feature FROM own a JOIN walk w ON w.project_id = a.project_id AND w.source = a.node_id JOIN own b ON b.{key} = a.{key} AND b.node_id = w.node_id)"


def _relation_error(key, features):
    known = f"EXISTS (SELECT 1 FROM {features} f WHERE f.{key} = r.{key} AND f.feature_id = r.{{0}})"
    path = f"EXISTS (SELECT 1 FROM linked l WHERE l.{key} = r.{key} AND l.from_feature = r.from_feature AND l.to_feature = r.to_feature)"
    return f"""CASE WHEN NOT {known.format("from_feature")} THEN 'unknown_from' WHEN NOT {known.format("to_feature")} THEN 'unknown_to' WHEN relation_type = 'static' AND NOT {path} THEN 'no_path'
 WHEN relation_type = 'inferred' AND coalesce(inferred_reason, '') = '' THEN 'no_reason' END"""


@query("v05_relation_paths", "features versions relations code_edges", f"""RECURSIVE own AS (SELECT * FROM (SELECT DISTINCT f.version_id, v.project_id, feature_id, unnest(source_nodes) AS node_id FROM features f JOIN versions v ON v.version_id = f.version_id) WHERE node_id IS NOT NULL),
 {_PATHS}, {_relation_ends("version_id")}, er AS (SELECT r.*, {_relation_error("version_id", "features")} AS error FROM relations r) SELECT version_id, from_feature, to_feature, error FROM er WHERE error IS NOT NULL""")
def v05p(s, d):
    """V05 whole: v05_relations and its SQL leave the paths of static relations out."""
    features, relations = V(s, d, "features"), V(s, d, "relations")
    owned = features.drop("project_id").join(V(s, d, "versions").select("version_id", "project_id"), "version_id").select("version_id", "project_id", "feature_id", F.explode("source_nodes").alias("node_id"))
    return validate.relation_errors(relations, features, graph.linked(relations.where("relation_type = 'static'"), owned, V(s, d, "code_edges"), VER, P), VER)


@query("v06_all_checks", "features relations", """e AS (SELECT r.version_id, CASE WHEN NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.from_feature) THEN 1 WHEN NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.to_feature) THEN 1
 WHEN relation_type = 'inferred' AND coalesce(inferred_reason, '') = '' THEN 1 ELSE 0 END AS bad FROM relations r), a AS (SELECT version_id, bool_or(coalesce(source_node_count, 0) > 0 AND coalesce(len(source_nodes), 0) = 0) AS drift FROM features GROUP BY 1),
 k AS (SELECT f.version_id, NOT coalesce(drift, false) AS drift_passed, NOT coalesce((SELECT max(bad) FROM e WHERE e.version_id = f.version_id), 0) > 0 AS relation_passed FROM (SELECT DISTINCT version_id FROM features) f LEFT JOIN a USING (version_id))
 SELECT version_id, drift_passed, relation_passed, drift_passed AND relation_passed AS passed FROM k""")
def v06(s, d):
    features = V(s, d, "features")
    checks = {"drift": diff.count_drift(features), "relation": validate.relation_errors(V(s, d, "relations"), features, None, VER)}
    return validate.passed(checks, features, VER)


@query("v06_output_checks", "code_nodes live_nodes code_edges", f"""RECURSIVE o AS (SELECT DISTINCT output_id, project_id, l1 FROM l1_outputs), f AS (SELECT output_id, project_id, unnest(l1.features, max_depth := 2) FROM o),
 rel AS (SELECT output_id, rr."from" AS from_feature, rr."to" AS to_feature, rr.relation AS relation, rr.relation_type AS relation_type, rr.inferred_reason AS inferred_reason FROM (SELECT output_id, unnest(l1.feature_relations) AS rr FROM o)),
 own AS (SELECT * FROM (SELECT DISTINCT output_id, project_id, feature_id, unnest(source_nodes) AS node_id FROM f) WHERE node_id IS NOT NULL), {_PATHS}, {_relation_ends("output_id")},
 schema_ AS (SELECT output_id FROM o WHERE coalesce(l1.summary, '') = '' OR l1.features IS NULL OR l1.feature_relations IS NULL OR l1.unclassified_nodes IS NULL OR l1.infrastructure_nodes IS NULL
  UNION SELECT output_id FROM f WHERE feature_id IS NULL OR "label" IS NULL OR description IS NULL OR "trigger" IS NULL OR trigger_description IS NULL OR confidence_reason IS NULL OR coalesce(len(source_nodes), 0) = 0 OR needs_source_review IS NULL
   OR "trigger" NOT IN ('user_action', 'scheduled', 'auto_triggered') OR confidence NOT IN ('high', 'medium', 'low')
  UNION SELECT output_id FROM rel WHERE from_feature IS NULL OR to_feature IS NULL OR relation IS NULL OR relation_type IS NULL OR relation_type NOT IN ('static', 'inferred') OR (relation_type = 'inferred' AND coalesce(inferred_reason, '') = '')),
 cov AS (SELECT output_id, project_id, node_id FROM own UNION SELECT output_id, project_id, unnest(l1.unclassified_nodes) FROM o UNION SELECT output_id, project_id, unnest(l1.infrastructure_nodes) FROM o),
 coverage_ AS (SELECT DISTINCT o.output_id FROM o JOIN live_nodes n ON n.project_id = o.project_id WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.output_id = o.output_id AND cov.node_id = n.node_id)),
 language_ AS (SELECT output_id FROM f WHERE regexp_matches(coalesce("label", ''), '(?i)\\b({"|".join(PROHIBITED_TERMS)})\\b') OR regexp_matches(coalesce(description, ''), '(?i)\\b({"|".join(PROHIBITED_TERMS)})\\b')),
 anchor_ AS (SELECT output_id FROM f WHERE coalesce(len(source_nodes), 0) = 0 UNION SELECT output_id FROM own WHERE NOT EXISTS (SELECT 1 FROM code_nodes n WHERE n.project_id = own.project_id AND n.node_id = own.node_id)),
 relation_ AS (SELECT output_id FROM (SELECT r.output_id, {_relation_error("output_id", "f")} AS error FROM rel r) WHERE error IS NOT NULL),
 k AS (SELECT DISTINCT output_id, output_id NOT IN (SELECT output_id FROM schema_) AS schema_passed, output_id NOT IN (SELECT output_id FROM coverage_) AS coverage_passed, output_id NOT IN (SELECT output_id FROM language_) AS language_passed,
  output_id NOT IN (SELECT output_id FROM anchor_) AS anchor_passed, output_id NOT IN (SELECT output_id FROM relation_) AS relation_passed FROM o)
 SELECT *, schema_passed AND coverage_passed AND language_passed AND anchor_passed AND relation_passed AS passed FROM k""")
def v06o(s, d):
    """V06 whole, for each output; v06_all_checks and its SQL run two checks of a version."""
    outputs = _base(s, d, "l1_outputs").select("output_id", "project_id", "l1").distinct()
    return validate.output_checks(outputs, V(s, d, "live_nodes"), V(s, d, "code_nodes"), V(s, d, "code_edges"))


@query("v07_block_references", "blocks features", "l AS (SELECT version_id, unnest(related_features) AS feature_id FROM blocks) SELECT DISTINCT version_id, feature_id FROM l WHERE feature_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = l.version_id AND f.feature_id = l.feature_id)")
def v07(s, d):
    listed = V(s, d, "blocks").select("version_id", F.explode("related_features").alias("feature_id"))
    return validate.dangling(listed, V(s, d, "features"), VER, "feature_id")


_BV = """own AS (SELECT version_id, block_id, parent_block_id, coalesce(related_features, []) AS related FROM blocks), lst AS (SELECT version_id, block_id, unnest(related) AS feature_id FROM own),
 br AS (SELECT c.version_id, 'dangling_parent' AS rule FROM own c LEFT JOIN own p ON p.version_id = c.version_id AND p.block_id = c.parent_block_id WHERE c.parent_block_id IS NOT NULL AND p.block_id IS NULL
 UNION ALL SELECT c.version_id, 'too_deep' FROM own c JOIN own p ON p.version_id = c.version_id AND p.block_id = c.parent_block_id WHERE p.parent_block_id IS NOT NULL
 UNION ALL SELECT p.version_id, 'parent_has_features' FROM own p WHERE len(related) > 0 AND EXISTS (SELECT 1 FROM own c WHERE c.version_id = p.version_id AND c.parent_block_id = p.block_id)
 UNION ALL SELECT version_id, 'unknown_feature' FROM lst l WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = l.version_id AND f.feature_id = l.feature_id)
 UNION ALL SELECT version_id, 'duplicate_membership' FROM lst GROUP BY version_id, feature_id HAVING count(*) > 1
 UNION ALL SELECT version_id, 'unclassified' FROM features f WHERE NOT EXISTS (SELECT 1 FROM lst l WHERE l.version_id = f.version_id AND l.feature_id = f.feature_id)), bv AS (SELECT version_id, rule, count(*) AS n FROM br GROUP BY 1, 2)"""


@query("v09_block_rules", "blocks features", f"{_BV} SELECT * FROM bv")
def v09(s, d):
    return validate.block_violations(V(s, d, "blocks"), V(s, d, "features"))


@query("v09_first_violation", "blocks features", f"{_BV} SELECT version_id, arg_min(rule, CASE rule WHEN 'dangling_parent' THEN 1 WHEN 'too_deep' THEN 2 WHEN 'parent_has_features' THEN 3 WHEN 'unknown_feature' THEN 4 WHEN 'duplicate_membership' THEN 5 ELSE 6 END) AS rule FROM bv GROUP BY 1")
def v09f(s, d):
    return validate.first_violation(validate.block_violations(V(s, d, "blocks"), V(s, d, "features")))


@query("v10_contract", "", """SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.field, b.field) AS field, CASE WHEN b.entity IS NULL THEN 'write_gap' WHEN a.entity IS NULL THEN 'coverage_gap' ELSE 'match' END AS status
 FROM (SELECT DISTINCT p_brand AS entity, p_type AS field FROM part WHERE p_size <= 25) a FULL JOIN (SELECT DISTINCT p_brand AS entity, p_type AS field FROM part WHERE p_retailprice >= 1000) b ON a.entity = b.entity AND a.field = b.field""")
def v10(s, d):
    pairs = lambda c: _base(s, d, "part").where(c).select(F.col("p_brand").alias("entity"), F.col("p_type").alias("field"))
    return validate.contract(pairs("p_size <= 25"), pairs("p_retailprice >= 1000"))


@query("v11_data_model_sites")
def v11(s, d):
    return validate.data_model_sites(V(s, d, "live_nodes"), _base(s, d, "source_files"), P)


@query("v12_vocabulary_misses", "relations", "SELECT relation_type AS value, count(*) AS n FROM relations WHERE relation_type NOT IN ('static', 'inferred') GROUP BY 1")
def v12(s, d):
    return validate.vocabulary_misses(V(s, d, "relations"), "relation_type", "relation_type")


# --- scope and doubts ---


def _scoped(s, d):
    pairs, features = V(s, d, "pairs"), V(s, d, "features").select("version_id", "feature_id")
    before = features.withColumnRenamed("version_id", "previous_id").join(pairs, "previous_id").select("version_id", "feature_id")
    return scope.reconcile(before, features.join(pairs.select("version_id"), "version_id"), VER)


_SC = "sc AS (SELECT coalesce(a.version_id, b.version_id) AS version_id, coalesce(a.feature_id, b.feature_id) AS feature_id, CASE WHEN a.feature_id IS NULL THEN 'out_of_scope' WHEN b.feature_id IS NULL THEN 'in_scope_incomplete' ELSE 'in_scope_complete' END AS scope_state FROM (SELECT p.version_id, f.feature_id FROM pairs p JOIN features f ON f.version_id = p.previous_id) a FULL JOIN (SELECT p.version_id, f.feature_id FROM pairs p JOIN features f ON f.version_id = p.version_id) b ON a.version_id = b.version_id AND a.feature_id = b.feature_id)"


@query("s01_scope", "features pairs", f"{_SC} SELECT * FROM sc")
def s01(s, d):
    return _scoped(s, d)


@query("s02_scope_counts", "features pairs", f"{_SC} SELECT version_id, count(*) FILTER (WHERE scope_state = 'in_scope_complete') AS n_in_scope_complete, count(*) FILTER (WHERE scope_state = 'in_scope_incomplete') AS n_in_scope_incomplete, count(*) FILTER (WHERE scope_state = 'out_of_scope') AS n_out_of_scope FROM sc GROUP BY 1")
def s02(s, d):
    return scope.scope_counts(_scoped(s, d), VER)


@query("s03_new_doubts", "features pairs", f"{_SC}, act AS (SELECT DISTINCT feature_id FROM features WHERE confidence = 'low') SELECT DISTINCT feature_id AS source_node, scope_state AS doubt_type FROM sc WHERE scope_state <> 'in_scope_complete' AND NOT (scope_state = 'out_of_scope' AND feature_id IN (SELECT feature_id FROM act))")
def s03(s, d):
    doubts = V(s, d, "features").where("confidence = 'low'").select(F.col("feature_id").alias("source_node"), F.lit("out_of_scope").alias("doubt_type"), F.lit("discovered").alias("current_state")).distinct()
    return scope.new_doubts(_scoped(s, d), doubts)


@query("s04_diff_in_scope", "features relations pairs", f"{_UP}, {_SC} SELECT coalesce(u.version_id, sc.version_id) AS version_id, count(*) FILTER (WHERE diff_state IN ('added', 'attribute_changed', 'dependency_changed') AND scope_state = 'in_scope_complete') AS n_in_scope, count(*) FILTER (WHERE diff_state IN ('added', 'attribute_changed', 'dependency_changed') AND scope_state = 'out_of_scope') AS n_out_of_scope, count(*) FILTER (WHERE scope_state = 'in_scope_incomplete') AS n_missing FROM up u FULL JOIN sc ON sc.version_id = u.version_id AND sc.feature_id = u.feature_id GROUP BY 1")
def s04(s, d):
    return scope.diff_in_scope(_raised(s, d).select("version_id", "feature_id", "diff_state"), _scoped(s, d))


_LEGAL = "(from_state = 'discovered' AND to_state IN ('investigating', 'escalated')) OR (from_state = 'investigating' AND to_state IN ('explained', 'fixed', 'escalated')) OR (from_state = 'escalated' AND to_state IN ('explained', 'fixed', 'accepted_risk'))"


@query("s05_transition_legality", "moves", f"SELECT from_state, to_state, CASE WHEN from_state IN ('explained', 'fixed', 'accepted_risk') THEN 'terminal' WHEN {_LEGAL} THEN 'legal' ELSE 'illegal' END AS verdict, count(*) AS n FROM moves GROUP BY 1, 2, 3")
def s05(s, d):
    return scope.judged_moves(V(s, d, "moves")).groupBy("from_state", "to_state", "verdict").agg(F.count("*").alias("n"))


_ST = "st AS (SELECT doubt_id, arg_max(to_state, struct_pack(a := ts, b := event_id)) AS current_state, min(ts) AS created_at, max(ts) AS last_move_at, count(*) AS n_moves FROM moves GROUP BY 1)"
_TO = f"{_ST}, tm AS (SELECT *, CASE current_state WHEN 'discovered' THEN date_diff('second', created_at, TIMESTAMP '{NOW}') >= 259200 WHEN 'investigating' THEN date_diff('second', last_move_at, TIMESTAMP '{NOW}') >= 86400 ELSE false END AS timed_out FROM st)"


@query("s07_timeouts", "moves", f"{_TO} SELECT doubt_id, current_state, last_move_at, timed_out FROM tm")
def s07(s, d):
    return scope.timeouts(scope.latest_states(V(s, d, "moves")), NOW, investigation_days=1).select("doubt_id", "current_state", "last_move_at", "timed_out")


@query("s08_listed_doubts", "moves", f"{_ST} SELECT doubt_id, CASE WHEN current_state = 'investigating' AND date_diff('second', last_move_at, TIMESTAMP '{NOW}') >= 604800 THEN 'escalated' ELSE current_state END AS current_state FROM st WHERE current_state NOT IN ('explained', 'fixed', 'accepted_risk')")
def s08(s, d):
    return scope.listed(scope.latest_states(V(s, d, "moves")), NOW, active=True).select("doubt_id", "current_state")


@query("s09_doubt_summary", "moves", f"{_ST}, ty AS (SELECT current_state, CASE WHEN n_moves >= 60 THEN 'anomaly' ELSE 'low_confidence' END AS doubt_type FROM st) SELECT current_state, doubt_type, count(*) AS n FROM ty GROUP BY GROUPING SETS ((current_state), (doubt_type), ())")
def s09(s, d):
    typed = scope.latest_states(V(s, d, "moves")).withColumn("doubt_type", F.when(F.col("n_moves") >= 60, "anomaly").otherwise("low_confidence"))
    return scope.doubt_summary(typed)


# --- findings ---


@query("u01_finding_dedup", "findings", """SELECT cve_id, package, version, cvss, evidence, severity FROM (SELECT *, row_number() OVER (PARTITION BY cve_id, package, version ORDER BY (evidence = ''), coalesce(cvss, -1) DESC, l_orderkey, l_linenumber, l_extendedprice, cvss NULLS FIRST, evidence, severity NULLS FIRST) AS rn FROM findings) WHERE rn = 1""")
def u01(s, d):
    best = findings.deduplicated(V(s, d, "findings"), ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return best.select("cve_id", "package", "version", "cvss", "evidence", "severity")


@query("u02_severity_counts", "findings", "SELECT severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END::BIGINT AS severity_rank, count(*) AS n FROM findings WHERE severity IS NOT NULL GROUP BY 1, 2")
def u02(s, d):
    return findings.severity_counts(V(s, d, "findings"))


@query("u05_severity_header", "findings", "SELECT 'critical: ' || count(*) FILTER (WHERE severity = 'critical') || ' | high: ' || count(*) FILTER (WHERE severity = 'high') || ' | medium: ' || count(*) FILTER (WHERE severity = 'medium') || ' | low: ' || count(*) FILTER (WHERE severity = 'low') AS line FROM findings")
def u05(s, d):
    return findings.header(findings.severity_counts(V(s, d, "findings")))


def _anomalies(s, d):
    rows = raw_tables(s, d)
    kinds = with_schema(rows, "anomaly").select("raw_id", F.col("pk").alias("parent_pk"), "anomaly_type")
    return with_schema(rows, "anomaly_node").join(kinds, ["raw_id", "parent_pk"]).select("raw_id", "node_id", "anomaly_type").distinct()


@query("u03_node_markers")
def u03(s, d):
    return findings.node_markers(_anomalies(s, d))


@query("v08_anomaly_references")
def v08(s, d):
    return validate.dangling(_anomalies(s, d).select("node_id"), V(s, d, "code_nodes"), [], "node_id")


# --- guidance ---


def _states(s, d):
    versions, features = V(s, d, "versions"), V(s, d, "features")
    drift = diff.count_drift(features).groupBy("version_id").agg(F.count("*").alias("x"))
    rows = versions.join(drift, "version_id", "left").groupBy("project_id").agg(
        F.count("*").alias("n_snapshots"), F.count(F.when(F.size("analyzed_files") > 0, 1)).alias("n_with_structure"), F.sum(F.coalesce("x", F.lit(0))).alias("n_drifts")
    )
    return rows.withColumns({"initialised": F.lit(True), "has_structure": F.col("n_with_structure") > 0, "residue_done": F.lit(False)})


@query("n01_next_actions", "versions features", """dr AS (SELECT version_id, count(*) AS x FROM features WHERE source_node_count > 0 AND coalesce(len(source_nodes), 0) = 0 GROUP BY 1),
 st AS (SELECT project_id, count(*) AS a, count(*) FILTER (WHERE len(analyzed_files) > 0) AS b, coalesce(sum(x), 0) AS c FROM versions LEFT JOIN dr USING (version_id) GROUP BY 1)
 SELECT project_id, 'analyze_changes.incremental' AS action, 2::BIGINT AS priority FROM st WHERE a >= 1 UNION ALL SELECT project_id, 'viewer.open', 3 FROM st WHERE a >= 2 UNION ALL SELECT project_id, 'diff.cli', 4 FROM st WHERE a >= 2
 UNION ALL SELECT project_id, 'extract.backfill_structure', 5 FROM st WHERE a > b UNION ALL SELECT project_id, 'extract.repair_drift', 6 FROM st WHERE c > 0 UNION ALL SELECT project_id, 'system_status.show', 90 FROM st UNION ALL SELECT project_id, 'onboarding.read_claude_md', 99 FROM st""")
def n01(s, d):
    return guidance.next_actions(_states(s, d), "cli")


@query("n03_most_recent_project", "versions", "SELECT project_id, max(made_at) AS last_opened_at FROM versions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def n03(s, d):
    return guidance.most_recent(V(s, d, "versions").groupBy("project_id").agg(F.max("made_at").alias("last_opened_at")))


# --- views ---


@query("o01_graph_view", "features relations", f"{_GRAPH} SELECT r.version_id, from_feature, to_feature, EXISTS (SELECT 1 FROM nodes_ n WHERE n.version_id = r.version_id AND n.node_id = from_feature) AND EXISTS (SELECT 1 FROM nodes_ n WHERE n.version_id = r.version_id AND n.node_id = to_feature) AS valid FROM relations r")
def o01(s, d):
    return views.graph_view(V(s, d, "features"), V(s, d, "relations").select("version_id", "from_feature", "to_feature"), VER)


@query("o03_induced_subgraph", "features relations", f"{_GRAPH}, k AS (SELECT version_id, feature_id FROM features WHERE confidence = 'high') SELECT e.* FROM edges_ e WHERE EXISTS (SELECT 1 FROM k WHERE k.version_id = e.version_id AND k.feature_id = e.from_node) AND EXISTS (SELECT 1 FROM k WHERE k.version_id = e.version_id AND k.feature_id = e.to_node)")
def o03(s, d):
    _, edges = _graph(s, d)
    nodes = V(s, d, "features").where("confidence = 'high'").select("version_id", F.col("feature_id").alias("node_id"))
    return views.induced(nodes, edges, VER).select("version_id", "from_node", "to_node", "type")


def _flags(s, d):
    drift = F.when((F.col("before.label") == F.col("now.label")) & (F.col("before.description") != F.col("now.description")), F.lit("semantic_drift"))
    return _nodes(s, d).withColumn("risk_flags", F.array_compact(F.array(drift)))


@query("o05_risk_sort", "features pairs", f"{_ND} SELECT version_id, feature_id, row_number() OVER (PARTITION BY version_id ORDER BY CASE WHEN l0 = l1 AND d0 <> d1 THEN 2 ELSE 3 END, CASE diff_state WHEN 'added' THEN 3 WHEN 'attribute_changed' THEN 4 WHEN 'removed' THEN 6 ELSE 7 END, feature_id) AS place FROM met")
def o05(s, d):
    from graphloom.operators.skew import ranked

    order = views.risk_order(F.col("risk_flags"), F.col("diff_state"))
    rows = _flags(s, d).withColumns({"a": order[0], "b": order[1]})
    return ranked(rows.select("version_id", "feature_id", "a", "b"), VER, [F.col("a").asc(), F.col("b").asc(), F.col("feature_id").asc()], "place").select("version_id", "feature_id", "place")


@query("o06_magnitude_sort")
def o06(s, d):
    from graphloom.operators.skew import ranked

    rows = _nodes(s, d).where("diff_state = 'attribute_changed'").select("version_id", "feature_id", views.magnitude("before", "now").alias("magnitude"))
    return ranked(rows, VER, [F.col("magnitude").desc(), F.col("feature_id").asc()], "place")


@query("o07_report_sort", "features pairs", f"{_ND} SELECT version_id, feature_id, row_number() OVER (PARTITION BY version_id ORDER BY CASE WHEN l0 = l1 AND d0 <> d1 THEN 0 ELSE 1 END, CASE diff_state WHEN 'added' THEN 3 WHEN 'attribute_changed' THEN 4 WHEN 'removed' THEN 6 ELSE 9 END, feature_id) AS place FROM met")
def o07(s, d):
    from graphloom.operators.skew import ranked

    order = views.report_order(F.col("risk_flags"), F.col("diff_state"), F.col("feature_id"))
    names = [f"k{i}" for i in range(len(order))]
    rows = _flags(s, d).withColumns(dict(zip(names, order, strict=True)))
    return ranked(rows.select("version_id", "feature_id", *names), VER, [F.col(n).asc() for n in names], "place").select("version_id", "feature_id", "place")


@query("o08_change_counts", "features relations pairs", f"{_UP} SELECT v.diff_state, count(u.diff_state) AS n FROM (VALUES ('added'), ('removed'), ('attribute_changed'), ('dependency_changed'), ('unchanged')) v(diff_state) LEFT JOIN up u USING (diff_state) GROUP BY 1")
def o08(s, d):
    return views.with_zero_buckets(_raised(s, d).groupBy("diff_state").agg(F.count("*").alias("n")), "diff_state", validate.VOCABULARIES["node_state"])


@query("o11_block_tree", "blocks features", "l AS (SELECT version_id, block_id, parent_block_id, unnest(related_features) AS feature_id FROM blocks) SELECT l.*, coalesce(f.label, l.feature_id) AS label FROM l LEFT JOIN features f ON f.version_id = l.version_id AND f.feature_id = l.feature_id")
def o11(s, d):
    return views.block_tree(V(s, d, "blocks"), V(s, d, "features")).select("version_id", "block_id", "parent_block_id", "feature_id", "label")


@query("o12_block_stats", "blocks", "SELECT version_id, count(*) AS n_blocks, count(*) FILTER (WHERE confidence = 'high') AS n_high, count(*) FILTER (WHERE confidence = 'medium') AS n_medium, count(*) FILTER (WHERE len(related_features) > 0) AS n_backed FROM blocks GROUP BY 1")
def o12(s, d):
    return views.block_stats(V(s, d, "blocks"))


@query("o13_card_sort", "features", "SELECT version_id, feature_id, row_number() OVER (PARTITION BY version_id ORDER BY source_node_count DESC NULLS LAST, feature_id) AS place FROM features")
def o13(s, d):
    from graphloom.operators.skew import ranked

    return ranked(V(s, d, "features").select("version_id", "feature_id", "source_node_count"), VER, views.card_order("sources"), "place").select("version_id", "feature_id", "place")


@query("o16_mermaid", "features relations", """e AS (SELECT version_id, 0 AS part, '  ' || feature_id || '["' || replace(replace(replace(replace(replace(replace(replace(replace(coalesce(label, ''), '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;'), '|', '&#124;'), chr(10), ' ') || '"]' AS line FROM features
 UNION ALL SELECT version_id, 1, '  ' || from_feature || CASE WHEN relation_type = 'inferred' THEN ' -.-> ' ELSE ' --> ' END || to_feature FROM relations) SELECT version_id, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, line) AS text FROM e GROUP BY 1""")
def o16(s, d):
    return views.mermaid(V(s, d, "features"), V(s, d, "relations"))


@query("o17_mermaid_diff")
def o17(s, d):
    return views.mermaid_diff(_raised(s, d))


@query("q02_top_regions", "live_nodes", "SELECT split_part(file, '/', 1) AS prefix, count(*) AS n FROM live_nodes GROUP BY 1 ORDER BY n DESC, prefix LIMIT 20")
def q02(s, d):
    return V(s, d, "live_nodes").groupBy(F.substring_index("file", "/", 1).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "prefix").limit(20)


@query("q03_empty_sources", "features", "SELECT version_id, count(*) FILTER (WHERE coalesce(len(source_nodes), 0) = 0) AS n FROM features GROUP BY 1")
def q03(s, d):
    return V(s, d, "features").groupBy("version_id").agg(F.count(F.when(F.coalesce(F.size("source_nodes"), F.lit(0)) == 0, 1)).alias("n"))


@query("q11_preferred_reference", "versions", "SELECT version_id, coalesce(git_tags[1], nullif(label, ''), version_id) AS ref FROM versions")
def q11(s, d):
    return V(s, d, "versions").select("version_id", views.preferred_reference(F.col("git_tags"), F.col("label"), F.col("version_id")).alias("ref"))


@query("q12_summary_line", "features", "SELECT version_id, count(*) || ' features, ' || count(*) FILTER (WHERE confidence = 'low') || ' low, ' || count(*) FILTER (WHERE confidence IS NULL) || ' unassessed' AS line FROM features GROUP BY 1")
def q12(s, d):
    return views.summary_line(V(s, d, "features"))


# --- sources and streams ---


@query("src02_language", "", """SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.cs' THEN 'csharp' END AS language, count(*) AS n FROM source_files GROUP BY 1, 2""")
def src02(s, d):
    return _base(s, d, "source_files").groupBy("path", paths.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("src03_ignored", "", "SELECT path FROM source_files WHERE NOT regexp_matches(path, '(^|/)tests/') AND NOT regexp_matches(path, '(^|/)[^/]*[.]rs$')")
def src03(s, d):
    return tree.kept(_base(s, d, "source_files").select("path"), ["tests/", "*.rs"])


def _source_texts(s, d):
    named = F.lower(F.trim("language"))
    known = F.when(named.isin(*frontends.RULES), named)
    language = F.coalesce(paths.language_of(F.col("path")), known).alias("language")
    return spread(_base(s, d, "source_files").select("path", F.col("content").alias("text"), language).distinct())


@query("src05_nodes")
def src05(s, d):
    return tree.nodes(_source_texts(s, d)).groupBy("language", "type", "error").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


@query("e02_call_sites")
def e02(s, d):
    return tree.call_sites(_source_texts(s, d)).groupBy("language", "method").agg(F.count("*").alias("n"), F.count("receiver").alias("n_received"))


@query("e03_import_aliases")
def e03(s, d):
    return tree.aliases(_source_texts(s, d)).groupBy("alias", "original").agg(F.count("*").alias("n"))


@query("e12_extends_edges")
def e12(s, d):
    nodes = checkpoint(tree.nodes(_source_texts(s, d)).where("error is null").select("node_id", "name", "file", "type", "language", "node_ord", "bases", paths.package_of(F.col("file")).alias("package")))
    aliases = tree.aliases(_source_texts(s, d)).select("file", "alias", "original")
    return resolve.extends_edges(nodes.where("type = 'class'"), nodes.drop("bases"), aliases, tree.strategy(F.col("language")))


@query("src14_latest_version", "versions", "SELECT version_id, stamp FROM versions ORDER BY stamp DESC, version_id DESC LIMIT 1")
def src14(s, d):
    return documents.latest(V(s, d, "versions")).select("version_id", "stamp")


@query("src15_structure_flags", "versions blocks", "SELECT version_id, version_id IN (SELECT version_id FROM blocks) AS has_structure FROM versions")
def src15(s, d):
    return documents.with_structure_flag(V(s, d, "versions").select("version_id"), V(s, d, "blocks"))


@query("src16_deleted", "versions", "SELECT version_id FROM versions WHERE NOT coalesce(trigger = 'manual', false)")
def src16(s, d):
    versions = V(s, d, "versions")
    return documents.without(versions, versions.where("trigger = 'manual'")).select("version_id")


@query("src30_ledger", "", "SELECT event_type AS stage, max(ts) AS stamped_at, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS detail FROM events GROUP BY 1")
def src30(s, d):
    rows = _base(s, d, "events").select(F.col("event_type").alias("stage"), F.struct("ts", "event_id").alias("stamped_at"), F.col("event_id").alias("detail"))
    return documents.ledger(rows).select("stage", F.col("stamped_at.ts").alias("stamped_at"), "detail")


@query("st01_latest_by_key", "", "SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def st01(s, d):
    return logs.latest_by_key(logs.rows_of(s, f"{d}/events.parquet"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("st02_hourly_counts", "", """SELECT "start", "start" + INTERVAL 1 HOUR AS "end", event_type, n FROM (SELECT date_trunc('hour', ts) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE "start" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st02(s, d):
    rows = logs.finished(logs.windowed(logs.rows_of(s, f"{d}/events.parquet"), "ts", "1 hour", "1 hour", ["event_type"]))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("st03_sessions", "", """SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM
 (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st03(s, d):
    rows = logs.finished(logs.sessions(logs.rows_of(s, f"{d}/events.parquet"), "ts", "2 hours", "1 hour", "user_id"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("st04_escalations", "", """m AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id AS doubt_id, CASE event_type WHEN 'view' THEN 'investigating' ELSE 'discovered' END AS from_state, ts AS since FROM m
 WHERE event_type IN ('view', 'error') AND coalesce(nxt, (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) - ts >= INTERVAL 12 HOUR""".replace("m AS", "WITH m AS", 1))
def st04(s, d):
    rows = logs.rows_of(s, f"{d}/events.parquet")
    moves = rows.select(F.col("user_id").alias("doubt_id"), "ts", F.when(F.col("event_type") == "view", "investigating").when(F.col("event_type") == "error", "discovered").otherwise("fixed").alias("to_state"))
    found = logs.finished(logs.escalations(moves, discovery_hours=12, investigation_hours=12))
    return found.withColumn("since", F.col("since").cast("timestamp_ntz"))


# --- reports ---


@query("e09_receiver_tiers")
def e09(s, d):
    files = _source_texts(s, d)
    nodes = checkpoint(tree.nodes(files).where("error is null").select("node_id", "name", "file", "type", "node_ord", paths.package_of(F.col("file")).alias("package")))
    owner = F.regexp_extract("caller", r"::(.*)[.][^.]+$", 1)
    calls = tree.call_sites(files).select("caller", "receiver", "method", "file", "language", paths.package_of(F.col("file")).alias("package"), F.when(owner != "", owner).alias("caller_class")).distinct()
    named = F.regexp_extract("caller", r"([^.:]+)$", 1)
    language = F.col("language")
    found = resolve.resolve_receivers(calls, nodes, tree.aliases(files).select("file", "alias", "original"), tree.is_dynamic(language, named), tree.strategy(language))
    edges = F.when(F.col("target").isNull(), F.col("n_candidates")).otherwise(1)
    return found.groupBy("language", "resolution").agg(F.count("*").alias("n_calls"), F.sum(edges).cast("bigint").alias("n_edges"))


@query("d17_incremental", "code_nodes l1_features", f"{_SD}, {_OWN}, st AS (SELECT o.project_id, feature_id, count(change) AS c FROM owned o LEFT JOIN delta USING (project_id, node_id) WHERE node_id IS NOT NULL GROUP BY 1, 2) SELECT 'delta' AS part, count(*) AS n FROM delta UNION ALL SELECT 'affected', count(*) FILTER (WHERE c > 0) FROM st UNION ALL SELECT 'inherited', count(*) FILTER (WHERE c = 0) FROM st UNION ALL SELECT 'unmapped', count(*) FROM delta x WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.project_id = x.project_id AND o.node_id = x.node_id)")
def d17(s, d):
    parts = diff.incremental(*_structures(s, d), _owned(s, d), P)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("o04_diff_view", "features relations pairs", f"{_ND}, ch AS (SELECT version_id, feature_id FROM met WHERE diff_state <> 'unchanged') SELECT version_id, from_feature, to_feature FROM relations r WHERE EXISTS (SELECT 1 FROM ch WHERE ch.version_id = r.version_id AND ch.feature_id = r.from_feature) AND EXISTS (SELECT 1 FROM ch WHERE ch.version_id = r.version_id AND ch.feature_id = r.to_feature)")
def o04(s, d):
    return reports.diff_view(_flags(s, d), V(s, d, "relations").select("version_id", "from_feature", "to_feature"), VER)[1]


@query("o10_report_view", "features pairs", f"{_ND} SELECT m.version_id, m.feature_id, diff_state, coalesce(f.label, m.feature_id) AS label, CASE WHEN f.description IS NULL OR trim(f.description) = '' THEN '(missing)' ELSE f.description END AS summary FROM met m LEFT JOIN features f ON f.version_id = m.version_id AND f.feature_id = m.feature_id")
def o10(s, d):
    details = V(s, d, "features").select("version_id", "feature_id", "label", F.col("description").alias("summary"))
    return reports.report_view(_nodes(s, d).select("version_id", "feature_id", "diff_state"), details, ["version_id", "feature_id"])


@query("o18_mermaid_scope", "features pairs", f"{_SC} SELECT version_id, 'graph TD' || chr(10) || string_agg('  ' || feature_id || ':::' || scope_state, chr(10) ORDER BY '  ' || feature_id || ':::' || scope_state) AS text FROM sc GROUP BY 1")
def o18(s, d):
    return reports.mermaid_scope(_scoped(s, d), VER)


@query("o19_serialised", "versions", """SELECT version_id, to_json({'version_id': version_id, 'project_id': project_id, 'trigger': trigger, 'commit_hash': commit_hash, 'git_tags': git_tags, 'label': label, 'contract_version': contract_version, 'stamp': stamp, 'codebase_path': codebase_path, 'project_summary': project_summary, 'analyzed_files': analyzed_files})::VARCHAR AS json FROM versions""")
def o19(s, d):
    return reports.serialised(V(s, d, "versions").drop("made_at"), ["version_id"])


@query("q06_latest_features", "features versions", "l AS (SELECT project_id, arg_max(version_id, struct_pack(a := made_at, b := version_id)) AS version_id FROM versions GROUP BY 1) SELECT DISTINCT l.project_id, feature_id FROM l JOIN features f ON f.version_id = l.version_id")
def q06(s, d):
    return reports.latest_features(V(s, d, "features"), V(s, d, "versions"), P)


@query("q07_version_table", "versions", "SELECT left(version_id, 8) AS short_id, version_id, stamp, trigger, array_to_string(git_tags, ', ') AS tags, coalesce(label, '') AS label FROM versions")
def q07(s, d):
    return reports.version_table(V(s, d, "versions"))


@query("q09_availability", "versions", "SELECT DISTINCT project_id, project_id IN (SELECT project_id FROM nodes) AS has_nodes, project_id IN (SELECT project_id FROM l1_outputs) AS has_outputs, project_id IN (SELECT project_id FROM documents) AS has_documents FROM versions")
def q09(s, d):
    parts = {"has_nodes": "nodes", "has_outputs": "l1_outputs", "has_documents": "documents"}
    return reports.availability(V(s, d, "versions"), {k: _base(s, d, t) for k, t in parts.items()})


@query("q15_feature_verdicts", "l1_features live_nodes code_edges", f"{_JUDGED} SELECT output_id, from_feature AS feature_id, CASE max(CASE verdict WHEN 'gap' THEN 3 WHEN 'undetermined' THEN 2 WHEN 'backed' THEN 1 ELSE 0 END) WHEN 3 THEN 'gap' WHEN 2 THEN 'undetermined' WHEN 1 THEN 'backed' END AS badge FROM jud GROUP BY 1, 2")
def q15(s, d):
    judged = _judged(s, d)
    return reports.with_badges(judged.select("output_id", F.col("from_feature").alias("feature_id")).distinct(), graph.badges(judged, OUT), ["output_id", "feature_id"])
