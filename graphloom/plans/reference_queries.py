"""Queries of the graph, version, validation, scope and guidance operators, each with its check in SQL where SQL has one.

Every query covers its whole tables; NOW and the other literals are parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import diff, projection, regions, resolve, topology, views
from graphloom.plans.bridge import view as V
from graphloom.plans.bridge import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-31 12:00:00"
EARLY, LATE = "2025-07-01 00:00:00", "2026-01-01 00:00:00"
P, VER, OUT = ["project_id"], ["version_id"], ["output_id"]


def query(name: str, views_used: str = "", sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(views_used, sql) if views_used else sql
        return f

    return register


def _base(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features as nodes and relations as edges, a graph for each version."""
    nodes = V(s, d, "features").select("version_id", F.col("feature_id").alias("node_id"))
    edges = V(s, d, "relations").select("version_id", F.col("from_feature").alias("from_node"), F.col("to_feature").alias("to_node"), F.coalesce("relation_type", F.lit("none")).alias("type"))
    return nodes, edges


_GRAPH = """nodes_ AS (SELECT version_id, feature_id AS node_id FROM features),
 edges_ AS (SELECT version_id, from_feature AS from_node, to_feature AS to_node, coalesce(relation_type, 'none') AS type FROM relations)"""
_REGION = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '_root_' END"


def _region(c: str) -> str:
    return _REGION.format(c)


# --- functions on paths and texts ---


@query("f06_body_hash", "", r"SELECT DISTINCT file_id, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) AS body_hash FROM source_files WHERE content IS NOT NULL")
def f06(s, d):
    return _base(s, d, "source_files").where("content is not null").select("file_id", text.body_hash(F.col("content")).alias("body_hash")).distinct()


@query("f08_region_of", "code_nodes", f"SELECT {_region('node_id')} AS region, count(*) AS n FROM code_nodes GROUP BY 1")
def f08(s, d):
    return V(s, d, "code_nodes").groupBy(paths.region_of(F.col("node_id")).alias("region")).agg(F.count("*").alias("n"))


@query("f09_method_of", "code_nodes", "SELECT reverse(split_part(reverse(node_id), '.', 1)) AS method, count(*) AS n FROM code_nodes GROUP BY 1")
def f09(s, d):
    return V(s, d, "code_nodes").groupBy(paths.method_of(F.col("node_id")).alias("method")).agg(F.count("*").alias("n"))


@query("f10_package_of", "code_nodes", "SELECT CASE WHEN contains(file, '/') THEN regexp_extract(file, '(?s)^(.*)/[^/]*$', 1) ELSE '' END AS package, count(*) AS n FROM code_nodes GROUP BY 1")
def f10(s, d):
    return V(s, d, "code_nodes").groupBy(paths.package_of(F.col("file")).alias("package")).agg(F.count("*").alias("n"))


_CATEGORY = """CASE WHEN fn = 'conftest.py' OR starts_with(fn, 'test_') OR ends_with(fn, '_test.py') OR contains(p, '/tests/') OR starts_with(p, 'tests/') THEN 'test'
 WHEN contains(p, '/fixtures/') THEN 'fixture' WHEN contains(p, '/scripts/') OR starts_with(p, 'scripts/') THEN 'script' WHEN contains(p, '/prototype') THEN 'prototype' ELSE 'operational' END"""
_PATHS = "named AS (SELECT *, lower(replace(split_part(node_id, '::', 1), '\\', '/')) AS p, reverse(split_part(reverse(lower(replace(split_part(node_id, '::', 1), '\\', '/'))), '/', 1)) AS fn FROM code_nodes)"


@query("f11_category", "code_nodes", f"{_PATHS} SELECT project_id, {_CATEGORY} AS category, count(*) AS n FROM named GROUP BY 1, 2")
def f11(s, d):
    return V(s, d, "code_nodes").groupBy("project_id", paths.category_of(F.col("node_id")).alias("category")).agg(F.count("*").alias("n"))


_PERSIST = "coalesce(" + ", ".join(
    [f"CASE WHEN contains(lower(name), '{h}') THEN 'name contains ''{h}''' END" for h in paths.PERSIST_NAMES]
    + [f"CASE WHEN contains(lower(file), '/{x}/') OR starts_with(lower(file), '{x}/') THEN 'file under ''{x}/''' END" for x in paths.PERSIST_FOLDERS]
) + ")"


@query("f12_persistence", "code_nodes", f"SELECT {_PERSIST} AS reason, count(*) AS n FROM code_nodes GROUP BY 1")
def f12(s, d):
    return V(s, d, "code_nodes").groupBy(paths.persistence_reason(F.col("name"), F.col("file")).alias("reason")).agg(F.count("*").alias("n"))


_DECORATED = "coalesce(len(list_filter(decorators, lambda x: " + " OR ".join(f"contains(x, '{k}')" for k in paths.ENTRY_DECORATORS) + ")) > 0, false)"


@query("f14_entry_decorator", "code_nodes", f"SELECT type, {_DECORATED} AS entry, count(*) AS n FROM code_nodes GROUP BY 1, 2")
def f14(s, d):
    return V(s, d, "code_nodes").groupBy("type", paths.has_entry_decorator(F.col("decorators")).alias("entry")).agg(F.count("*").alias("n"))


_WIDE_SQL = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"


@query("f17_token_estimate", "", f"""SELECT doc_id, CAST(w + (length(text) - w + 3) // 4 AS BIGINT) AS tokens FROM (
 SELECT doc_id, text, length(text) - length(regexp_replace(text, '{_WIDE_SQL}', '', 'g')) AS w FROM documents)""")
def f17(s, d):
    return _base(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("f20_slug", "features", r"""SELECT DISTINCT feature_id, label, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[\s_]+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM features""")
def f20(s, d):
    return V(s, d, "features").select("feature_id", "label", text.slug(F.col("label")).alias("slug")).distinct()


@query("f21_label_escape", "features", """SELECT DISTINCT label, replace(replace(replace(replace(replace(replace(replace(replace(label, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;'), '|', '&#124;'), chr(10), ' ') AS escaped FROM features""")
def f21(s, d):
    return V(s, d, "features").select("label", text.label_escaped(F.col("label")).alias("escaped")).distinct()


@query("f22_provenance", "versions", "SELECT version_id, CASE WHEN contract_version IS NULL THEN 'unknown' WHEN contract_version = '2' THEN 'current' ELSE 'legacy' END AS provenance FROM versions")
def f22(s, d):
    return V(s, d, "versions").select("version_id", text.provenance(F.col("contract_version"), "2").alias("provenance"))


@query("f23_marker_state", "features", "SELECT version_id, feature_id, CASE WHEN source_node_count = 0 THEN 'incomplete' ELSE coalesce(confidence, 'incomplete') END AS marker FROM features")
def f23(s, d):
    marker = text.marker_state(F.col("source_node_count") == 0, F.lit(False), F.lit(False), F.col("confidence"))
    return V(s, d, "features").select("version_id", "feature_id", marker.alias("marker"))


@query("f27_edit_magnitude")
def f27(s, d):
    met = diff.node_diff(V(s, d, "features"), V(s, d, "pairs")).where("diff_state = 'attribute_changed'")
    return met.select("version_id", "feature_id", views.magnitude("before", "now").alias("magnitude"))


@query("f28_word_diff")
def f28(s, d):
    met = diff.node_diff(V(s, d, "features"), V(s, d, "pairs")).where("diff_state = 'attribute_changed'")
    runs = met.select("version_id", "feature_id", F.explode(text.word_diff(F.col("before.description"), F.col("now.description"))).alias("r"))
    return runs.groupBy("version_id", "feature_id", F.col("r.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.char_length("r.text")).alias("n_chars"))


@query("f29_approximate_distance")
def f29(s, d):
    met = diff.node_diff(V(s, d, "features"), V(s, d, "pairs")).where("diff_state = 'attribute_changed'")
    return met.select("version_id", "feature_id", text.approximate_distance(F.col("before.description"), F.col("now.description")).alias("distance"))


@query("f30_or_missing", "features", "SELECT version_id, feature_id, CASE WHEN label IS NULL OR trim(label) = '' THEN '(missing)' ELSE label END AS label FROM features")
def f30(s, d):
    return V(s, d, "features").select("version_id", "feature_id", text.or_missing(F.col("label")).alias("label"))


@query("f31_reference_label", "versions", """SELECT version_id, left(stamp, 10) || ' ' || coalesce(git_tags[1] || ' ' || left(nullif(commit_hash, ''), 7), git_tags[1], left(nullif(commit_hash, ''), 7), nullif(label, ''), version_id) AS name FROM versions""")
def f31(s, d):
    v = V(s, d, "versions")
    return v.select("version_id", text.reference_label(F.col("stamp"), F.col("git_tags"), F.col("commit_hash"), F.col("label"), F.col("version_id")).alias("name"))


@query("f32_card_filter", "features", "SELECT version_id, feature_id FROM features WHERE coalesce(confidence, '') <> 'high'")
def f32(s, d):
    return V(s, d, "features").where(views.card_filter(confidence="not-high")).select("version_id", "feature_id")


# --- topology ---


@query("t01_known_edges", "features relations", f"{_GRAPH} SELECT e.* FROM edges_ e JOIN nodes_ a ON a.version_id = e.version_id AND a.node_id = e.from_node JOIN nodes_ b ON b.version_id = e.version_id AND b.node_id = e.to_node")
def t01(s, d):
    nodes, edges = _graph(s, d)
    return topology.known_edges(nodes, edges, VER).select("version_id", "from_node", "to_node", "type")


_DEGREE = "deg AS (SELECT node_id, count(*) FILTER (WHERE o) AS out_degree, count(*) FILTER (WHERE NOT o) AS in_degree FROM (SELECT from_node AS node_id, true AS o FROM {e} UNION ALL SELECT to_node, false FROM {e}) GROUP BY 1)"


@query("t02_degree", "trade_nodes trade_edges", f"{_DEGREE.format(e='trade_edges')} SELECT n.node_id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM trade_nodes n LEFT JOIN deg USING (node_id)")
def t02(s, d):
    return topology.degrees(V(s, d, "trade_nodes"), V(s, d, "trade_edges")).select("node_id", "in_degree", "out_degree")


_CODE_DEGREE = """ends_ AS (SELECT project_id, from_node AS node_id, 1 AS o, 0 AS i FROM code_edges UNION ALL SELECT project_id, to_node, 0, 1 FROM code_edges),
 deg AS (SELECT project_id, node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends_ GROUP BY 1, 2),
 counted AS (SELECT n.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM live_nodes n LEFT JOIN deg USING (project_id, node_id)),
 entries AS (SELECT *, """ + _DECORATED + " OR (in_degree = 0 AND out_degree > 0 AND (" + " OR ".join(f"contains(file, '{x}')" for x in paths.ENTRY_FOLDERS) + """)) OR (out_degree > 0 AND (name = 'main' OR ends_with(file, '__main__.py'))) AS is_entry_point FROM counted)"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    return topology.entry_points(topology.degrees(V(s, d, "live_nodes"), V(s, d, "code_edges"), P))


@query("t03_entry_points", "live_nodes code_edges", f"{_CODE_DEGREE} SELECT project_id, node_id, is_entry_point FROM entries")
def t03(s, d):
    return _entries(s, d).select("project_id", "node_id", "is_entry_point")


@query("t04_batches", "live_nodes code_edges", f"""{_CODE_DEGREE},
 rest AS (SELECT project_id, node_id, row_number() OVER (PARTITION BY project_id ORDER BY in_degree DESC, node_ord, node_id) AS rn, count(*) OVER (PARTITION BY project_id) AS c FROM entries WHERE NOT is_entry_point)
 SELECT project_id, node_id, 1::BIGINT AS batch FROM entries WHERE is_entry_point
 UNION ALL SELECT project_id, node_id, least((rn - 1) // ((c + 3) // 4) + 2, 5)::BIGINT FROM rest""")
def t04(s, d):
    return topology.batches(_entries(s, d), P).select("project_id", "node_id", "batch")


@query("t05_topology_rank", "live_nodes code_edges", f"""{_CODE_DEGREE} SELECT project_id, node_id, row_number() OVER (PARTITION BY project_id ORDER BY is_entry_point DESC, CASE WHEN is_entry_point THEN out_degree ELSE in_degree END DESC, node_ord, node_id) AS topology_rank FROM entries""")
def t05(s, d):
    return topology.topology_ranks(_entries(s, d), P).select("project_id", "node_id", "topology_rank")


_BATCHED = f"""{_CODE_DEGREE},
 rest AS (SELECT project_id, node_id, row_number() OVER (PARTITION BY project_id ORDER BY in_degree DESC, node_ord, node_id) AS rn, count(*) OVER (PARTITION BY project_id) AS c FROM entries WHERE NOT is_entry_point),
 placed AS (SELECT project_id, node_id, 1::BIGINT AS batch FROM entries WHERE is_entry_point UNION ALL SELECT project_id, node_id, least((rn - 1) // ((c + 3) // 4) + 2, 5)::BIGINT FROM rest)"""


@query("t06_topology", "live_nodes code_edges", f"""{_BATCHED} SELECT e.project_id, e.node_id, in_degree, out_degree, is_entry_point, batch,
 row_number() OVER (PARTITION BY e.project_id ORDER BY is_entry_point DESC, CASE WHEN is_entry_point THEN out_degree ELSE in_degree END DESC, node_ord, e.node_id) AS topology_rank
 FROM entries e JOIN placed p ON p.project_id = e.project_id AND p.node_id = e.node_id""")
def t06(s, d):
    rows = topology.topology(V(s, d, "live_nodes"), V(s, d, "code_edges"), P)
    return rows.select("project_id", "node_id", "in_degree", "out_degree", "topology_rank", "is_entry_point", "batch")


# --- regions ---


@query("r01_region_members", "live_nodes", f"SELECT project_id, {_region('node_id')} AS region, count(DISTINCT node_id) AS n, min(node_id) AS first_node FROM live_nodes GROUP BY 1, 2")
def r01(s, d):
    return regions.members(V(s, d, "live_nodes"), P).groupBy("project_id", "region").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("first_node"))


_FLOW = f"flow AS (SELECT {_region('from_node')} AS from_region, {_region('to_node')} AS to_region, count(*) AS n_edges FROM trade_edges GROUP BY 1, 2)"


@query("r02_region_flow", "trade_edges", f"{_FLOW} SELECT * FROM flow")
def r02(s, d):
    return regions.flow_matrix(V(s, d, "trade_edges"))


_TOTALS = f"""{_FLOW}, totals AS (SELECT region,
 coalesce((SELECT sum(n_edges) FROM flow WHERE from_region = region AND to_region = region), 0)::BIGINT AS internal,
 coalesce((SELECT sum(n_edges) FROM flow WHERE from_region = region AND to_region <> region), 0)::BIGINT AS outbound,
 coalesce((SELECT sum(n_edges) FROM flow WHERE to_region = region AND from_region <> region), 0)::BIGINT AS inbound,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT to_region || ':' || n_edges AS x FROM flow WHERE from_region = region AND to_region <> region)), '') AS flow_to,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT from_region || ':' || n_edges AS x FROM flow WHERE to_region = region AND from_region <> region)), '') AS flow_from
 FROM (SELECT DISTINCT {_region('node_id')} AS region FROM trade_nodes))"""


@query("r03_region_totals", "trade_nodes trade_edges", f"{_TOTALS} SELECT * FROM totals")
def r03(s, d):
    return regions.region_totals(V(s, d, "trade_nodes"), regions.flow_matrix(V(s, d, "trade_edges")))


@query("r04_one_way_consumers", "trade_nodes trade_edges", f"{_TOTALS} SELECT region, outbound, inbound, outbound::DOUBLE / greatest(inbound, 1) AS ratio, outbound >= 50 AND outbound::DOUBLE / greatest(inbound, 1) >= 50 AS one_way_consumer FROM totals")
def r04(s, d):
    totals = regions.region_totals(V(s, d, "trade_nodes"), regions.flow_matrix(V(s, d, "trade_edges")))
    return regions.one_way_consumers(totals).select("region", "outbound", "inbound", "ratio", "one_way_consumer")


@query("r05_region_shares", "live_nodes code_edges", f"""{_BATCHED}, each AS (SELECT project_id, {_region('node_id')} AS region, batch, count(*) AS n_nodes FROM placed GROUP BY ALL),
 summed AS (SELECT *, (sum(n_nodes) OVER (PARTITION BY project_id, region))::BIGINT AS n_region, (sum(n_nodes) OVER (PARTITION BY project_id))::BIGINT AS n_all FROM each)
 SELECT *, floor((n_region * 2000 + n_all) / (n_all * 2)) / 10 AS share_percent FROM summed""")
def r05(s, d):
    return regions.shares(topology.batches(_entries(s, d), P), P)


@query("r06_graph_totals", "live_nodes code_edges", f"""SELECT n.project_id, count(DISTINCT file) AS n_files, count(*) AS n_nodes, count(DISTINCT {_region('node_id')}) AS n_regions,
 coalesce((SELECT count(*) FROM code_edges e WHERE e.project_id = n.project_id), 0) AS n_edges FROM live_nodes n GROUP BY n.project_id""")
def r06(s, d):
    return regions.graph_totals(V(s, d, "live_nodes"), V(s, d, "code_edges"), P)


@query("r07_node_views", "features relations", f"""{_GRAPH} SELECT n.version_id, n.node_id,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT type || ':' || to_node AS x FROM edges_ e WHERE e.version_id = n.version_id AND e.from_node = n.node_id)), '') AS out_edges,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT type || ':' || from_node AS x FROM edges_ e WHERE e.version_id = n.version_id AND e.to_node = n.node_id)), '') AS in_edges FROM nodes_ n""")
def r07(s, d):
    nodes, edges = _graph(s, d)
    return regions.node_views(nodes, edges, VER).select("version_id", "node_id", "out_edges", "in_edges")


@query("r08_search_topk", "trade_nodes trade_edges", f"""{_DEGREE.format(e='trade_edges')}, hits AS (SELECT n.node_id, coalesce(in_degree, 0) AS in_degree, contains(lower(name), 'supplier') AS in_name, count(*) OVER () AS n_hits
 FROM trade_nodes n LEFT JOIN deg USING (node_id) WHERE contains(lower(name), 'supplier') OR contains(lower(n.node_id), 'supplier')) SELECT * FROM hits ORDER BY in_name DESC, in_degree DESC, node_id LIMIT 20""")
def r08(s, d):
    counted = topology.degrees(V(s, d, "trade_nodes"), V(s, d, "trade_edges"))
    return regions.search(counted, "Supplier").select("node_id", "in_degree", "in_name", "n_hits")


@query("r09_neighbours", "live_nodes code_edges", """wanted AS (SELECT DISTINCT node_id FROM live_nodes WHERE name = 'save_digest'),
 both_ AS (SELECT from_node AS node_id, 'callee' AS role, to_node AS other FROM code_edges WHERE from_node IN (SELECT node_id FROM wanted) UNION SELECT to_node, 'caller', from_node FROM code_edges WHERE to_node IN (SELECT node_id FROM wanted))
 SELECT DISTINCT b.node_id, role, other, file FROM both_ b LEFT JOIN live_nodes l ON l.node_id = other""")
def r09(s, d):
    nodes = V(s, d, "live_nodes")
    return regions.neighbours(nodes, V(s, d, "code_edges"), nodes.where("name = 'save_digest'").select("node_id").distinct()).select("node_id", "role", "other", "file").distinct()


@query("r10_freshness", "code_nodes", """f AS (SELECT file AS path, min(created_at) AS t0, max(created_at) AS t1, count(*) AS n FROM code_nodes GROUP BY 1), g AS (SELECT path, max(length(content)) AS n FROM source_files GROUP BY 1)
 SELECT f.path, CASE WHEN removed THEN 'missing' WHEN n0 = n1 THEN 'fresh' ELSE 'changed' END AS state FROM (SELECT file AS path, count(*) FILTER (WHERE created_at < TIMESTAMP '2025-07-01') AS n0, count(*) FILTER (WHERE created_at < TIMESTAMP '2026-01-01') AS n1, count(*) FILTER (WHERE removed_at IS NULL) = 0 AS removed FROM code_nodes GROUP BY 1) f""")
def r10(s, d):
    nodes = V(s, d, "code_nodes")
    size = lambda t: F.count(F.when(F.col("created_at") < F.lit(t).cast("timestamp_ntz"), 1)).alias("size")
    manifest = nodes.groupBy(F.col("file").alias("path")).agg(F.lit(0).alias("mtime"), size(EARLY))
    listing = nodes.groupBy(F.col("file").alias("path")).agg(F.lit(0).alias("mtime"), size(LATE), F.count(F.when(F.col("removed_at").isNull(), 1)).alias("left")).where("`left` > 0")
    return regions.freshness(manifest, listing)


# --- edge projection ---


@query("x01_split_edges", "trade_edges", "SELECT CASE resolution WHEN 'skipped_dynamic' THEN 'indeterminate' WHEN 'name_match_ambiguous' THEN 'ambiguous' ELSE 'kept' END AS part, type, count(*) AS n FROM trade_edges GROUP BY 1, 2")
def x01(s, d):
    return projection.split_edges(V(s, d, "trade_edges")).groupBy("part", "type").agg(F.count("*").alias("n"))


_RESIDUE = """m AS (SELECT from_node, reverse(split_part(reverse(to_node), '.', 1)) AS method, count(*) AS n FROM trade_edges WHERE resolution = '{0}' GROUP BY 1, 2)
 SELECT from_node, method, n, (sum(n) OVER (PARTITION BY from_node))::BIGINT AS cardinality, (SELECT count(*) FROM trade_edges) AS n_all FROM m"""


@query("x02_indeterminate_residue", "trade_edges", _RESIDUE.format("skipped_dynamic"))
def x02(s, d):
    return projection.residue(V(s, d, "trade_edges"), "indeterminate")


@query("x03_ambiguous_residue", "trade_edges", _RESIDUE.format("name_match_ambiguous"))
def x03(s, d):
    return projection.residue(V(s, d, "trade_edges"), "ambiguous")


@query("x04_fanout", "definitions", "SELECT fanout, count(*) AS n_names FROM (SELECT name, count(*) AS fanout FROM definitions GROUP BY 1) GROUP BY 1")
def x04(s, d):
    return projection.fanout(V(s, d, "definitions"))


@query("x04_fanout_quartiles", "definitions", """v AS (SELECT list(c ORDER BY c) AS l, count(*) AS m FROM (SELECT count(*) AS c FROM definitions GROUP BY name))
 SELECT l[m // 4 + 1] AS p25, l[m // 2 + 1] AS p50, l[3 * m // 4 + 1] AS p75, l[9 * m // 10 + 1] AS p90 FROM v""")
def x04q(s, d):
    return projection.quartiles(projection.fanout(V(s, d, "definitions")))


@query("x05_residue_counters", "trade_edges", """SELECT count(*) AS n_edges, count(*) FILTER (WHERE resolution NOT IN ('skipped_dynamic', 'name_match_ambiguous')) AS n_kept,
 count(DISTINCT CASE WHEN resolution = 'skipped_dynamic' THEN from_node END) AS indeterminate_callers, count(DISTINCT CASE WHEN resolution = 'name_match_ambiguous' THEN from_node END) AS ambiguous_callers FROM trade_edges""")
def x05(s, d):
    return projection.residue_counters(V(s, d, "trade_edges"))


@query("q01_resolution_shares", "trade_edges", "SELECT resolution, count(*) AS n_edges, (SELECT count(*) FROM trade_edges) AS n_all FROM trade_edges GROUP BY 1")
def q01(s, d):
    return projection.resolution_shares(V(s, d, "trade_edges"))


# --- resolution of calls ---


@query("e01_name_index", "definitions", "SELECT name, count(*) AS n_candidates, arg_min(node_id, node_ord) AS first_node FROM definitions GROUP BY 1")
def e01(s, d):
    return resolve.name_index(V(s, d, "definitions"))


_SCOPED = """met AS (SELECT c.*, (SELECT arg_min(node_id, node_ord) FROM definitions x WHERE x.name = c.name AND x.file = c.file) AS in_file,
 (SELECT arg_min(node_id, node_ord) FROM definitions x WHERE x.name = c.name AND x.package = c.package) AS in_package FROM calls c)"""
# Every file imports what the file before it defines.
_ALIASED = """al AS (SELECT DISTINCT 'Brand#' || CAST(CAST(substr(file, 7) AS INTEGER) % 25 + 1 AS VARCHAR) AS file, name AS alias, name AS original FROM definitions)"""
# How the caller's language looks for functions: in the file, in the package, by imports only, or (null) by name alone.
_STRATEGY = "CASE {0} % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'package' WHEN 2 THEN 'global' END"
_RESOLVED = f"""{_SCOPED}, {_ALIASED}, ni AS (SELECT name, count(*) AS n_candidates, arg_min(node_id, node_ord) AS first_node FROM definitions GROUP BY 1),
 tiers AS (SELECT m.caller, m.name, m.file, m.package, {_STRATEGY.format('m.caller')} AS strategy, CASE m.caller % 4 WHEN 0 THEN in_file WHEN 1 THEN in_package END AS scoped,
  CASE WHEN m.caller % 4 < 3 AND al.alias IS NOT NULL THEN first_node END AS aliased, n_candidates FROM met m JOIN ni USING (name) LEFT JOIN al ON al.file = m.file AND al.alias = m.name),
 res AS (SELECT caller, name, file, package, coalesce(scoped, aliased) AS target, CASE WHEN scoped IS NOT NULL THEN 'scope_rule' ELSE 'import_alias' END AS resolution, n_candidates FROM tiers WHERE coalesce(scoped, aliased) IS NOT NULL
  UNION ALL SELECT t.caller, t.name, t.file, t.package, x.node_id, CASE WHEN n_candidates > 3 THEN 'name_match_ambiguous' ELSE 'name_match' END, n_candidates FROM tiers t JOIN definitions x ON x.name = t.name WHERE coalesce(scoped, aliased) IS NULL)"""


def _aliases(s: SparkSession, d: str) -> DataFrame:
    importer = F.concat(F.lit("Brand#"), (F.expr("CAST(substr(file, 7) AS INT)") % 25 + 1).cast("string"))
    return V(s, d, "definitions").select(importer.alias("file"), F.col("name").alias("alias"), F.col("name").alias("original")).distinct()


def _resolved(s: SparkSession, d: str, dynamic=None) -> DataFrame:
    return resolve.resolve(V(s, d, "calls", False), V(s, d, "definitions"), _aliases(s, d), dynamic, F.expr(_STRATEGY.format("caller")), True)


@query("e04_resolution_cascade", "definitions calls", f"{_RESOLVED} SELECT * FROM res")
def e04(s, d):
    return resolve.expanded(_resolved(s, d), V(s, d, "definitions"))


@query("e05_scope_tier", "definitions calls", f"{_SCOPED} SELECT * FROM met")
def e05(s, d):
    return resolve.by_scope(V(s, d, "calls"), V(s, d, "definitions"))


@query("e06_alias_tier", "definitions calls", f"{_ALIASED} SELECT c.*, (SELECT arg_min(node_id, node_ord) FROM definitions x WHERE x.name = al.original) AS by_alias FROM calls c LEFT JOIN al ON al.file = c.file AND al.alias = c.name")
def e06(s, d):
    return resolve.by_alias(V(s, d, "calls"), _aliases(s, d), V(s, d, "definitions"))


@query("e07_fanout_escalation", "definitions calls", f"{_RESOLVED} SELECT resolution, n_candidates > 3 AS many, count(*) AS n_edges, count(DISTINCT (caller, name, file, package)) AS n_calls FROM res GROUP BY 1, 2")
def e07(s, d):
    edges = F.when(F.col("target").isNull(), F.col("n_candidates")).otherwise(1)
    return _resolved(s, d).groupBy("resolution", (F.col("n_candidates") > resolve.FANOUT_LIMIT).alias("many")).agg(F.sum(edges).cast("bigint").alias("n_edges"), F.count("*").alias("n_calls"))


@query("e08_dynamic_dispatch", "definitions calls", f"""{_RESOLVED}, dyn AS (SELECT c.caller, c.name, 'skipped_dynamic' AS resolution, x.node_id AS target FROM calls c JOIN definitions x ON x.name = c.name WHERE starts_with(c.package, 'ECONOMY') AND c.caller % 4 < 3
 UNION ALL SELECT caller, name, resolution, target FROM res WHERE NOT (starts_with(package, 'ECONOMY') AND caller % 4 < 3)) SELECT caller, name, resolution, target, count(*) AS n FROM dyn GROUP BY ALL""")
def e08(s, d):
    return resolve.counted(_resolved(s, d, F.startswith("package", F.lit("ECONOMY"))), V(s, d, "definitions"), ["caller", "name", "resolution"])


@query("e10_receiver_methods", "live_nodes code_edges", """defs AS (SELECT node_id, name, file, type, node_ord FROM live_nodes),
 calls_ AS (SELECT DISTINCT a.name AS receiver, b.name AS method FROM code_edges e JOIN live_nodes a ON a.project_id = e.project_id AND a.node_id = e.from_node JOIN live_nodes b ON b.project_id = e.project_id AND b.node_id = e.to_node),
 near_ AS (SELECT k.receiver, k.method, min(struct_pack(a := x.node_ord, b := x.node_id)).b AS near_node FROM calls_ k JOIN defs c ON c.type = 'class' AND c.name = k.receiver JOIN defs x ON x.name = k.method AND x.file = c.file GROUP BY 1, 2),
 exact_ AS (SELECT k.receiver, k.method, min(struct_pack(a := x.node_ord, b := x.node_id)).b AS exact_node FROM calls_ k JOIN defs x ON x.name = k.method AND ends_with(x.node_id, '::' || k.receiver || '.' || k.method) GROUP BY 1, 2)
 SELECT receiver, method, coalesce(exact_node, near_node) AS target FROM calls_ LEFT JOIN exact_ USING (receiver, method) LEFT JOIN near_ USING (receiver, method)""")
def e10(s, d):
    nodes = V(s, d, "live_nodes").select("project_id", "node_id", "name", "file", "type", "node_ord")
    defs = nodes.select("node_id", "name", "file", "type", F.struct("node_ord", "node_id").alias("node_ord"))
    ends = [nodes.select("project_id", F.col("node_id").alias(f"{side}_node"), F.col("name").alias(out)) for side, out in (("from", "receiver"), ("to", "method"))]
    calls = V(s, d, "code_edges").join(ends[0], ["project_id", "from_node"]).join(ends[1], ["project_id", "to_node"]).select("receiver", "method").distinct()
    return resolve.receivers(calls, defs)


@query("e11_call_edges", "definitions calls", f"{_RESOLVED} SELECT caller AS from_node, target AS to_node, 'calls' AS type, resolution, count(*) AS n FROM res GROUP BY 1, 2, 3, 4")
def e11(s, d):
    return resolve.edge_counts(_resolved(s, d), V(s, d, "definitions"), _aliases(s, d))


@query("e13_import_edges", "definitions calls", """src AS (SELECT file, arg_min(node_id, node_ord) AS from_node FROM definitions GROUP BY 1), i AS (SELECT DISTINCT file, name FROM calls)
 SELECT DISTINCT from_node, x.node_id AS to_node, 'imports' AS type FROM i JOIN definitions x ON x.name = i.name AND x.file <> i.file JOIN src ON src.file = i.file""")
def e13(s, d):
    return resolve.import_edges(V(s, d, "calls").select("file", "name").distinct(), V(s, d, "definitions"))


@query("e14_edge_dedup", "trade_edges", "SELECT from_node, to_node, type, arg_min(resolution, struct_pack(a := l_orderkey, b := resolution)) AS resolution, count(*) AS n_parallel FROM trade_edges GROUP BY 1, 2, 3")
def e14(s, d):
    edges = V(s, d, "trade_edges").select("from_node", "to_node", "type", "resolution", "l_orderkey")
    return resolve.first_edges(edges, ["l_orderkey"]).select("from_node", "to_node", "type", "resolution", "n_parallel")


@query("e15_disambiguated", "code_nodes", """n AS (SELECT project_id, node_id, created_at, row_number() OVER (PARTITION BY project_id, node_id ORDER BY created_at) AS k FROM code_nodes)
 SELECT project_id, node_id, created_at, CASE WHEN k > 1 THEN node_id || '#' || k ELSE node_id END AS unique_id, k > 1 AS collided FROM n""")
def e15(s, d):
    return resolve.disambiguated(V(s, d, "code_nodes").select("project_id", "node_id", "created_at"), P, ["created_at"])


# --- diffs ---

_ND = """met AS (SELECT coalesce(c.pair, o.pair) AS version_id, coalesce(c.feature_id, o.feature_id) AS feature_id, c.label AS l1, o.label AS l0, c.description AS d1, o.description AS d0,
 CASE WHEN o.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed' WHEN c.label IS DISTINCT FROM o.label OR c.description IS DISTINCT FROM o.description THEN 'attribute_changed' ELSE 'unchanged' END AS diff_state
 FROM (SELECT p.version_id AS pair, f.* FROM pairs p JOIN features f ON f.version_id = p.version_id) c FULL JOIN (SELECT p.version_id AS pair, f.* FROM pairs p JOIN features f ON f.version_id = p.previous_id) o ON c.pair = o.pair AND c.feature_id = o.feature_id)"""
_ED = """emet AS (SELECT * FROM (SELECT coalesce(c.pair, o.pair) AS version_id, coalesce(c.from_feature, o.from_feature) AS from_feature, coalesce(c.to_feature, o.to_feature) AS to_feature,
 CASE WHEN o.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed' WHEN c.relation IS DISTINCT FROM o.relation THEN 'modified' END AS diff_state
 FROM (SELECT p.version_id AS pair, f.* FROM pairs p JOIN relations f ON f.version_id = p.version_id) c FULL JOIN (SELECT p.version_id AS pair, f.* FROM pairs p JOIN relations f ON f.version_id = p.previous_id) o
 ON c.pair = o.pair AND c.from_feature = o.from_feature AND c.to_feature = o.to_feature) WHERE diff_state IS NOT NULL)"""
_TOUCH = f"{_ND}, {_ED}, touch AS (SELECT version_id, from_feature AS feature_id FROM emet UNION SELECT version_id, to_feature FROM emet)"
_UP = f"{_TOUCH}, up AS (SELECT m.version_id, m.feature_id, CASE WHEN t.feature_id IS NOT NULL AND diff_state IN ('unchanged', 'attribute_changed') THEN 'dependency_changed' ELSE diff_state END AS diff_state, t.feature_id IS NOT NULL AND diff_state = 'attribute_changed' AS keeps FROM met m LEFT JOIN touch t ON t.version_id = m.version_id AND t.feature_id = m.feature_id)"


def _nodes(s, d):
    return diff.node_diff(V(s, d, "features"), V(s, d, "pairs"))


def _edges(s, d):
    return diff.edge_diff(V(s, d, "relations"), V(s, d, "pairs"))


def _raised(s, d):
    return diff.with_dependencies(_nodes(s, d), _edges(s, d))


@query("d01_node_diff", "features pairs", f"{_ND} SELECT version_id, feature_id, diff_state FROM met")
def d01(s, d):
    return _nodes(s, d).select("version_id", "feature_id", "diff_state")


@query("d02_edge_diff", "relations pairs", f"{_ED} SELECT * FROM emet")
def d02(s, d):
    return _edges(s, d)


@query("d03_touched", "features relations pairs", f"{_TOUCH} SELECT * FROM touch")
def d03(s, d):
    return diff.touched(_edges(s, d))


@query("d04_dependency_changed", "features relations pairs", f"{_UP} SELECT * FROM up")
def d04(s, d):
    return _raised(s, d).select("version_id", "feature_id", "diff_state", F.col("secondary_changes").isNotNull().alias("keeps"))


@query("d05_diff_summary", "features relations pairs", f"""{_UP} SELECT p.version_id, count(*) FILTER (WHERE diff_state = 'added') AS n_added, count(*) FILTER (WHERE diff_state = 'removed') AS n_removed, count(*) FILTER (WHERE diff_state = 'attribute_changed') AS n_attribute_changed,
 count(*) FILTER (WHERE diff_state = 'dependency_changed') AS n_dependency_changed, count(*) FILTER (WHERE diff_state <> 'unchanged') AS n_total FROM pairs p LEFT JOIN up u ON u.version_id = p.version_id GROUP BY 1""")
def d05(s, d):
    return diff.diff_summary(_raised(s, d), V(s, d, "pairs"))


@query("d06_block_diff", "blocks pairs", """SELECT coalesce(c.pair, o.pair) AS version_id, coalesce(c.block_id, o.block_id) AS block_id,
 CASE WHEN o.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed' WHEN c.label IS DISTINCT FROM o.label OR c.responsibility IS DISTINCT FROM o.responsibility THEN 'attribute_changed' ELSE 'unchanged' END AS diff_state
 FROM (SELECT p.version_id AS pair, f.* FROM pairs p JOIN blocks f ON f.version_id = p.version_id) c FULL JOIN (SELECT p.version_id AS pair, f.* FROM pairs p JOIN blocks f ON f.version_id = p.previous_id) o ON c.pair = o.pair AND c.block_id = o.block_id""")
def d06(s, d):
    return diff.node_diff(V(s, d, "blocks"), V(s, d, "pairs"), "block_id", ("label", "responsibility")).select("version_id", "block_id", "diff_state")


@query("d07_uncomparable", "versions features", "SELECT version_id FROM versions v WHERE len(analyzed_files) > 0 AND NOT EXISTS (SELECT 1 FROM features f WHERE f.version_id = v.version_id)")
def d07(s, d):
    return diff.uncomparable(V(s, d, "versions"), V(s, d, "features"))


@query("d08_finding_diff", "findings", """a AS (SELECT cve_id, package, version, arg_min(struct_pack(s := severity, e := evidence), struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS r FROM findings WHERE evidence = '' GROUP BY 1, 2, 3),
 b AS (SELECT cve_id, package, version, arg_min(struct_pack(s := severity, e := evidence), struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS r FROM findings WHERE evidence <> '' GROUP BY 1, 2, 3)
 SELECT coalesce(a.cve_id, b.cve_id) AS cve_id, coalesce(a.package, b.package) AS package, coalesce(a.version, b.version) AS version, CASE WHEN a.cve_id IS NULL THEN 'new' WHEN b.cve_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS diff_state,
 CASE WHEN b.cve_id IS NULL THEN a.r.s ELSE b.r.s END AS severity, CASE WHEN b.cve_id IS NULL THEN a.r.e ELSE b.r.e END AS evidence
 FROM a FULL JOIN b ON a.cve_id = b.cve_id AND a.package = b.package AND a.version = b.version""")
def d08(s, d):
    rows = V(s, d, "findings")
    return diff.finding_diff(rows.where("evidence = ''"), rows.where("evidence <> ''"), ["l_orderkey", "l_linenumber", "l_extendedprice"], ["severity", "evidence"])


def _structures(s, d):
    nodes = V(s, d, "code_nodes")
    at = lambda t: nodes.where((F.col("created_at") <= F.lit(t).cast("timestamp_ntz")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.lit(t).cast("timestamp_ntz"))))
    return at(EARLY), at(LATE)


_AT = "SELECT * FROM code_nodes WHERE created_at <= TIMESTAMP '{0}' AND (removed_at IS NULL OR removed_at > TIMESTAMP '{0}')"
_SD = f"""b0 AS ({_AT.format(EARLY)}), b1 AS ({_AT.format(LATE)}), delta AS (SELECT * FROM (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.node_id, b.node_id) AS node_id,
 CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed' WHEN a.name IS DISTINCT FROM b.name OR a.parameters IS DISTINCT FROM b.parameters OR a.return_type IS DISTINCT FROM b.return_type OR a.decorators IS DISTINCT FROM b.decorators
 OR a.docstring IS DISTINCT FROM b.docstring OR (a.body_hash <> b.body_hash) THEN 'modified' END AS change FROM b0 a FULL JOIN b1 b ON a.project_id = b.project_id AND a.node_id = b.node_id) WHERE change IS NOT NULL)"""
_OWN = "owned AS (SELECT DISTINCT project_id, feature_id, unnest(source_nodes) AS node_id FROM l1_features)"


def _delta(s, d):
    return diff.structure_delta(*_structures(s, d), ["project_id", "node_id"])


def _owned(s, d):
    return V(s, d, "l1_features").select("project_id", "feature_id", F.explode("source_nodes").alias("node_id")).where(F.col("node_id").isNotNull()).distinct()


@query("d09_structure_delta", "code_nodes", f"{_SD} SELECT * FROM delta")
def d09(s, d):
    return _delta(s, d)


@query("d10_affected_features", "code_nodes l1_features", f"""{_SD}, {_OWN} SELECT o.project_id, feature_id, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) FILTER (WHERE change = 'modified') AS n_modified,
 CASE WHEN count(change) = 0 THEN 'inherited' ELSE 'affected' END AS status FROM owned o LEFT JOIN delta USING (project_id, node_id) WHERE node_id IS NOT NULL GROUP BY 1, 2""")
def d10(s, d):
    return diff.affected_features(_owned(s, d), _delta(s, d), P)


@query("d11_unmapped_changes", "code_nodes l1_features", f"{_SD}, {_OWN} SELECT * FROM delta x WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.project_id = x.project_id AND o.node_id = x.node_id)")
def d11(s, d):
    return diff.unmapped_changes(_owned(s, d), _delta(s, d), P)


@query("d12_unmapped_summary", "code_nodes l1_features", f"""{_SD}, {_OWN}, un AS (SELECT * FROM delta x WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.project_id = x.project_id AND o.node_id = x.node_id)),
 named AS (SELECT *, lower(split_part(node_id, '::', 1)) AS p, reverse(split_part(reverse(lower(split_part(node_id, '::', 1))), '/', 1)) AS fn FROM un) SELECT change, {_CATEGORY} AS category, count(*) AS n FROM named GROUP BY 1, 2""")
def d12(s, d):
    return diff.unmapped_changes(_owned(s, d), _delta(s, d), P).groupBy("change", paths.category_of(F.col("node_id")).alias("category")).agg(F.count("*").alias("n"))


@query("d13_structural_change", "code_nodes", f"{_SD} SELECT project_id, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'removed') AS n_removed FROM delta WHERE change <> 'modified' GROUP BY 1")
def d13(s, d):
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}")
    return _delta(s, d).where("change <> 'modified'").groupBy("project_id").agg(count("added"), count("removed"))


_REFS = """refs AS (SELECT DISTINCT project_id, unnest([left(stamp, 10), left(commit_hash, 8), label, version_id, git_tags[1]]) AS ref FROM versions)"""


def _references(s, d):
    given = F.array(F.left("stamp", F.lit(10)), F.left("commit_hash", F.lit(8)), "label", "version_id", F.try_element_at("git_tags", F.lit(1)))
    return V(s, d, "versions").select("project_id", F.explode(given).alias("ref")).where(F.col("ref").isNotNull()).distinct()


@query("d14_reference_resolution", "versions", f"""{_REFS}, t AS (SELECT r.project_id, r.ref, v.version_id, v.made_at, CASE WHEN regexp_full_match(r.ref, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CASE WHEN v.made_at < TRY_CAST(r.ref AS DATE) + INTERVAL 1 DAY THEN 0 END
 WHEN list_contains(v.git_tags, r.ref) OR (length(r.ref) >= 7 AND starts_with(v.commit_hash, r.ref)) THEN 1 WHEN v.label = r.ref THEN 2 WHEN v.version_id = r.ref THEN 3 END AS tier FROM refs r JOIN versions v USING (project_id) WHERE r.ref IS NOT NULL),
 b AS (SELECT project_id, ref, version_id, row_number() OVER (PARTITION BY project_id, ref ORDER BY tier, made_at DESC, version_id DESC) AS rn FROM t WHERE tier IS NOT NULL)
 SELECT r.project_id, r.ref, b.version_id FROM refs r LEFT JOIN b ON b.project_id = r.project_id AND b.ref = r.ref AND rn = 1 WHERE r.ref IS NOT NULL""")
def d14(s, d):
    return diff.resolve_references(V(s, d, "versions"), _references(s, d)).select("project_id", "ref", "version_id")


@query("d15_as_of", "versions", """days AS (SELECT DISTINCT v.project_id, CAST(made_at AS DATE) AS day FROM versions v) SELECT d.project_id, d.day,
 (SELECT version_id FROM versions v WHERE v.project_id = d.project_id AND v.made_at < d.day + INTERVAL 1 DAY ORDER BY made_at DESC, version_id DESC LIMIT 1) AS version_id FROM days d""")
def d15(s, d):
    versions = V(s, d, "versions")
    return diff.as_of(versions, versions.select("project_id", F.col("made_at").cast("date").alias("day")).distinct())


@query("d16_reference_names", "versions", """SELECT project_id, version_id, json_merge_patch('{}', to_json({'version_id': version_id, 'label': nullif(label, ''), 'commit': left(commit_hash, 7), 'tags': CASE WHEN len(git_tags) > 0 THEN array_to_string(git_tags, ',') END}))::VARCHAR AS names FROM versions""")
def d16(s, d):
    return diff.references_of(V(s, d, "versions"))


_CUR = "cur AS (SELECT p.version_id, f.feature_id, f.label FROM pairs p JOIN features f ON f.version_id = p.version_id), old AS (SELECT p.version_id, f.feature_id, f.label FROM pairs p JOIN features f ON f.version_id = p.previous_id)"


def _pair_sides(s, d):
    pairs, features = V(s, d, "pairs"), V(s, d, "features").select("version_id", "feature_id", "label")
    tag = F.concat_ws("|", "version_id", "feature_id").alias("feature_id")
    now = features.join(pairs.select("version_id"), "version_id").select(tag, "label")
    before = features.withColumnRenamed("version_id", "previous_id").join(pairs, "previous_id").select(tag, "label")
    return before, now


def _inherit(choice: str | None):
    return lambda s, d: diff.inherit(*_pair_sides(s, d), choice)


_TAG = "version_id || '|' || feature_id AS feature_id, label"
QUERIES["d18_inherit_overlay"] = _inherit(None)
ORACLES["d18_inherit_overlay"] = with_views("pairs features", f"{_CUR} SELECT {_TAG} FROM cur UNION ALL SELECT {_TAG} FROM old WHERE (version_id, feature_id) NOT IN (SELECT version_id, feature_id FROM cur)")
QUERIES["d19_inherit_added"] = _inherit("A")
ORACLES["d19_inherit_added"] = with_views("pairs features", f"{_CUR} SELECT {_TAG} FROM old UNION ALL SELECT {_TAG} FROM cur WHERE (version_id, feature_id) NOT IN (SELECT version_id, feature_id FROM old)")
QUERIES["d19_inherit_kept"] = _inherit("B")
ORACLES["d19_inherit_kept"] = with_views("pairs features", f"{_CUR} SELECT {_TAG} FROM old WHERE (version_id, feature_id) IN (SELECT version_id, feature_id FROM cur)")


@query("d20_carried_relations", "features relations", "SELECT version_id, from_feature, to_feature FROM relations r WHERE EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.from_feature) AND EXISTS (SELECT 1 FROM features f WHERE f.version_id = r.version_id AND f.feature_id = r.to_feature)")
def d20(s, d):
    return diff.carried_relations(V(s, d, "relations"), V(s, d, "features")).select("version_id", "from_feature", "to_feature")


@query("d21_write_problems", "features relations", """e AS (SELECT version_id, from_feature AS feature_id FROM relations UNION SELECT version_id, to_feature FROM relations)
 SELECT version_id, 'duplicate_feature' AS problem, feature_id AS item FROM feature_summaries GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT version_id, 'unknown_confidence', feature_id FROM feature_summaries WHERE confidence NOT IN ('high', 'medium', 'low')
 UNION ALL SELECT version_id, 'no_source_nodes', feature_id FROM feature_summaries WHERE coalesce(len(source_nodes), 0) = 0
 UNION ALL SELECT version_id, 'unknown_endpoint', feature_id FROM e WHERE NOT EXISTS (SELECT 1 FROM feature_summaries f WHERE f.version_id = e.version_id AND f.feature_id = e.feature_id)""")
def d21(s, d):
    return diff.write_problems(_base(s, d, "feature_summaries"), V(s, d, "relations"))


@query("d22_patch", "features pairs", "c AS (SELECT f.version_id, f.feature_id, o.source_nodes FROM features f JOIN pairs p ON p.version_id = f.version_id JOIN features o ON o.version_id = p.previous_id AND o.feature_id = f.feature_id) SELECT f.version_id, f.feature_id, coalesce(len(coalesce(c.source_nodes, f.source_nodes)), -1)::BIGINT AS n FROM features f LEFT JOIN c USING (version_id, feature_id)")
def d22(s, d):
    features, pairs = V(s, d, "features"), V(s, d, "pairs")
    old = features.select(F.col("version_id").alias("previous_id"), "feature_id", "source_nodes").join(pairs.select("version_id", "previous_id"), "previous_id")
    changes = old.join(features.select("version_id", "feature_id"), ["version_id", "feature_id"]).select("version_id", "feature_id", "source_nodes")
    return diff.patch(features, changes)[0].select("version_id", "feature_id", F.coalesce(F.size("source_nodes"), F.lit(-1)).cast("bigint").alias("n"))


@query("d23_description_prints", "features", "SELECT version_id, feature_id, sha256(coalesce(description, '')) AS print FROM features")
def d23(s, d):
    return diff.description_prints(V(s, d, "features"))


@query("d24_count_drift", "features", "SELECT version_id, feature_id, source_node_count::BIGINT AS declared FROM features WHERE source_node_count > 0 AND coalesce(len(source_nodes), 0) = 0")
def d24(s, d):
    return diff.count_drift(V(s, d, "features"))


_TAGS = "tags AS (SELECT project_id, label AS tag FROM versions WHERE label IS NOT NULL UNION SELECT project_id, unnest(git_tags) FROM versions), known AS (SELECT project_id, unnest(git_tags) AS tag FROM versions)"


@query("d25_unanalysed_tags", "versions", f"{_TAGS} SELECT DISTINCT project_id, tag FROM tags t WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project_id = t.project_id AND k.tag = t.tag)")
def d25(s, d):
    v = V(s, d, "versions")
    tags = v.where("label is not null").select("project_id", F.col("label").alias("tag")).union(v.select("project_id", F.explode("git_tags")))
    return diff.unanalysed_tags(tags, v)
