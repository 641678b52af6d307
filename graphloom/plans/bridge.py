"""Views of the data directory in the shapes the operators take: graphs, versioned features, snapshots, doubts.

Each view is one SQL text that runs unchanged here and in the SQL engine that checks the results; only the names of base
tables and a few function spellings are filled in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents nodes l1_outputs l15_outputs snapshots feature_summaries "
    "relation_summaries block_summaries raw_outputs source_files token_budgets"
).split()

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY loaded_at DESC) AS rn FROM {{{table}}}) WHERE rn = 1"

VIEWS = {
    # One row for each lifetime of a node.
    "code_nodes": """SELECT project_id, node_id, type, name, file, language, decorators, parameters, return_type, docstring, body_hash, start_line, end_line, node_ord, created_at, removed_at
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, node_id, created_at ORDER BY loaded_at DESC, node_ord) AS rn FROM {nodes}) WHERE rn = 1""",
    # The nodes that exist at the end, each with its place in its project.
    "live_nodes": """SELECT * FROM [code_nodes] WHERE removed_at IS NULL""",
    # Neighbours in a file, as calls from one definition to the next.
    "code_edges": """SELECT project_id, node_id AS from_node, next_node AS to_node, CASE WHEN type = 'class' THEN 'extends' ELSE 'calls' END AS type
FROM (SELECT project_id, node_id, type, lead(node_id) OVER (PARTITION BY project_id, file ORDER BY node_ord, node_id) AS next_node FROM [live_nodes]) WHERE next_node IS NOT NULL""",
    "features": _LATEST.format(keys="version_id, feature_id", table="feature_summaries"),
    "relations": _LATEST.format(keys="version_id, from_feature, to_feature", table="relation_summaries"),
    "blocks": _LATEST.format(keys="version_id, block_id", table="block_summaries"),
    "versions": """SELECT version_id, project_id, {utc} AS made_at, trigger, commit_hash, git_tags, label, contract_version, "timestamp" AS stamp, codebase_path, project_summary, analyzed_files FROM {snapshots}""",
    "pairs": """SELECT version_id, project_id, previous_id FROM (
  SELECT version_id, project_id, lag(version_id) OVER (PARTITION BY project_id ORDER BY made_at, version_id) AS previous_id FROM [versions]) WHERE previous_id IS NOT NULL""",
    # Suppliers and customers as definitions, line items as calls between them.
    "places": """SELECT n_nationkey, lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) || '.py' AS file, lower(replace(r_name, ' ', '_')) AS region
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "trade_nodes": """SELECT file || '::' || s_name AS node_id, s_name AS name, file, 'class' AS type, s_suppkey * 2 AS node_ord FROM {supplier} JOIN [places] ON s_nationkey = n_nationkey
UNION ALL SELECT file || '::' || c_name, c_name, file, 'function', c_custkey * 2 + 1 FROM {customer} JOIN [places] ON c_nationkey = n_nationkey""",
    # The names are put together once for each supplier and customer, before they meet the line items.
    "sup": """SELECT s_suppkey, file || '::' || s_name AS from_node FROM {supplier} JOIN [places] ON s_nationkey = n_nationkey""",
    "cus": """SELECT c_custkey, file || '::' || c_name AS to_node FROM {customer} JOIN [places] ON c_nationkey = n_nationkey""",
    "trade_edges": """SELECT from_node, to_node, CASE WHEN l_linestatus = 'O' THEN 'calls' ELSE 'imports' END AS type,
  CASE l_returnflag WHEN 'R' THEN 'skipped_dynamic' WHEN 'A' THEN 'name_match_ambiguous' ELSE (CASE WHEN l_linestatus = 'O' THEN 'scope_rule' ELSE 'import_alias' END) END AS resolution,
  o_custkey, l_suppkey, l_orderkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN [sup] ON l_suppkey = s_suppkey JOIN [cus] ON o_custkey = c_custkey""",
    # Parts as definitions of a name in a file of a package, line items as calls of a name; a tenth has names that many share, the others names of few.
    "definitions": """SELECT p_partkey AS node_ord, CASE WHEN p_size % 10 = 0 THEN p_name ELSE p_name || ' ' || CAST(p_partkey % 199 AS {text}) END AS name, p_brand AS file, p_type AS package, 'p/' || CAST(p_partkey AS {text}) AS node_id FROM {part}""",
    "calls": """SELECT DISTINCT l_suppkey AS caller, CASE WHEN p_size % 10 = 0 THEN p_name ELSE p_name || ' ' || CAST(p_partkey % 199 AS {text}) END AS name, 'Brand#' || CAST(l_suppkey % 25 + 1 AS {text}) AS file, CASE WHEN l_linestatus = 'O' THEN p_type ELSE 'elsewhere' END AS package FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # Orders as versions of what a customer is: a year is a version.
    "yearly": """SELECT CAST(year(o_orderdate) AS {text}) AS version_id, CAST(o_custkey AS {text}) AS feature_id, max(o_orderpriority) AS label, min(o_orderstatus) AS description
FROM {orders} GROUP BY year(o_orderdate), o_custkey""",
    # Events as the moves of each user's doubt.
    "moves": """SELECT user_id AS doubt_id, event_id, ts, CASE event_type WHEN 'view' THEN 'investigating' WHEN 'click' THEN 'escalated' WHEN 'purchase' THEN 'fixed' WHEN 'signup' THEN 'explained' ELSE 'accepted_risk' END AS to_state,
  lag(CASE event_type WHEN 'view' THEN 'investigating' WHEN 'click' THEN 'escalated' WHEN 'purchase' THEN 'fixed' WHEN 'signup' THEN 'explained' ELSE 'accepted_risk' END, 1, 'discovered') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state
FROM {events}""",
    "findings": """SELECT 'CVE-' || CAST(l_partkey AS {text}) AS cve_id, CAST(l_suppkey AS {text}) AS package, l_returnflag AS version, CASE WHEN l_discount > 0 THEN l_discount * 100 END AS cvss,
  CASE WHEN l_tax >= 0.04 THEN 'V:' || CAST(l_linenumber AS {text}) ELSE '' END AS evidence, CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.06 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' WHEN l_discount > 0 THEN 'low' END AS severity,
  l_orderkey, l_linenumber, l_extendedprice FROM {lineitem}""",
    "l1_features": """SELECT output_id, project_id, version_id, produced_at, f.feature_id AS feature_id, f.label AS label, f.description AS description, f.confidence AS confidence, f.source_nodes AS source_nodes
FROM (SELECT output_id, project_id, version_id, produced_at, {features_of} FROM (SELECT DISTINCT output_id, project_id, version_id, produced_at, l1 FROM {l1_outputs}))""",
}

_SPARK = {
    "text": "STRING", "utc": "CAST(to_timestamp(`timestamp`) AS TIMESTAMP_NTZ)", "features_of": "explode(l1.features) AS f",
}
_DUCK = {"text": "VARCHAR", "utc": "\"timestamp\"::TIMESTAMPTZ AT TIME ZONE 'UTC'", "features_of": "unnest(l1.features) AS f"}


def _needed(name: str) -> list[str]:
    inner = [x for x in re.findall(r"\[(\w+)\]", VIEWS[name])]
    return [*dict.fromkeys(y for x in inner for y in (*_needed(x), x))]


def view(spark: SparkSession, d: str, name: str, distinct: bool = True) -> DataFrame:
    """The view `name` of the directory d; one of distinct rows without that step, if what takes it makes them distinct."""
    names = {t: f"parquet.`{d}/{t}.parquet`" for t in BASE} | _SPARK
    parts = [f"{n} AS ({VIEWS[n].format_map(names)})" for n in _needed(name)]
    body = VIEWS[name] if distinct else re.sub(r"^SELECT DISTINCT ", "SELECT ", VIEWS[name])
    text = (f"WITH {', '.join(parts)} " if parts else "") + body.format_map(names)
    return spark.sql(re.sub(r"\[(\w+)\]", r"\1", text).replace('"timestamp"', "`timestamp`"))


def with_views(names: str, query: str) -> str:
    """query for the checking engine, after the views it uses."""
    wanted = [*dict.fromkeys(y for n in names.split() for y in (*_needed(n), n))]
    tables = {t: t for t in BASE} | _DUCK
    parts = [f"{n} AS ({re.sub(r'\[(\w+)\]', r'\1', VIEWS[n].format_map(tables))})" for n in wanted]
    recursive = "RECURSIVE " if re.match(r"\s*RECURSIVE\b", query) else ""
    body = re.sub(r"^\s*RECURSIVE\b", "", query)
    joint = ", " if re.match(r"\s*\w+(?:\([\w, ]+\))? AS (?:MATERIALIZED )?\(", body) else " "
    return f"WITH {recursive}{', '.join(parts)}{joint}{body.strip()}"
