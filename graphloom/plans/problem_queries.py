"""Queries of the general problems 1, 2, 5 and 6, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import flatten, hierarchy, orphans, snapshot_delta
from graphloom.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "l1_outputs"), table(spark, d, "l15_outputs"), table(spark, d, "nodes"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "l1_outputs"), table(spark, d, "l15_outputs"), table(spark, d, "nodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot_delta.feature_and_relation_records(table(spark, d, "feature_summaries"), table(spark, d, "relation_summaries"))
    return snapshot_delta.snapshot_changes(rows, table(spark, d, "snapshots"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.block_roots(table(spark, d, "block_summaries"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.block_links(table(spark, d, "block_summaries"))
    rows = hierarchy.hierarchies(links, ("path", "children", "back"))
    return rows.select(
        F.col("grp").alias("version_id"), F.col("node").alias("block_id"), F.col("root").alias("root_block_id"), "depth",
        F.array_join("path", "/").alias("path"), "n_descendants", "back_edge",
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every block's descendants as a range: those of its root with first after its own and up to last."""
    rows = hierarchy.hierarchies(hierarchy.block_links(table(spark, d, "block_summaries")), ("interval", "children"))
    return rows.where("depth >= 0").select(F.col("grp").alias("version_id"), F.col("node").alias("block_id"), F.col("root").alias("root_block_id"), "first", "last", "n_descendants")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.nested_keys(table(spark, d, "raw_outputs"))


_WRITTEN: dict[tuple, DataFrame] = {}


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of raw_outputs, written once for a session and what its files are now; later queries read their tags."""
    files = table(spark, d, "raw_outputs").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    digest = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*files.columns)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *files.columns)).alias("y")).first()
    key = (spark.sparkContext.applicationId, d, *digest)
    if key not in _WRITTEN:
        _WRITTEN[key] = flatten.tables(table(spark, d, "raw_outputs"))
    return _WRITTEN[key]


def _flat(tag: str):
    return lambda spark, d: flatten.with_schema(raw_tables(spark, d), tag)


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p5_found": p5_found, "p5_paths": p5_paths,
    "p5_descendants": p5_descendants, "p6_found": p6_found, "p6_features": _flat("feature"), "p6_relations": _flat("relation"),
    "p6_anomalies": _flat("anomaly"), "p6_unclassified": _flat("unclassified_node"), "p6_modules": _flat("module"),
}

_LATEST_BLOCKS = """
  links AS (
    SELECT version_id, block_id, arg_max(CASE WHEN regexp_full_match(coalesce(parent_block_id, ''), '\\s*') THEN '' ELSE parent_block_id END, loaded_at) AS parent
    FROM block_summaries GROUP BY ALL),
  tied AS (
    SELECT a.version_id, a.block_id, b.block_id AS parent
    FROM links a LEFT JOIN links b ON a.version_id = b.version_id AND a.parent = b.block_id),
  tree AS (
    SELECT version_id, block_id, block_id AS root_block_id, 0::BIGINT AS depth, block_id AS path FROM tied WHERE parent IS NULL
    UNION ALL
    SELECT t.version_id, t.block_id, r.root_block_id, r.depth + 1, r.path || '/' || t.block_id
    FROM tied t JOIN tree r ON t.version_id = r.version_id AND t.parent = r.block_id)
"""

ORACLES = {
    "p1_found": """
WITH l1 AS (SELECT DISTINCT output_id, project_id, version_id, produced_at, l1 FROM l1_outputs),
l15 AS (SELECT DISTINCT output_id, project_id, version_id, produced_at, l1_5 FROM l15_outputs),
feats AS (SELECT output_id, project_id, version_id, produced_at, unnest(l1.features).feature_id AS feature_id FROM l1),
ends AS (
  SELECT output_id, produced_at, 'from' AS ref_field, unnest(l1.feature_relations)."from" AS ref_key FROM l1
  UNION ALL SELECT output_id, produced_at, 'to', unnest(l1.feature_relations)."to" FROM l1),
srcs AS (
  SELECT output_id, project_id, produced_at, unnest(nodes) AS ref_key
  FROM (SELECT output_id, project_id, produced_at, unnest(l1.features).source_nodes AS nodes FROM l1)),
rels AS (
  SELECT output_id, project_id, version_id, produced_at, unnest(rf) AS ref_key
  FROM (SELECT output_id, project_id, version_id, produced_at, unnest(l1_5.blocks).related_features AS rf FROM l15)),
held AS (
  SELECT r.*, (SELECT max(a.produced_at) FROM l1 a WHERE a.project_id = r.project_id AND a.version_id = r.version_id AND a.produced_at <= r.produced_at) AS l1_at
  FROM rels r),
cases AS (
  SELECT output_id, produced_at, ref_field, ref_key FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM feats f WHERE f.output_id = e.output_id AND f.feature_id = e.ref_key)
  UNION ALL
  SELECT output_id, produced_at, 'source_nodes', ref_key FROM srcs s
  WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = s.project_id AND n.node_id = s.ref_key
                    AND n.created_at <= s.produced_at AND (n.removed_at IS NULL OR s.produced_at < n.removed_at))
  UNION ALL
  SELECT output_id, produced_at, 'related_features', ref_key FROM held a
  WHERE NOT EXISTS (SELECT 1 FROM feats f WHERE f.project_id = a.project_id AND f.version_id = a.version_id
                    AND f.produced_at = a.l1_at AND f.feature_id = a.ref_key))
SELECT DISTINCT output_id, ref_field, ref_key, strftime(produced_at, '%Y-%m') AS period FROM cases
WHERE ref_key IS NOT NULL AND NOT regexp_full_match(ref_key, '\\s*')""",
    # A start or an end counts where no other lifetime covers it; every reference that came before is then resolved or reopened.
    "p1_report": """
WITH l1 AS (SELECT DISTINCT output_id, project_id, version_id, produced_at, l1 FROM l1_outputs),
l15 AS (SELECT DISTINCT output_id, project_id, version_id, produced_at, l1_5 FROM l15_outputs),
feats AS (SELECT output_id, project_id, version_id, produced_at, unnest(l1.features).feature_id AS feature_id FROM l1),
outs AS (
  SELECT project_id, version_id, produced_at, max(output_id) AS output_id, lead(produced_at) OVER (PARTITION BY project_id, version_id ORDER BY produced_at) AS until
  FROM l1 WHERE produced_at IS NOT NULL GROUP BY 1, 2, 3),
lives AS MATERIALIZED (
  SELECT DISTINCT 'source_nodes' AS space, project_id AS k1, '' AS k2, node_id AS item, created_at AS a, removed_at AS b FROM nodes
  WHERE created_at IS NOT NULL AND (removed_at IS NULL OR removed_at > created_at)
  UNION ALL SELECT DISTINCT 'related_features', f.project_id, f.version_id, f.feature_id, o.produced_at, o.until
  FROM feats f JOIN outs o ON o.output_id = f.output_id AND o.produced_at = f.produced_at WHERE f.feature_id IS NOT NULL),
refs AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT 'source_nodes' AS space, project_id AS k1, '' AS k2, unnest(nodes) AS item, produced_at AS t, output_id
    FROM (SELECT output_id, project_id, produced_at, unnest(l1.features).source_nodes AS nodes FROM l1)
    UNION ALL SELECT 'related_features', project_id, version_id, unnest(rf), produced_at, output_id
    FROM (SELECT output_id, project_id, version_id, produced_at, unnest(l1_5.blocks).related_features AS rf FROM l15)
    UNION ALL SELECT 'from', output_id, '', unnest(l1.feature_relations)."from", produced_at, output_id FROM l1
    UNION ALL SELECT 'to', output_id, '', unnest(l1.feature_relations)."to", produced_at, output_id FROM l1)
  WHERE item IS NOT NULL AND NOT regexp_full_match(item, '\\s*')),
held AS (
  SELECT r.*, CASE WHEN space IN ('from', 'to') THEN NOT EXISTS (SELECT 1 FROM feats f WHERE f.output_id = r.output_id AND f.feature_id = r.item)
    ELSE NOT EXISTS (SELECT 1 FROM lives l WHERE l.space = r.space AND l.k1 = r.k1 AND l.k2 = r.k2 AND l.item = r.item AND l.a <= r.t AND (l.b IS NULL OR r.t < l.b)) END AS lost
  FROM refs r),
starts AS (
  SELECT DISTINCT space, k1, k2, item, a AS t FROM lives s WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.space = s.space AND l.k1 = s.k1 AND l.k2 = s.k2 AND l.item = s.item AND l.a < s.a AND (l.b IS NULL OR l.b >= s.a))),
stops AS (
  SELECT DISTINCT space, k1, k2, item, b AS t FROM lives s WHERE b IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.space = s.space AND l.k1 = s.k1 AND l.k2 = s.k2 AND l.item = s.item AND l.a <= s.b AND (l.b IS NULL OR l.b > s.b))),
moves AS (
  SELECT space, t, 1 AS arrived, lost::INTEGER AS orphaned, 0 AS resolved, 0 AS reopened FROM held
  UNION ALL SELECT s.space, s.t, 0, 0, 1, 0 FROM starts s JOIN refs r USING (space, k1, k2, item) WHERE r.t < s.t
  UNION ALL SELECT s.space, s.t, 0, 0, 0, 1 FROM stops s JOIN refs r USING (space, k1, k2, item) WHERE r.t < s.t),
months AS (SELECT space, date_trunc('month', t)::DATE AS month, sum(arrived) AS arrived, sum(orphaned) AS orphaned, sum(resolved) AS resolved, sum(reopened) AS reopened FROM moves GROUP BY 1, 2),
every AS (SELECT space, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM months GROUP BY 1 UNION SELECT space, month FROM months),
filled AS (
  SELECT e.space, e.month, coalesce(arrived, 0) AS arrived, coalesce(orphaned, 0) AS orphaned, coalesce(resolved, 0) AS resolved, coalesce(reopened, 0) AS reopened
  FROM every e LEFT JOIN months m ON m.space = e.space AND m.month IS NOT DISTINCT FROM e.month)
SELECT space, strftime(month, '%Y-%m') AS period, arrived::BIGINT AS arrived, orphaned::BIGINT AS orphaned, resolved::BIGINT AS resolved, reopened::BIGINT AS reopened,
  (sum(orphaned + reopened - resolved) OVER (PARTITION BY space ORDER BY month NULLS FIRST))::BIGINT AS pending
FROM filled""",
    "p2_found": """
WITH chain AS (
  SELECT version_id, lag(version_id) OVER (PARTITION BY project_id ORDER BY "timestamp"::TIMESTAMPTZ, version_id) AS prev FROM snapshots),
feats AS (SELECT version_id, feature_id AS key1, '' AS key2, 'feature' AS record_kind, arg_max(struct_pack(a := label, b := description), loaded_at) AS v
  FROM feature_summaries GROUP BY version_id, feature_id),
rels AS (SELECT version_id, from_feature AS key1, to_feature AS key2, 'relation' AS record_kind, arg_max(struct_pack(a := relation, b := NULL::VARCHAR), loaded_at) AS v
  FROM relation_summaries GROUP BY version_id, from_feature, to_feature),
recs AS (SELECT * FROM feats UNION ALL SELECT * FROM rels),
cur AS (SELECT c.version_id AS pair, r.* EXCLUDE (version_id) FROM recs r JOIN chain c ON r.version_id = c.version_id WHERE c.prev IS NOT NULL),
old AS (SELECT c.version_id AS pair, r.* EXCLUDE (version_id) FROM recs r JOIN chain c ON r.version_id = c.prev)
SELECT coalesce(cur.pair, old.pair) AS version_id, coalesce(cur.record_kind, old.record_kind) AS record_kind,
  coalesce(cur.key1, old.key1) AS key1, coalesce(cur.key2, old.key2) AS key2,
  CASE WHEN old.v IS NULL THEN 'added' WHEN cur.v IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM cur FULL JOIN old ON cur.pair = old.pair AND cur.record_kind = old.record_kind AND cur.key1 = old.key1 AND cur.key2 = old.key2
WHERE cur.v IS NULL OR old.v IS NULL OR cur.v.a IS DISTINCT FROM old.v.a OR cur.v.b IS DISTINCT FROM old.v.b""",
    "p5_found": f"""
WITH RECURSIVE {_LATEST_BLOCKS}
SELECT t.version_id, t.block_id, coalesce(r.root_block_id, '') AS root_block_id, coalesce(r.depth, -1) AS depth
FROM tied t LEFT JOIN tree r ON t.version_id = r.version_id AND t.block_id = r.block_id""",
    # Paths sorted part by part are the order in which a walk by id enters nodes; who has a node in its path is below it.
    "p5_descendants": f"""
WITH RECURSIVE {_LATEST_BLOCKS.replace("block_id AS path", "[block_id] AS path").replace("r.path || '/' || t.block_id", "list_append(r.path, t.block_id)")},
below AS (SELECT version_id, block_id, count(*) - 1 AS n FROM (SELECT version_id, unnest(path) AS block_id FROM tree) GROUP BY ALL),
line AS (SELECT *, row_number() OVER (PARTITION BY version_id, root_block_id ORDER BY path) - 1 AS first FROM tree)
SELECT version_id, block_id, root_block_id, first, first + n AS last, n AS n_descendants FROM line JOIN below USING (version_id, block_id)""",
    # Nodes on or leading into cycles: the cycle's nodes are those that reach themselves; the way down begins at the least of them.
    "p5_paths": f"""
WITH RECURSIVE {_LATEST_BLOCKS},
below AS (SELECT version_id, block_id, count(*) - 1 AS n FROM (SELECT version_id, unnest(string_split(path, '/')) AS block_id FROM tree) GROUP BY ALL),
loose AS (SELECT t.* FROM tied t LEFT JOIN tree r USING (version_id, block_id) WHERE r.block_id IS NULL),
up AS (
  SELECT version_id, block_id, parent AS above FROM loose
  UNION
  SELECT u.version_id, u.block_id, l.parent FROM up u JOIN loose l ON l.version_id = u.version_id AND l.block_id = u.above),
ring AS (SELECT version_id, block_id FROM up WHERE block_id = above),
least AS (SELECT u.version_id, u.block_id, min(u.above) AS top FROM up u JOIN ring r ON r.version_id = u.version_id AND r.block_id = u.above GROUP BY ALL),
down AS (
  SELECT version_id, block_id, top, block_id AS path FROM least WHERE block_id = top
  UNION ALL
  SELECT l.version_id, l.block_id, d.top, d.path || '/' || l.block_id FROM down d JOIN loose l ON l.version_id = d.version_id AND l.parent = d.block_id WHERE l.block_id <> d.top)
SELECT version_id, block_id, root_block_id, depth, path, n AS n_descendants, false AS back_edge FROM tree JOIN below USING (version_id, block_id)
UNION ALL SELECT version_id, block_id, '', -1, path, NULL, block_id = top FROM down""",
}
