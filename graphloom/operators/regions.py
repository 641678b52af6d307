"""Regions of a graph, the flow between them, node views and symbol search. A region is the first part of a node's path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import region_of

#: From here on a region only consumes others.
LEAST_OUTBOUND, LEAST_RATIO = 50, 50
DEFAULT_LIMIT = 20


def members(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes with their region."""
    return nodes.select(*(keys or []), region_of(F.col("node_id")).alias("region"), "node_id")


def flow_matrix(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges from region to region, inner ones included; the ends need not be known nodes."""
    return edges.groupBy(*(keys or []), region_of(F.col("from_node")).alias("from_region"), region_of(F.col("to_node")).alias("to_region")).agg(
        F.count("*").alias("n_edges")
    )


def region_totals(nodes: DataFrame, matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """internal, outbound and inbound edges of every region that has nodes, and flow_to and flow_from as text."""
    keys = keys or []
    inner = F.col("from_region") == F.col("to_region")
    sides = F.inline(F.array(
        F.struct(F.col("from_region").alias("region"), F.col("to_region").alias("other"), F.lit("out").alias("side")),
        F.struct(F.col("to_region").alias("region"), F.col("from_region").alias("other"), F.lit("in").alias("side")),
    ))
    flows = matrix.select(*keys, "n_edges", inner.alias("inner"), sides).where((F.col("side") == "out") | ~F.col("inner"))

    def total(condition: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_edges"))), F.lit(0)).cast("bigint")

    def text(side: str) -> F.Column:
        own = F.when((F.col("side") == side) & ~F.col("inner"), F.concat_ws(":", "other", "n_edges"))
        return F.array_join(F.sort_array(F.collect_list(own)), ",")  # a part for each region, not for each edge

    sums = flows.groupBy(*keys, "region").agg(
        total(F.col("inner")).alias("internal"), total((F.col("side") == "out") & ~F.col("inner")).alias("outbound"), total(F.col("side") == "in").alias("inbound"),
        text("out").alias("flow_to"), text("in").alias("flow_from"),
    )
    regions = members(nodes, keys).select(*keys, "region").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("internal", "outbound", "inbound")}
    return regions.join(sums, [*keys, "region"], "left").withColumns(zero | {c: F.coalesce(c, F.lit("")) for c in ("flow_to", "flow_from")})


def one_way_consumers(totals: DataFrame) -> DataFrame:
    """Regions that use others far more than they are used, with the evidence."""
    ratio = F.col("outbound") / F.greatest("inbound", F.lit(1))
    return totals.withColumn("ratio", ratio).withColumn("one_way_consumer", (F.col("outbound") >= LEAST_OUTBOUND) & (ratio >= LEAST_RATIO))


def shares(placed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes of every region, the count of all and the region's share in percent (halves of a tenth go up), and the nodes of each of its batches."""
    keys = keys or []
    each = placed.groupBy(*keys, region_of(F.col("node_id")).alias("region"), "batch").agg(F.count("*").alias("n_nodes"))
    return each.select(
        *keys, "region", "batch", "n_nodes", F.sum("n_nodes").over(Window.partitionBy(*keys, "region")).alias("n_region"),
        F.sum("n_nodes").over(Window.partitionBy(*keys)).alias("n_all"),
    ).withColumn("share_percent", F.floor((F.col("n_region") * 2000 + F.col("n_all")) / (F.col("n_all") * 2)) / 10)


def graph_totals(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files, nodes, edges and regions of every graph."""
    keys = keys or []
    per_file = nodes.groupBy(*keys, "file", region_of(F.col("node_id")).alias("region")).agg(F.count("*").alias("n"))
    sums = per_file.groupBy(*keys).agg(F.countDistinct("file").alias("n_files"), F.sum("n").alias("n_nodes"), F.countDistinct("region").alias("n_regions"))
    counts = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    joined = sums.join(counts, keys, "left") if keys else sums.withColumn("n_edges", counts.scalar())
    return joined.withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("bigint")))


def node_views(counted: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every node with its distinct neighbours, written as texts in order."""
    keys = keys or []

    def side(a: str, b: str, name: str) -> DataFrame:
        ends = edges.select(*keys, F.col(a).alias("node_id"), F.concat_ws(":", "type", b).alias("end")).distinct()
        return ends.groupBy(*keys, "node_id").agg(F.array_join(F.sort_array(F.collect_list("end")), ",").alias(name))

    joined = counted.join(side("from_node", "to_node", "out_edges"), [*keys, "node_id"], "left").join(side("to_node", "from_node", "in_edges"), [*keys, "node_id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("out_edges", "in_edges")})


def search(counted: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """The nodes whose name, or else path, holds the query: name hits first, then by in_degree; with the count of all hits.

    A limit of null or below zero is DEFAULT_LIMIT, one of zero gives nothing.
    """
    limit = DEFAULT_LIMIT if limit is None or limit < 0 else limit
    q = query.lower()
    hits = counted.withColumn("in_name", F.contains(F.lower("name"), F.lit(q))).where(F.col("in_name") | F.contains(F.lower("node_id"), F.lit(q)))
    total = hits.agg(F.count("*").alias("n_hits"))
    best = hits.orderBy(F.col("in_name").desc(), F.col("in_degree").desc(), "node_id").limit(limit)
    return best.withColumn("n_hits", total.scalar())


def neighbours(nodes: DataFrame, edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Callers and callees of the given nodes with their file; a neighbour that is no node has none."""
    callees = edges.join(node_ids.withColumnRenamed("node_id", "from_node"), "from_node", "left_semi").select(F.col("from_node").alias("node_id"), F.lit("callee").alias("role"), F.col("to_node").alias("other"))
    callers = edges.join(node_ids.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi").select(F.col("to_node").alias("node_id"), F.lit("caller").alias("role"), F.col("from_node").alias("other"))
    both = callees.union(callers).distinct()
    return both.join(nodes.select(F.col("node_id").alias("other"), "file"), "other", "left")


def freshness(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """fresh, changed or missing for each file of a manifest (path, mtime, size) against a listing."""
    now = listing.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"))
    same = (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s"))
    return manifest.join(now, "path", "left").select("path", F.when(F.col("s").isNull(), "missing").when(same, "fresh").otherwise("changed").alias("state"))
