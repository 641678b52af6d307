"""Degrees, entry points, reading batches and ranks of a directed multigraph.

Nodes are (keys..., node_id, ...), edges (keys..., from_node, to_node, ...); keys (say project_id) let one call cover many
graphs. Ties are broken by node_ord and then node_id, so every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import has_entry_decorator, in_entry_folder, is_cli_entry
from graphloom.operators.skew import ranked
from graphloom.session import checkpoint

MOST_BATCHES = 5


def known_edges(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The edges whose ends are both nodes; parallel edges stay."""
    keys = keys or []
    ids = nodes.select(*keys, "node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "from_node"), [*keys, "from_node"], "left_semi").join(
        ids.withColumnRenamed("node_id", "to_node"), [*keys, "to_node"], "left_semi"
    )


def degrees(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """in_degree and out_degree of every node, isolated ones included.

    Both ends of an edge are counted in one aggregation, whose map side leaves a row a node and task.
    """
    keys = keys or []
    ends = F.inline(F.array(
        F.struct(F.col("from_node").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_node").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    ))
    counts = edges.select(*keys, ends).groupBy(*keys, "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    return nodes.join(counts, [*keys, "node_id"], "left").withColumns(
        {"in_degree": F.coalesce("in_degree", zero), "out_degree": F.coalesce("out_degree", zero)}
    )


def entry_points(counted: DataFrame) -> DataFrame:
    """is_entry_point of nodes with degrees, name, file and decorators."""
    folder = (F.col("in_degree") == 0) & (F.col("out_degree") > 0) & in_entry_folder(F.col("file"))
    return counted.withColumn("is_entry_point", has_entry_decorator(F.col("decorators")) | folder | is_cli_entry(F.col("name"), F.col("file"), F.col("out_degree")))


def batches(found: DataFrame, keys: list[str] | None = None, most: int = MOST_BATCHES) -> DataFrame:
    """batch: entry points in 1, the others by falling in_degree in runs of a quarter (rounded up) in 2 to `most`."""
    keys = keys or []
    sizes = found.where(~F.col("is_entry_point")).groupBy(*keys).agg(F.count("*").alias("n_rest")) if keys else found.where(~F.col("is_entry_point")).agg(F.count("*").alias("n_rest"))
    order = [F.col("in_degree").desc(), F.col("node_ord").asc(), F.col("node_id").asc()]
    rest = ranked(found.where(~F.col("is_entry_point")), keys, order, "place")
    rest = rest.join(sizes, keys) if keys else rest.withColumn("n_rest", sizes.scalar())
    size = F.greatest(F.ceil(F.col("n_rest") / (most - 1)), F.lit(1))
    batch = F.least(F.floor((F.col("place") - 1) / size) + 2, F.lit(most))
    return found.where("is_entry_point").withColumn("batch", F.lit(1).cast("bigint")).unionByName(
        rest.withColumn("batch", batch.cast("bigint")).drop("place", "n_rest")
    )


def topology_ranks(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """topology_rank: entry points by falling out_degree, then the others by falling in_degree."""
    weight = F.when(F.col("is_entry_point"), F.col("out_degree")).otherwise(F.col("in_degree"))
    order = [F.col("is_entry_point").desc(), weight.desc(), F.col("node_ord").asc(), F.col("node_id").asc()]
    return ranked(found, keys or [], order, "topology_rank")


def topology(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All of the above for every node."""
    keys = keys or []
    found = checkpoint(entry_points(degrees(nodes, known_edges(nodes, edges, keys), keys)))  # both orders read it twice
    return topology_ranks(batches(found, keys), keys)
