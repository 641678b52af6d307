"""What an edge list keeps when it is shown, and what is only counted: calls that can't be resolved and ambiguous ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import method_of
from graphloom.session import checkpoint


def split_edges(edges: DataFrame) -> DataFrame:
    """Edges with their part: kept, indeterminate or ambiguous."""
    part = F.when(F.col("resolution") == "skipped_dynamic", "indeterminate").when(F.col("resolution") == "name_match_ambiguous", "ambiguous").otherwise("kept")
    return edges.withColumn("part", part)


def residue(edges: DataFrame, part: str) -> DataFrame:
    """Of each caller the methods called in a part: from_node, method, n, the caller's cardinality, and of how many edges in all.

    A row a method, so no caller's methods are gathered; edges are counted once, and their total is that of the counts.
    """
    methods = checkpoint(split_edges(edges).groupBy("from_node", method_of(F.col("to_node")).alias("method")).agg(
        F.count(F.when(F.col("part") == part, 1)).alias("n"), F.count("*").alias("n_any")
    ))
    total = methods.agg(F.sum("n_any").alias("n_all"))
    of_caller = F.sum("n").over(Window.partitionBy("from_node"))
    return methods.where("n > 0").select("from_node", "method", "n", of_caller.alias("cardinality"), total.scalar().alias("n_all"))


def residue_counters(edges: DataFrame) -> DataFrame:
    """Edges in all and kept, and callers with indeterminate and with ambiguous calls."""
    each = split_edges(edges).groupBy("from_node").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("part") == p, 1)).alias(p) for p in ("kept", "indeterminate", "ambiguous")]
    )
    return each.agg(
        F.sum("n").alias("n_edges"), F.sum("kept").alias("n_kept"), F.count(F.when(F.col("indeterminate") > 0, 1)).alias("indeterminate_callers"),
        F.count(F.when(F.col("ambiguous") > 0, 1)).alias("ambiguous_callers"),
    )


def resolution_shares(edges: DataFrame) -> DataFrame:
    """Edges by resolution, and of how many."""
    each = edges.groupBy("resolution").agg(F.count("*").alias("n_edges"))
    return each.withColumn("n_all", F.sum("n_edges").over(Window.partitionBy()))  # a row for each resolution


def fanout(definitions: DataFrame) -> DataFrame:
    """How many names have how many definitions."""
    return definitions.groupBy("name").agg(F.count("*").alias("fanout")).groupBy("fanout").agg(F.count("*").alias("n_names"))


def quartiles(histogram: DataFrame) -> DataFrame:
    """The values at the places m/4, m/2, 3m/4 and 9m/10 (counted from 0, not interpolated) of a histogram (fanout, n_names)."""
    line = Window.orderBy("fanout")  # a row for each distinct count
    upto = histogram.withColumn("upto", F.sum("n_names").over(line)).withColumn("m", F.sum("n_names").over(Window.partitionBy()))

    def at(numerator: int, denominator: int) -> F.Column:
        place = F.floor(F.col("m") * numerator / denominator)
        return F.min(F.when(F.col("upto") > place, F.col("fanout")))

    return upto.agg(at(1, 4).alias("p25"), at(1, 2).alias("p50"), at(3, 4).alias("p75"), at(9, 10).alias("p90"))
