"""Rows as readers see them: graph views, orders by risk, counts with empty buckets, cards, and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import edit_magnitude, label_escaped

#: Orders of risk flags and of kinds of change.
FLAG_ORDER = {"out_of_scope": 0, "vulnerability": 1, "semantic_drift": 2}
CHANGE_ORDER = {"added": 3, "attribute_changed": 4, "dependency_changed": 5, "removed": 6}
SYMBOLS = {"added": "+", "removed": "-", "attribute_changed": "~", "dependency_changed": "^"}


def _first_of(flags: Column, default: int = 3) -> Column:
    out = None
    for f, n in FLAG_ORDER.items():
        hit = F.coalesce(F.array_contains(flags, f), F.lit(False))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(default)


def _lookup(table: dict[str, int], key: Column, default: int) -> Column:
    out = None
    for k, n in table.items():
        out = F.when(key == k, n) if out is None else out.when(key == k, n)
    return out.otherwise(default)


def risk_order(flags: Column, change: Column) -> list[Column]:
    """Sort keys: the first risk flag, then the kind of change."""
    return [_first_of(flags), _lookup(CHANGE_ORDER, change, 7)]


def report_order(flags: Column, change: Column, item: Column) -> list[Column]:
    """Sort keys of reports: each flag on its own, then the kind of change, then the id."""
    each = [F.when(F.coalesce(F.array_contains(flags, f), F.lit(False)), 0).otherwise(1) for f in FLAG_ORDER]
    return [*each, _lookup(CHANGE_ORDER, change, 9), F.coalesce(item, F.lit(""))]


def magnitude(before: str, now: str) -> Column:
    """How much label and description changed, in characters."""
    return edit_magnitude(F.col(f"{now}.label"), F.col(f"{before}.label")) + edit_magnitude(F.col(f"{now}.description"), F.col(f"{before}.description"))


def graph_view(nodes: DataFrame, edges: DataFrame, keys: list[str], ends: tuple[str, str] = ("from_feature", "to_feature"), item: str = "feature_id") -> DataFrame:
    """Edges with whether both ends are nodes: valid ones are drawn, the others are warnings."""
    ids = nodes.select(*keys, item).distinct()
    a, b = ids.withColumnRenamed(item, ends[0]).withColumn("a", F.lit(True)), ids.withColumnRenamed(item, ends[1]).withColumn("b", F.lit(True))
    met = edges.join(a, [*keys, ends[0]], "left").join(b, [*keys, ends[1]], "left")
    return met.select(*edges.columns, (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("valid"))


def induced(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges among a set of nodes."""
    ids = nodes.select(*keys, "node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "from_node"), [*keys, "from_node"], "left_semi").join(ids.withColumnRenamed("node_id", "to_node"), [*keys, "to_node"], "left_semi")


def with_zero_buckets(counts: DataFrame, column: str, values: list[str], n: str = "n") -> DataFrame:
    """Counts of all values, of those that don't occur too."""
    full = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return full.join(counts, column, "left").select(column, F.coalesce(n, F.lit(0)).cast("bigint").alias(n))


def block_tree(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """Every member of every block with its label; a feature that is missing shows its id."""
    listed = blocks.select("version_id", "block_id", "parent_block_id", F.explode("related_features").alias("feature_id"))
    return listed.join(features.select("version_id", "feature_id", "label"), ["version_id", "feature_id"], "left").withColumn("label", F.coalesce("label", "feature_id"))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("version_id").agg(
        F.count("*").alias("n_blocks"), F.count(F.when(F.col("confidence") == "high", 1)).alias("n_high"), F.count(F.when(F.col("confidence") == "medium", 1)).alias("n_medium"),
        F.count(F.when(F.coalesce(F.size("related_features"), F.lit(0)) > 0, 1)).alias("n_backed"),
    )


def card_filter(confidence: str | None = None, change: str | None = None) -> Column:
    """Which cards are shown: by confidence (or not-high) and by change (or modified, or none)."""
    c = F.lit(True)
    if confidence == "not-high":
        c = c & ~(F.coalesce("confidence", F.lit("")) == "high")
    elif confidence:
        c = c & (F.col("confidence") == confidence)
    if change == "modified":
        c = c & F.col("diff_state").isin("attribute_changed", "dependency_changed")
    elif change == "none":
        c = c & (F.coalesce("diff_state", F.lit("unchanged")) == "unchanged")
    elif change:
        c = c & (F.col("diff_state") == change)
    return c


def risk_filter() -> Column:
    """Which cards are at risk: with an anomaly, or of low confidence."""
    return (F.coalesce("anomaly_count", F.lit(0)) > 0) | F.coalesce(F.col("confidence") == "low", F.lit(False))


def card_order(kind: str) -> list[Column]:
    """Sort keys of cards: risk, alpha, sources or type; ids decide."""
    orders = {
        "risk": [F.coalesce("anomaly_count", F.lit(0)).desc(), (F.col("confidence") == "low").desc()], "alpha": [F.lower("label").asc()],
        "sources": [F.col("source_node_count").desc()], "type": [_lookup(CHANGE_ORDER, F.col("diff_state"), 7).asc()],
    }
    return [*orders[kind], F.col("feature_id").asc()]


def mermaid(features: DataFrame, relations: DataFrame) -> DataFrame:
    """Each version as the text of a Mermaid graph."""
    node = F.concat(F.lit("  "), "feature_id", F.lit('["'), label_escaped(F.coalesce("label", F.lit(""))), F.lit('"]'))
    edge = F.concat(F.lit("  "), "from_feature", F.when(F.col("relation_type") == "inferred", " -.-> ").otherwise(" --> "), "to_feature")
    lines = features.select("version_id", F.lit(0).alias("part"), node.alias("line")).union(relations.select("version_id", F.lit(1).alias("part"), edge.alias("line")))
    body = F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])  # a version's features and relations
    return lines.groupBy("version_id").agg(F.concat(F.lit("graph TD\n"), F.array_join(body, "\n")).alias("text"))


def mermaid_diff(diff: DataFrame) -> DataFrame:
    """Each version's changes as the text of a Mermaid graph."""
    mark = F.try_element_at(F.create_map(*[F.lit(x) for p in SYMBOLS.items() for x in p]), F.col("diff_state"))
    line = F.concat(F.lit("  "), "feature_id", F.lit('["'), mark, F.lit(" "), label_escaped(F.coalesce("now.label", "before.label", F.lit(""))), F.lit('"]:::'), "diff_state")
    return diff.where(mark.isNotNull()).groupBy("version_id").agg(F.concat(F.lit("graph TD\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text"))


def summary_line(features: DataFrame) -> DataFrame:
    """Of every version: features, those of low confidence and those unassessed, as text."""
    low, none = F.count(F.when(F.col("confidence") == "low", 1)), F.count(F.when(F.col("confidence").isNull(), 1))
    return features.groupBy("version_id").agg(F.concat_ws(", ", F.concat(F.count("*").cast("string"), F.lit(" features")), F.concat(low.cast("string"), F.lit(" low")), F.concat(none.cast("string"), F.lit(" unassessed"))).alias("line"))


def preferred_reference(tags: Column, label: Column, version: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(1)), F.nullif(label, F.lit("")), version)
