"""Checks of analysis outputs against the graph and each other. A check gives the rows that fail it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import persistence_reason, schema_file_reason
from graphloom.functions.text import term_hits, word_count
from graphloom.operators.graph import linked
from graphloom.session import checkpoint

#: Closed vocabularies.
VOCABULARIES = {
    "node_type": ["function", "class", "method"],
    "edge_type": ["calls", "imports", "extends", "implements"],
    "resolution": ["scope_rule", "import_alias", "name_match", "name_match_ambiguous", "skipped_dynamic"],
    "confidence": ["high", "medium", "low"],
    "node_state": ["added", "removed", "attribute_changed", "dependency_changed", "unchanged"],
    "edge_state": ["added", "removed", "modified"],
    "scope_state": ["in_scope_complete", "in_scope_incomplete", "out_of_scope"],
    "doubt_state": ["discovered", "investigating", "escalated", "explained", "fixed", "accepted_risk"],
    "doubt_type": ["out_of_scope", "in_scope_incomplete", "anomaly", "low_confidence"],
    "provenance": ["current", "legacy", "unknown"],
    "risk_flag": ["out_of_scope", "vulnerability", "semantic_drift"],
    "severity": ["critical", "high", "medium", "low"],
    "gap_kind": ["corrupt", "indeterminate", "evolutionary", "reserved"],
    "verdict": ["backed", "gap", "undetermined", "conceptual", "not_assessed"],
    "trigger": ["commit", "manual"],
    "feature_trigger": ["user_action", "scheduled", "auto_triggered"],
    "relation_type": ["static", "inferred"],
    "category": ["operational", "test", "fixture", "script", "prototype"],
}
#: A label under this many words is no description of what a term does.
LEAST_WORDS = 4


def vocabulary_misses(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """Values outside a closed vocabulary, with their counts; null is no value."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(VOCABULARIES[vocabulary])).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def schema_errors(df: DataFrame, key: list[str], required: list[str], enums: dict[str, str]) -> DataFrame:
    """key..., path, error: required fields that are null, and values outside their vocabulary."""
    found = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("path"), F.lit("required").alias("error"))) for c in required]
    found += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(VOCABULARIES[v]), F.struct(F.lit(c).alias("path"), F.lit("enum").alias("error"))) for c, v in enums.items()]
    return df.select(*key, F.inline(F.array_compact(F.array(*found))))


def output_schema_errors(outputs: DataFrame, features: DataFrame, relations: DataFrame, key: list[str]) -> DataFrame:
    """schema_errors of whole outputs (key..., l1) with their features and relations; an empty text or list that must hold something counts as null.

    A null confidence or review_reason is allowed, a null in place of a list is not.
    """
    lists = ["features", "feature_relations", "unclassified_nodes", "infrastructure_nodes"]
    roots = outputs.select(*key, F.nullif(F.col("l1.summary"), F.lit("")).alias("summary"), *[F.col(f"l1.{c}").alias(c) for c in lists])
    anchored = features.withColumn("source_nodes", F.when(F.size("source_nodes") > 0, F.col("source_nodes")))
    texts = ["feature_id", "label", "description", "trigger", "trigger_description", "confidence_reason", "source_nodes", "needs_source_review"]
    reason = F.when(F.col("relation_type") == "inferred", F.nullif(F.col("inferred_reason"), F.lit(""))).otherwise("")
    ends = ["from_feature", "to_feature", "relation", "relation_type", "inferred_reason"]
    found = [
        schema_errors(roots, key, ["summary", *lists], {}),
        schema_errors(anchored, key, texts, {"trigger": "feature_trigger", "confidence": "confidence"}),
        schema_errors(relations.withColumn("inferred_reason", reason), key, ends, {"relation_type": "relation_type"}),
    ]
    return reduce(DataFrame.union, found)


def uncovered(nodes: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that no feature and no list of exceptions holds."""
    return nodes.select(*keys, "node_id").distinct().join(covered.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_anti")


def incomplete(outputs: DataFrame, nodes: DataFrame, covered: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """key... of the outputs (key..., scope...) that `uncovered` has a node of, by counting: outputs never meet all nodes of their scope."""
    there = nodes.select(*scope, "node_id").where(F.col("node_id").isNotNull()).distinct()
    held = covered.select(*key, "node_id").repartition(*key).distinct().join(outputs.select(*key, *scope).distinct(), key).join(there, [*scope, "node_id"], "left_semi")
    counts = held.groupBy(*key, *scope).agg(F.count("*").alias("n_held"))
    nameless = nodes.where(F.col("node_id").isNull()).select(*scope, F.lit(1).alias("n_nodes"))  # no output covers them
    sizes = there.select(*scope, F.lit(1).alias("n_nodes")).union(nameless).groupBy(*scope).agg(F.sum("n_nodes").alias("n_nodes"))
    met = outputs.select(*key, *scope).distinct().join(sizes, scope).join(counts, [*key, *scope], "left")
    return met.where(F.coalesce("n_held", F.lit(0)) < F.col("n_nodes")).select(*key)


def anchor_errors(features: DataFrame, nodes: DataFrame, key: list[str], scope: str = "project_id") -> DataFrame:
    """Features (key..., scope, feature_id, source_nodes) without nodes (node_id null), and their nodes that don't exist."""
    empty = features.where(F.coalesce(F.size("source_nodes"), F.lit(0)) == 0).select(*key, "feature_id", F.lit(None).cast("string").alias("node_id"))
    listed = features.select(*key, scope, "feature_id", F.explode("source_nodes").alias("node_id")).where(F.col("node_id").isNotNull())
    missing = listed.join(nodes.select(scope, "node_id").distinct(), [scope, "node_id"], "left_anti").select(*key, "feature_id", "node_id")
    return empty.union(missing).distinct()


def language_errors(features: DataFrame, key: list[str], terms: list[str] | None = None, fields: tuple[str, ...] = ("label", "description")) -> DataFrame:
    """key..., field, term, n: prohibited terms by field."""

    def named(field: str) -> Column:
        return F.transform(term_hits(F.col(field), terms), lambda t: F.struct(F.lit(field).alias("field"), F.lower(t).alias("term")))

    each = [named(f) for f in fields]
    return features.select(*key, F.inline(F.concat(*each))).groupBy(*key, "field", "term").agg(F.count("*").alias("n"))


def bare_terms(blocks: DataFrame, key: list[str], terms: list[str] | None = None) -> DataFrame:
    """Blocks whose label has a term and fewer than LEAST_WORDS words."""
    hits = term_hits(F.col("label"), terms)
    return blocks.where((F.size(hits) > 0) & (word_count(F.col("label")) < LEAST_WORDS)).select(*key, F.size(hits).cast("bigint").alias("n"), word_count(F.col("label")).alias("n_words"))


def relation_errors(relations: DataFrame, features: DataFrame, joined: DataFrame | None, keys: list[str]) -> DataFrame:
    """The first thing wrong with each relation: unknown_from, unknown_to, no_path (static), no_reason (inferred).

    joined (keys..., from_feature, to_feature) are features whose nodes a path joins; without it paths are not checked.
    """
    ids = features.select(*keys, "feature_id").distinct()
    met = relations.join(ids.select(*keys, F.col("feature_id").alias("from_feature"), F.lit(True).alias("a")), [*keys, "from_feature"], "left").join(
        ids.select(*keys, F.col("feature_id").alias("to_feature"), F.lit(True).alias("b")), [*keys, "to_feature"], "left"
    )
    met = met.join(joined.withColumn("p", F.lit(True)), [*keys, "from_feature", "to_feature"], "left") if joined is not None else met.withColumn("p", F.lit(True))
    static, inferred = F.col("relation_type") == "static", F.col("relation_type") == "inferred"
    no_reason = F.col("inferred_reason").isNull() | (F.col("inferred_reason") == "")
    error = F.when(F.col("a").isNull(), "unknown_from").when(F.col("b").isNull(), "unknown_to").when(static & F.col("p").isNull(), "no_path").when(inferred & no_reason, "no_reason")
    return met.withColumn("error", error).where(F.col("error").isNotNull()).select(*keys, "from_feature", "to_feature", "error")


def passed(checks: dict[str, DataFrame], all_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key whether each check found nothing, and whether all did."""
    found = reduce(DataFrame.union, [df.select(*keys, F.lit(name).alias("check")) for name, df in checks.items()])
    counts = found.groupBy(*keys).agg(*[F.count(F.when(F.col("check") == name, 1)).alias(name) for name in checks])
    full = all_keys.select(*keys).distinct().join(counts, keys, "left")
    named = [(F.coalesce(name, F.lit(0)) == 0).alias(f"{name}_passed") for name in checks]
    every = reduce(lambda a, b: a & b, [F.coalesce(name, F.lit(0)) == 0 for name in checks])
    return full.select(*keys, *named, every.alias("passed"))


def output_checks(outputs: DataFrame, live: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """passed() of the five checks of outputs (output_id, project_id, l1), all of them run; live are the nodes that must be covered."""
    key, scope = ["output_id"], ["project_id"]
    outputs = checkpoint(outputs)
    features = outputs.select(*key, *scope, F.inline("l1.features"))
    relations = outputs.select(*key, F.inline("l1.feature_relations")).withColumnsRenamed({"from": "from_feature", "to": "to_feature"})
    owned = features.select(*key, *scope, "feature_id", F.explode("source_nodes").alias("node_id"))
    excepted = F.flatten(F.array_compact(F.array("l1.unclassified_nodes", "l1.infrastructure_nodes")))
    covered = owned.select(*key, "node_id").union(outputs.select(*key, F.explode(excepted).alias("node_id")))
    checks = {
        "schema": output_schema_errors(outputs, features, relations, key),
        "coverage": incomplete(outputs, live, covered, key, scope),
        "language": language_errors(features, [*key, "feature_id"]),
        "anchor": anchor_errors(features, nodes, key),
        "relation": relation_errors(relations, features, linked(relations.where("relation_type = 'static'"), owned, edges, key, scope), key),
    }
    return passed(checks, outputs, key)


def dangling(references: DataFrame, known: DataFrame, keys: list[str], column: str) -> DataFrame:
    """References (keys..., column) to what is not known."""
    return references.where(F.col(column).isNotNull()).join(known.select(*keys, column).distinct(), [*keys, column], "left_anti").distinct()


#: What can be wrong with a tree of blocks, the first first.
BLOCK_RULES = ["dangling_parent", "too_deep", "parent_has_features", "unknown_feature", "duplicate_membership", "unclassified"]


def block_violations(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """version_id, rule, n: how often each rule about blocks is broken; blocks lie in two levels and share out all features."""
    own = blocks.select("version_id", "block_id", "parent_block_id", F.coalesce("related_features", F.array()).alias("related"))
    parents = own.select("version_id", F.col("block_id").alias("parent_block_id"), F.col("parent_block_id").alias("grand"), F.lit(True).alias("there"))
    met = own.where(F.col("parent_block_id").isNotNull()).join(parents, ["version_id", "parent_block_id"], "left")
    counts = [
        met.where(F.col("there").isNull()).select("version_id", F.lit("dangling_parent").alias("rule")),
        met.where(F.col("grand").isNotNull()).select("version_id", F.lit("too_deep").alias("rule")),
    ]
    heads = met.where("there").select("version_id", F.col("parent_block_id").alias("block_id")).distinct()
    counts.append(own.where(F.size("related") > 0).join(heads, ["version_id", "block_id"], "left_semi").select("version_id", F.lit("parent_has_features").alias("rule")))
    listed = own.select("version_id", "block_id", F.explode("related").alias("feature_id"))
    ids = features.select("version_id", "feature_id")
    counts.append(listed.join(ids, ["version_id", "feature_id"], "left_anti").select("version_id", F.lit("unknown_feature").alias("rule")))
    counts.append(listed.groupBy("version_id", "feature_id").count().where("count > 1").select("version_id", F.lit("duplicate_membership").alias("rule")))
    counts.append(ids.join(listed, ["version_id", "feature_id"], "left_anti").select("version_id", F.lit("unclassified").alias("rule")))
    return reduce(DataFrame.union, counts).groupBy("version_id", "rule").agg(F.count("*").alias("n"))


def first_violation(violations: DataFrame) -> DataFrame:
    """The first broken rule of each version."""
    place = F.array_position(F.array(*map(F.lit, BLOCK_RULES)), F.col("rule"))
    return violations.groupBy("version_id").agg(F.min_by("rule", place).alias("rule"))


def contract(declared: DataFrame, touched: DataFrame) -> DataFrame:
    """Of every (entity, field): write_gap (declared, never written), coverage_gap (written, not declared) or match."""
    a = declared.select("entity", "field", F.lit(1).alias("d"), F.lit(0).alias("t"))
    b = touched.select("entity", "field", F.lit(0).alias("d"), F.lit(1).alias("t"))
    both = a.union(b).groupBy("entity", "field").agg(F.max("d").alias("d"), F.max("t").alias("t"))
    status = F.when(F.col("t") == 0, "write_gap").when(F.col("d") == 0, "coverage_gap").otherwise("match")
    return both.select("entity", "field", status.alias("status"))


def data_model_sites(nodes: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Code that looks as if it stored data, and files that look like schemas, with the reason."""
    code = nodes.select(*key, F.lit("code").alias("kind"), F.col("node_id").alias("site"), persistence_reason(F.col("name"), F.col("file")).alias("reason"))
    schemas = files.select(*key, F.lit("schema").alias("kind"), F.col("path").alias("site"), schema_file_reason(F.col("path")).alias("reason"))
    return code.union(schemas).where(F.col("reason").isNotNull()).distinct()


def all_of(column: Column) -> Column:
    return F.coalesce(F.bool_and(column), F.lit(True))
