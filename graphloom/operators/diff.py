"""Differences between versions: features, relations, blocks, findings and code structure, and what they touch.

A pairing (version_id, previous_id) says which versions are compared; all pairs are compared at once. Both sides are sent
by key with a side mark and met in one aggregation, so no pair needs a join of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sides(rows: DataFrame, pairs: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Of each pair and key the contents before and now, as structs; null where the key is not."""
    both = pairs.select(
        F.col("version_id").alias("pair"),
        F.inline(F.array(F.struct(F.col("version_id").alias("v"), F.lit(1).alias("side")), F.struct(F.col("previous_id").alias("v"), F.lit(0).alias("side")))),
    )
    placed = rows.select(F.col("version_id").alias("v"), *keys, *content).join(both, "v")
    now, before = [F.max(F.when(F.col("side") == s, F.struct(*content))) for s in (1, 0)]
    return placed.groupBy("pair", *keys).agg(now.alias("now"), before.alias("before")).withColumnRenamed("pair", "version_id")


def _state(changed: Column) -> Column:
    return F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(changed, "attribute_changed").otherwise("unchanged")


def node_diff(features: DataFrame, pairs: DataFrame, key: str = "feature_id", content: tuple[str, str] = ("label", "description")) -> DataFrame:
    """Every feature of either version with its state: added, removed, attribute_changed or unchanged.

    Serves blocks as well, by block_id, label and responsibility.
    """
    met = sides(features, pairs, [key], list(content))
    return met.select("version_id", key, _state(~F.col("before").eqNullSafe(F.col("now"))).alias("diff_state"), "before", "now")


def edge_diff(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relations added, removed or modified (in their text); unchanged ones are left out."""
    met = sides(relations, pairs, ["from_feature", "to_feature"], ["relation"])
    state = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("now")), "modified")
    return met.select("version_id", "from_feature", "to_feature", state.alias("diff_state")).where(F.col("diff_state").isNotNull())


def touched(edges: DataFrame) -> DataFrame:
    """The features at the ends of changed relations."""
    return edges.select("version_id", F.explode(F.array("from_feature", "to_feature")).alias("feature_id")).distinct()


def with_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node states, where unchanged and attribute_changed ones at changed relations become dependency_changed."""
    marked = nodes.join(touched(edges).withColumn("hit", F.lit(True)), ["version_id", "feature_id"], "left")
    raised = F.col("hit") & F.col("diff_state").isin("unchanged", "attribute_changed")
    return marked.select(
        "version_id", "feature_id", F.when(raised, "dependency_changed").otherwise(F.col("diff_state")).alias("diff_state"),
        F.when(raised & (F.col("diff_state") == "attribute_changed"), F.struct("before", "now")).alias("secondary_changes"), "before", "now",
    )


def diff_summary(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of each pair by state; the total leaves out what is unchanged. Pairs without any features count zero."""
    states = ("added", "removed", "attribute_changed", "dependency_changed")
    counts = nodes.groupBy("version_id").agg(*[F.count(F.when(F.col("diff_state") == s, 1)).alias(f"n_{s}") for s in states])
    zero = F.lit(0).cast("bigint")
    full = pairs.select("version_id").join(counts, "version_id", "left").withColumns({f"n_{s}": F.coalesce(f"n_{s}", zero) for s in states})
    return full.withColumn("n_total", reduce(lambda a, b: a + b, [F.col(f"n_{s}") for s in states]))


def uncomparable(versions: DataFrame, features: DataFrame) -> DataFrame:
    """Versions that analysed files but hold no features: they can't be compared."""
    looked = versions.where(F.coalesce(F.size("analyzed_files"), F.lit(0)) > 0)
    return looked.join(features.select("version_id"), "version_id", "left_anti").select("version_id")


def finding_diff(before: DataFrame, now: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Findings by (cve_id, package, version): new, resolved or unchanged, with what is carried of the present row.

    Of several rows of a key the first in order counts; a resolved finding carries its former row.
    """
    key = ["cve_id", "package", "version"]
    rows = [x.select(*key, F.lit(s).alias("s"), F.struct(F.lit(1 - s).alias("past"), *order).alias("o"), F.struct(*carried).alias("c")) for s, x in ((0, before), (1, now))]
    both = rows[0].union(rows[1]).groupBy(*key).agg(F.min("s").alias("a"), F.max("s").alias("b"), F.min_by("c", "o").alias("c"))
    return both.select(*key, F.when(F.col("a") == 1, "new").when(F.col("b") == 0, "resolved").otherwise("unchanged").alias("diff_state"), "c.*")


SIGNATURE = ["name", "parameters", "return_type", "decorators", "docstring"]


def structure_delta(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes added, removed or modified: by signature, or by body hash where both are known."""
    one, two = [x.select(*keys, F.struct(*SIGNATURE).alias(f"s{i}"), F.col("body_hash").alias(f"h{i}"), F.lit(True).alias(f"t{i}")) for i, x in ((0, before), (1, now))]
    met = one.join(two, keys, "full")
    bodies = F.col("h0").isNotNull() & F.col("h1").isNotNull() & (F.col("h0") != F.col("h1"))
    state = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").when(~F.col("s0").eqNullSafe(F.col("s1")) | bodies, "modified")
    return met.select(*keys, state.alias("change")).where(F.col("change").isNotNull())


def affected_features(owned: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Of every feature (owned: keys..., feature_id, node_id) the changed nodes by kind; inherited if it has none."""
    hits = owned.join(delta, [*keys, "node_id"], "left")
    group = [k for k in keys if k in owned.columns] + [c for c in owned.columns if c not in (*keys, "node_id")]
    counts = hits.groupBy(*group).agg(*[F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}") for c in ("added", "removed", "modified")])
    none = (F.col("n_added") + F.col("n_removed") + F.col("n_modified")) == 0
    return counts.withColumn("status", F.when(none, "inherited").otherwise("affected"))


def incremental(before: DataFrame, now: DataFrame, owned: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """One delta and what follows from it: features affected, features that inherit, changes that no feature owns."""
    delta = structure_delta(before, now, [*keys, "node_id"])
    status = affected_features(owned, delta, keys)
    return {
        "delta": delta, "affected": status.where("status = 'affected'"), "inherited": status.where("status = 'inherited'"), "unmapped": unmapped_changes(owned, delta, keys),
    }


def unmapped_changes(owned: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Changed nodes that no feature owns."""
    return delta.join(owned.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_anti")


def resolve_references(versions: DataFrame, references: DataFrame) -> DataFrame:
    """The version each reference (project_id, ref) means.

    A date means the last version up to its end and never anything else; else a tag or a hash prefix of seven or more
    comes before a label and that before an id; of several the latest.
    """
    date = F.regexp_like("ref", F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    met = references.join(versions, "project_id")
    hash_hit = (F.char_length("ref") >= 7) & F.startswith("commit_hash", F.col("ref"))
    until = F.expr("try_cast(ref as date)").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")
    tier = F.when(date, F.when(F.col("made_at") < until, 0)).when(
        F.coalesce(F.array_contains("git_tags", F.col("ref")), F.lit(False)) | F.coalesce(hash_hit, F.lit(False)), 1
    ).when(F.col("label") == F.col("ref"), 2).when(F.col("version_id") == F.col("ref"), 3)
    best = met.withColumn("tier", tier).where(F.col("tier").isNotNull()).groupBy("project_id", "ref").agg(
        F.max_by("version_id", F.struct(-F.col("tier"), F.col("made_at"), F.col("version_id"))).alias("version_id")
    )
    return references.join(best, ["project_id", "ref"], "left")


def as_of(versions: DataFrame, days: DataFrame) -> DataFrame:
    """Of every project and day (project_id, day) the last version up to the day's end.

    An as-of join without a range join: versions and days are one sequence of a project in time, and each day takes the
    last version before it.
    """
    seen = versions.where(F.col("made_at").isNotNull()).select("project_id", "made_at", F.lit(None).cast("date").alias("day"), "version_id")
    asked = days.select("project_id", (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")).alias("made_at"), "day", F.lit(None).cast("string").alias("version_id"))
    line = Window.partitionBy("project_id").orderBy("made_at", F.col("day").isNull().cast("int"), "version_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("version_id", ignorenulls=True).over(line)
    return seen.union(asked).withColumn("last", last).where(F.col("day").isNotNull()).select("project_id", "day", F.col("last").alias("version_id"))


def inherit(baseline: DataFrame, given: DataFrame, choice: str | None = None) -> DataFrame:
    """The features (feature_id, ...) of a version that inherits: the given ones over the baseline's.

    With choice A only given ids that are new are added, nothing is overwritten; with B the baseline's are kept whose ids
    are given too; with None given rows replace the baseline's.
    """
    if choice == "A":
        return baseline.unionByName(given.join(baseline.select("feature_id"), "feature_id", "left_anti"))
    if choice == "B":
        return baseline.join(given.select("feature_id"), "feature_id", "left_semi")
    return given.unionByName(baseline.join(given.select("feature_id"), "feature_id", "left_anti"))


def carried_relations(relations: DataFrame, features: DataFrame) -> DataFrame:
    """The relations whose ends are features of their version."""
    ids = features.select("version_id", "feature_id").distinct()
    return relations.join(ids.withColumnRenamed("feature_id", "from_feature"), ["version_id", "from_feature"], "left_semi").join(
        ids.withColumnRenamed("feature_id", "to_feature"), ["version_id", "to_feature"], "left_semi"
    )


def write_problems(features: DataFrame, relations: DataFrame) -> DataFrame:
    """What speaks against writing a version: version_id, problem, item."""
    twice = features.groupBy("version_id", "feature_id").count().where("count > 1").select("version_id", F.lit("duplicate_feature").alias("problem"), F.col("feature_id").alias("item"))
    grade = features.where(F.col("confidence").isNotNull() & ~F.col("confidence").isin("high", "medium", "low")).select("version_id", F.lit("unknown_confidence").alias("problem"), F.col("feature_id").alias("item"))
    empty = features.where(F.coalesce(F.size("source_nodes"), F.lit(0)) == 0).select("version_id", F.lit("no_source_nodes").alias("problem"), F.col("feature_id").alias("item"))
    ends = relations.select("version_id", F.explode(F.array("from_feature", "to_feature")).alias("feature_id")).distinct()
    ends = ends.join(features.select("version_id", "feature_id"), ["version_id", "feature_id"], "left_anti").select("version_id", F.lit("unknown_endpoint").alias("problem"), F.col("feature_id").alias("item"))
    return twice.union(grade).union(empty).union(ends)


def patch(features: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with source_nodes replaced where changes (version_id, feature_id, source_nodes) say so, and the changes that name none."""
    new = changes.select("version_id", "feature_id", F.col("source_nodes").alias("given"))
    patched = features.join(new, ["version_id", "feature_id"], "left").withColumn("source_nodes", F.coalesce("given", "source_nodes")).drop("given")
    return patched, changes.join(features.select("version_id", "feature_id"), ["version_id", "feature_id"], "left_anti").select("version_id", "feature_id")


def description_prints(features: DataFrame) -> DataFrame:
    """A SHA-256 of every description, null as the empty text."""
    return features.select("version_id", "feature_id", F.sha2(F.coalesce("description", F.lit("")).cast("binary"), 256).alias("print"))


def count_drift(features: DataFrame) -> DataFrame:
    """Features that declare source nodes but list none."""
    listed = F.coalesce(F.size("source_nodes"), F.lit(0))
    return features.where((F.col("source_node_count") > 0) & (listed == 0)).select("version_id", "feature_id", F.col("source_node_count").cast("bigint").alias("declared"))


def unanalysed_tags(tags: DataFrame, versions: DataFrame, labels_too: bool = False) -> DataFrame:
    """Tags (project_id, tag) that no version has; with labels_too also none as its label."""
    known = versions.select("project_id", F.explode("git_tags").alias("tag"))
    if labels_too:
        known = known.union(versions.where(F.col("label").isNotNull()).select("project_id", F.col("label").alias("tag")))
    return tags.join(known, ["project_id", "tag"], "left_anti").distinct()


def references_of(versions: DataFrame) -> DataFrame:
    """What may be used to name each version, as JSON without what is missing."""
    return versions.select(
        "project_id", "version_id", F.to_json(F.struct("version_id", F.nullif("label", F.lit("")).alias("label"), F.left("commit_hash", F.lit(7)).alias("commit"), F.when(F.size("git_tags") > 0, F.array_join("git_tags", ",")).alias("tags"))).alias("names")
    )
