"""Tables and texts that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import or_missing
from graphloom.operators.views import CHANGE_ORDER, risk_order

#: By which fields notes of a mode belong together.
NOTE_KEYS = {"feature": ["feature_id"], "layer": ["feature_id", "layer"], "diff": ["baseline", "current", "feature_id"], "project": ["project_id"]}


def diff_view(changes: DataFrame, relations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Changed features with the keys they are sorted by, and the relations whose ends both changed."""
    changed = changes.where(F.col("diff_state").isin(*CHANGE_ORDER))
    first, second = risk_order(F.col("risk_flags"), F.col("diff_state"))
    ids = changed.select(*keys, "feature_id").distinct()
    edges = relations.join(ids.withColumnRenamed("feature_id", "from_feature"), [*keys, "from_feature"], "left_semi").join(
        ids.withColumnRenamed("feature_id", "to_feature"), [*keys, "to_feature"], "left_semi"
    )
    return changed.withColumns({"risk_place": first, "change_place": second}), edges


def report_view(changes: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Changes with their details (keys..., label, summary); a change without any shows its id and says that the text is missing."""
    met = changes.join(details, keys, "left")
    return met.withColumns({"label": F.coalesce("label", F.col(keys[-1])), "summary": or_missing(F.col("summary"))})


def notes_of(notes: DataFrame, mode: str, **wanted: str) -> DataFrame:
    """Notes of a mode whose key fields are as wanted; a field that isn't given matches all."""
    condition: Column = F.col("mode") == mode
    for field in NOTE_KEYS[mode]:
        if field in wanted:
            condition = condition & F.col(field).eqNullSafe(wanted[field])
    return notes.where(condition)


def note_error() -> Column:
    """What is wrong with a note (author, text, mode and its key fields), or null."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    out = F.when(blank("author"), "author_required").when(F.char_length("author") > 40, "author_too_long").when(blank("text"), "text_required").when(F.char_length("text") > 2000, "text_too_long")
    out = out.when(F.col("mode").isNull() | ~F.col("mode").isin(*NOTE_KEYS), "unknown_mode")
    for mode, fields in NOTE_KEYS.items():
        for f in fields:
            out = out.when((F.col("mode") == mode) & F.col(f).isNull(), f"{f}_required")
    return out


def narrative_text(log: DataFrame) -> DataFrame:
    """A line of text for each record of a narrative log."""
    kind = F.col("record_type")
    batch = F.concat(F.lit("batch "), F.coalesce(F.col("batch").cast("string"), F.lit("?")), F.lit(": "), F.coalesce("llm_judgment", F.lit("")))
    again = F.concat(F.lit("regenerated "), F.coalesce("feature_id", F.lit("?")), F.lit(": "), F.coalesce("new_summary", F.lit("")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    moved = F.concat(F.lit("structure +"), size("added_nodes"), F.lit(" -"), size("removed_nodes"), F.lit(" ~"), size("modified_nodes"))
    return log.select("timestamp", F.when(kind == "batch", batch).when(kind == "regeneration", again).when(kind == "structural_change", moved).otherwise(F.concat(F.lit("? "), F.coalesce(kind, F.lit("")))).alias("line"))


def narrative_coverage(versions: DataFrame) -> DataFrame:
    """Versions with and without narratives (a map)."""
    told = F.coalesce(F.size("version_narratives"), F.lit(0)) > 0
    return versions.agg(F.count("*").alias("n_versions"), F.count(F.when(told, 1)).alias("n_told"))


def scope_list(scopes: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Scopes (scope_name, features) with how many features they have, and files that can't be read."""
    good = scopes.select("scope_name", F.coalesce(F.size("features"), F.lit(0)).cast("bigint").alias("n_features"), F.lit(True).alias("readable"))
    return good.union(unreadable.select(F.col("file").alias("scope_name"), F.lit(None).cast("bigint"), F.lit(False)))


def latest_features(features: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """The feature ids of each group's latest version."""
    last = versions.groupBy(*keys).agg(F.max_by("version_id", F.struct("made_at", "version_id")).alias("version_id"))
    return features.select("version_id", "feature_id").join(last, "version_id").select(*keys, "feature_id").distinct()


def version_table(versions: DataFrame) -> DataFrame:
    return versions.select(F.left("version_id", F.lit(8)).alias("short_id"), "version_id", "stamp", "trigger", F.array_join("git_tags", ", ").alias("tags"), F.coalesce("label", F.lit("")).alias("label"))


def doubt_table(doubts: DataFrame, width: int = 30) -> DataFrame:
    """Doubts with texts cut to a width."""
    cut = lambda c: F.when(F.char_length(c) > width, F.concat(F.left(c, F.lit(width - 1)), F.lit("…"))).otherwise(F.col(c))
    return doubts.select(F.left(F.col("doubt_id").cast("string"), F.lit(8)).alias("short_id"), cut("source_node").alias("source_node"), "doubt_type", "current_state")


def availability(projects: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Of every project whether each part has rows of it."""
    out = projects.select("project_id").distinct()
    for name, df in parts.items():
        out = out.join(df.select("project_id").distinct().withColumn(name, F.lit(True)), "project_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def group_view(members: DataFrame, current: str) -> DataFrame:
    """Members of groups with whether they are the current project."""
    return members.withColumn("is_current", F.col("project_id") == current)


def with_badges(nodes: DataFrame, badges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with their badge; `none` is no badge."""
    return nodes.join(badges, keys, "left").withColumn("badge", F.nullif("badge", F.lit("none")))


def serialised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as JSON beside their keys, with what is null left in."""
    return rows.select(*keys, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def mermaid_scope(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of a scope as the text of a Mermaid graph, one for each group."""
    line = F.concat(F.lit("  "), "feature_id", F.lit(":::"), "scope_state")
    return states.groupBy(*keys).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text"))
