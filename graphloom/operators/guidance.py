"""What to do next: rules over the state of a project, and which project is at work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Action, priority, surfaces, and the condition on a project's state.
RULES = [
    ("extract.first_time", 1, "cli mcp", "not initialised"),
    ("edge_residue.run", 2, "mcp after_error", "has_structure and n_snapshots = 0 and not residue_done"),
    ("snapshot.write_first", 2, "mcp after_error", "has_structure and n_snapshots = 0 and residue_done"),
    ("analyze_changes.incremental", 2, "cli mcp", "n_snapshots >= 1"),
    ("viewer.open", 3, "cli viewer", "n_snapshots >= 2"),
    ("diff.cli", 4, "cli", "n_snapshots >= 2"),
    ("extract.backfill_structure", 5, "cli after_error", "n_snapshots > n_with_structure"),
    ("extract.repair_drift", 6, "cli", "n_drifts > 0"),
    ("system_status.show", 90, "cli mcp viewer after_error", "true"),
    ("onboarding.read_claude_md", 99, "cli mcp viewer after_error", "true"),
]
#: The action that an error moves to the front.
BOOSTS = {
    "no_persisted_structure_for_baseline": "extract.backfill_structure", "baseline_not_found": "system_status.show",
    "snapshot_not_found": "system_status.show", "no_snapshot_for_baseline": "snapshot.write_first",
}
ACTIVE_SECONDS = 1800


def next_actions(states: DataFrame, surface: str, failure: str | None = None) -> DataFrame:
    """project_id, action, priority for every rule that holds on a surface.

    A state has initialised, has_structure, residue_done, n_snapshots, n_with_structure and n_drifts.
    """
    boosted = BOOSTS.get(failure or "") if surface == "after_error" else None
    rules = [(a, 1 if a == boosted else p, c) for a, p, s, c in RULES if surface in s.split()]
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(a).alias("action"), F.lit(p).cast("bigint").alias("priority"))) for a, p, c in rules]))
    return states.select("project_id", F.inline(found)).groupBy("project_id", "action").agg(F.min("priority").alias("priority"))


def decision(options: list[str], answer: str) -> str:
    """The option that an answer means, whatever its case; duplicate or empty options and other answers are errors."""
    folded = [o.strip().lower() for o in options]
    if not options or "" in folded or len({*folded}) < len(folded):
        raise ValueError("options are empty or not distinct")
    if answer.strip().lower() not in folded:
        raise ValueError(f"not an option: {answer}")
    return options[folded.index(answer.strip().lower())]


def most_recent(projects: DataFrame) -> DataFrame:
    """The project opened last; none if none ever was."""
    return projects.where(F.col("last_opened_at").isNotNull()).orderBy(F.col("last_opened_at").desc(), "project_id").limit(1)


def active_project(projects: DataFrame, now: str) -> DataFrame:
    """The project whose checklist was written last, after it was opened or, if it never was, in the last half hour."""
    at = F.lit(now).cast("timestamp_ntz")
    fresh = F.when(F.col("last_opened_at").isNotNull(), F.col("written_at") > F.col("last_opened_at")).otherwise(F.timestamp_diff("SECOND", F.col("written_at"), at) <= ACTIVE_SECONDS)
    return projects.where(fresh).orderBy(F.col("written_at").desc(), "project_id").limit(1)


def group_members(groups: DataFrame, projects: DataFrame) -> DataFrame:
    """group_id and the details of every member; a member that is no project has none."""
    each = groups.select("group_id", F.explode("member_ids").alias("project_id"))
    return each.join(projects, "project_id", "left")


def grouped_twice(groups: DataFrame) -> DataFrame:
    """Projects in more than one group."""
    return groups.select("group_id", F.explode("member_ids").alias("project_id")).groupBy("project_id").agg(F.countDistinct("group_id").alias("n")).where("n > 1")


def project_list(projects: DataFrame, groups: DataFrame) -> DataFrame:
    """Every project with its group, null for none."""
    each = groups.select("group_id", F.explode("member_ids").alias("project_id"))
    return projects.join(each, "project_id", "left")


def next_project_id(projects: DataFrame) -> str:
    """The next zero-padded number."""
    most = projects.agg(F.max(F.expr("try_cast(project_id as int)"))).first()[0]
    return f"{(most or 0) + 1:03d}"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, p, s) for a, p, s, _ in RULES], "action string, priority int, surfaces string")
