"""Declared scope against what was found, and the life of doubts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which state a doubt may go to, and the states it ends in.
TRANSITIONS = {
    "discovered": ["investigating", "escalated"],
    "investigating": ["explained", "fixed", "escalated"],
    "escalated": ["explained", "fixed", "accepted_risk"],
    "explained": [], "fixed": [], "accepted_risk": [],
}
TERMINAL = ["explained", "fixed", "accepted_risk"]
DISCOVERY_DAYS, INVESTIGATION_DAYS = 3, 7


def reconcile(scope: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Of every feature in the scope or found: in_scope_complete, in_scope_incomplete or out_of_scope."""
    a = scope.select(*keys, "feature_id", F.lit(1).alias("s"), F.lit(0).alias("f"))
    b = found.select(*keys, "feature_id", F.lit(0).alias("s"), F.lit(1).alias("f"))
    both = a.union(b).groupBy(*keys, "feature_id").agg(F.max("s").alias("s"), F.max("f").alias("f"))
    state = F.when(F.col("s") == 0, "out_of_scope").when(F.col("f") == 0, "in_scope_incomplete").otherwise("in_scope_complete")
    return both.select(*keys, "feature_id", state.alias("scope_state"))


def scope_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    names = ("in_scope_complete", "in_scope_incomplete", "out_of_scope")
    return states.groupBy(*keys).agg(*[F.count(F.when(F.col("scope_state") == n, 1)).alias(f"n_{n}") for n in names])


def new_doubts(states: DataFrame, doubts: DataFrame) -> DataFrame:
    """Doubts (source_node, doubt_type) to open: entries that are out of scope or incomplete and have no active doubt."""
    wanted = states.where("scope_state in ('out_of_scope', 'in_scope_incomplete')").select(F.col("feature_id").alias("source_node"), F.col("scope_state").alias("doubt_type"))
    active = doubts.where(~F.col("current_state").isin(TERMINAL)).select("source_node", "doubt_type")
    return wanted.distinct().join(active, ["source_node", "doubt_type"], "left_anti")


def diff_in_scope(diff: DataFrame, states: DataFrame) -> DataFrame:
    """Of every version the changed features in and out of scope, and what is missing."""
    met = diff.join(states, ["version_id", "feature_id"], "full")
    alive = F.col("diff_state").isin("added", "attribute_changed", "dependency_changed")
    return met.groupBy("version_id").agg(
        F.count(F.when(alive & (F.col("scope_state") == "in_scope_complete"), 1)).alias("n_in_scope"),
        F.count(F.when(alive & (F.col("scope_state") == "out_of_scope"), 1)).alias("n_out_of_scope"),
        F.count(F.when(F.col("scope_state") == "in_scope_incomplete", 1)).alias("n_missing"),
    )


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")


def judged_moves(moves: DataFrame) -> DataFrame:
    """Moves (from_state, to_state, ...) with their verdict: legal, illegal or terminal (nothing follows the state)."""
    legal = F.broadcast(transition_table(moves.sparkSession).withColumn("legal", F.lit(True)))  # seven rows
    met = moves.join(legal, ["from_state", "to_state"], "left")
    return met.withColumn("verdict", F.when(F.col("from_state").isin(TERMINAL), "terminal").when(F.col("legal"), "legal").otherwise("illegal")).drop("legal")


def moved(doubts: DataFrame, move: DataFrame) -> DataFrame:
    """Doubts after legal moves (doubt_id, to_state, ts, actor, reason, assignee, description), one for each doubt at most."""
    given = move.select("doubt_id", "to_state", F.struct("to_state", "ts", "actor", "reason").alias("m"), "assignee", "description", "actor", F.col("ts").alias("moved_at"))
    met = doubts.join(given, "doubt_id", "left")
    step = F.struct(F.col("current_state").alias("from_state"), F.col("m.to_state").alias("to_state"), F.col("m.ts").alias("ts"), F.col("m.actor").alias("actor"), F.col("m.reason").alias("reason"))
    ends = F.col("to_state").isin(TERMINAL)
    return met.select(
        "doubt_id", F.coalesce("to_state", "current_state").alias("current_state"),
        F.when(F.col("to_state").isNotNull(), F.array_append("state_history", step)).otherwise(F.col("state_history")).alias("state_history"),
        F.when(F.col("to_state") == "investigating", F.col("assignee")).otherwise(F.col("assigned_to")).alias("assigned_to"),
        F.when(ends, F.struct(F.col("to_state").alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.col("actor").alias("resolved_by"), F.col("moved_at").alias("resolved_at"))).alias("resolution"),
    )


def argument_errors(moves: DataFrame) -> DataFrame:
    """Moves that lack what they need: an assignee to investigate, a reason to escalate or accept."""
    missing = F.when((F.col("to_state") == "investigating") & F.col("assignee").isNull(), "assignee").when(F.col("to_state").isin("escalated", "accepted_risk") & F.col("reason").isNull(), "reason")
    return moves.withColumn("missing", missing).where(F.col("missing").isNotNull())


def timeouts(doubts: DataFrame, now: str, discovery_days: int = DISCOVERY_DAYS, investigation_days: int = INVESTIGATION_DAYS) -> DataFrame:
    """Doubts (current_state, created_at, last_move_at) with whether they are escalated by now, a timestamp text.

    A discovered doubt waits from its creation, one under investigation from its last move; the limit itself counts.
    """
    at = F.lit(now).cast("timestamp_ntz")
    waited = F.when(F.col("current_state") == "discovered", F.col("created_at")).when(F.col("current_state") == "investigating", F.col("last_move_at"))
    days = F.when(F.col("current_state") == "discovered", discovery_days).otherwise(investigation_days)
    seconds = F.timestamp_diff("SECOND", waited, at)
    return doubts.withColumn("timed_out", F.coalesce(seconds >= days * 86400, F.lit(False)))


def effective_state(timed: DataFrame) -> DataFrame:
    return timed.withColumn("current_state", F.when(F.col("timed_out"), "escalated").otherwise(F.col("current_state")))


def listed(doubts: DataFrame, now: str, state: str | None = None, active: bool = False) -> DataFrame:
    """Doubts after their timeouts, filtered."""
    out = effective_state(timeouts(doubts, now))
    if state is not None:
        out = out.where(F.col("current_state") == state)
    return out.where(~F.col("current_state").isin(TERMINAL)) if active else out


def doubt_summary(doubts: DataFrame) -> DataFrame:
    """Doubts by state, by type and in all, in one pass."""
    doubts.createOrReplaceTempView("graphloom_doubts")
    return doubts.sparkSession.sql(
        "SELECT current_state, doubt_type, count(*) AS n FROM graphloom_doubts GROUP BY GROUPING SETS ((current_state), (doubt_type), ())"
    )


def latest_states(moves: DataFrame) -> DataFrame:
    """Of a log of moves (doubt_id, ts, event_id, to_state) each doubt's state, first and last move."""
    order = F.struct("ts", "event_id")
    return moves.groupBy("doubt_id").agg(F.max_by("to_state", order).alias("current_state"), F.min("ts").alias("created_at"), F.max("ts").alias("last_move_at"), F.count("*").alias("n_moves"))
