"""A feature's history over versions, and which versions are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import ranked


def appearances(features: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Features with their version's time (versions: version_id, made_at) and what the feature was at its last appearance.

    Versions in which a feature is missing are skipped by themselves: the window runs over its own rows only.
    """
    placed = features.join(versions, "version_id")
    line = Window.partitionBy(*keys, "feature_id").orderBy("made_at", "version_id")
    was = F.lag(F.struct("label", "description")).over(line)
    return placed.withColumns({"was": was, "seen_before": F.lag(F.lit(True)).over(line)})


def _changed() -> F.Column:
    return F.col("seen_before") & ~F.col("was").eqNullSafe(F.struct("label", "description"))


def drift_events(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Appearances whose label stayed and whose description changed."""
    same = F.col("was.label").eqNullSafe(F.col("label")) & ~F.col("was.description").eqNullSafe(F.col("description"))
    return seen.where(F.col("seen_before") & same).select(*keys, "feature_id", "version_id", F.col("was.description").alias("previous"), F.col("description").alias("current"))


def timelines(seen: DataFrame, keys: list[str]) -> DataFrame:
    """First and last version, last label, changes, drifts and whether the feature is in the latest version."""
    drift = F.col("was.label").eqNullSafe(F.col("label")) & ~F.col("was.description").eqNullSafe(F.col("description"))
    order = F.struct("made_at", "version_id")
    each = seen.groupBy(*keys, "feature_id").agg(
        F.min_by("version_id", order).alias("first_version"), F.max_by("version_id", order).alias("last_version"), F.max_by("label", order).alias("label"),
        F.count("*").alias("n_versions"), F.count(F.when(_changed(), 1)).alias("n_changes"), F.count(F.when(F.col("seen_before") & drift, 1)).alias("n_drifts"),
    )
    latest = seen.groupBy(*keys).agg(F.max_by("version_id", order).alias("latest"))
    joined = each.join(latest, keys) if keys else each.withColumn("latest", latest.scalar())
    return joined.withColumn("state", F.when(F.col("last_version") == F.col("latest"), "active").otherwise("removed")).drop("latest")


def timeline_summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.count("*").alias("n_features"), F.count(F.when(F.col("state") == "active", 1)).alias("n_active"), F.count(F.when(F.col("n_changes") > 0, 1)).alias("n_changed"), F.sum("n_drifts").alias("n_drifts")
    )


def since(features: DataFrame, versions: DataFrame, stamp: str) -> DataFrame:
    """Features of versions whose time text is not before stamp, as texts compare."""
    return features.join(versions.where(F.col("stamp") >= stamp).select("version_id"), "version_id", "left_semi")


def retention(versions: DataFrame, keys: list[str], most: int = 50, enabled: bool = True) -> DataFrame:
    """keep or remove for each version: protected ones (manual or tagged) stay, of the others the newest `most`.

    `most` of zero or less keeps none of the others; if not enabled all stay.
    """
    if not enabled:
        return versions.withColumns({"protected": F.lit(False), "decision": F.lit("keep")})
    guarded = versions.withColumn("protected", (F.col("trigger") == "manual") | (F.coalesce(F.size("git_tags"), F.lit(0)) > 0))
    loose = ranked(guarded.where(~F.coalesce("protected", F.lit(False))), keys, [F.col("made_at").desc(), F.col("version_id").desc()], "newest")
    return guarded.where("protected").withColumn("decision", F.lit("keep")).unionByName(
        loose.withColumn("decision", F.when(F.col("newest") <= max(most, 0), "keep").otherwise("remove")).drop("newest")
    )


def latest_record(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last entry of each key of an append-only log."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def rendered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A line of text for each feature of a timeline."""
    text = F.concat_ws(" ", "feature_id", F.concat(F.lit("["), F.coalesce("label", F.lit("?")), F.lit("]")), "state", F.concat(F.col("n_changes").cast("string"), F.lit(" changes,")), F.concat(F.col("n_drifts").cast("string"), F.lit(" drifts")))
    return lines.select(*keys, "feature_id", text.alias("line"))
