"""Findings of vulnerability scanners: flattening, one row for each, counts, and what they mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["critical", "high", "medium", "low"]
#: The nested document of a scanner.
SCAN_SCHEMA = (
    "results array<struct<source: struct<path: string, type: string>, packages: array<struct<package: struct<name: string, version: string, ecosystem: string>, "
    "vulnerabilities: array<struct<id: string, aliases: array<string>, severity: array<struct<type: string, score: string>>, database_specific: struct<severity: string>>>>>>>"
)


def known_severity(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(SEVERITIES), low)


def flattened(documents: DataFrame) -> DataFrame:
    """Findings of scanner documents (results by SCAN_SCHEMA): cve_id, package, version, severity, cvss, evidence.

    The id is the first alias that is a CVE number; evidence the last CVSS 3 score, cvss the last that is a number.
    """
    packages = documents.select(F.explode("results").alias("r")).select(F.explode("r.packages").alias("p"))
    each = packages.select("p.package", F.explode("p.vulnerabilities").alias("v"))
    scores = F.transform(F.filter("v.severity", lambda s: (s["type"] == "CVSS_V3") & (F.coalesce(s["score"], F.lit("")) != "")), lambda s: s["score"])
    numbers = F.filter(F.transform(scores, lambda s: F.try_to_number(s, F.lit("99.9")).cast("double")), lambda x: x.isNotNull())
    cve = F.try_element_at(F.filter(F.coalesce("v.aliases", F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(1))
    return each.select(
        F.coalesce(cve, F.col("v.id")).alias("cve_id"), F.col("package.name").alias("package"), F.col("package.version").alias("version"),
        known_severity(F.col("v.database_specific.severity")).alias("severity"), F.try_element_at(numbers, F.lit(-1)).alias("cvss"), F.coalesce(F.try_element_at(scores, F.lit(-1)), F.lit("")).alias("evidence"),
    )


def deduplicated(findings: DataFrame, order: list[str]) -> DataFrame:
    """One finding of each (cve_id, package, version): with evidence before without, then by cvss, then the first in order."""
    rest = [c for c in findings.columns if c not in ("cve_id", "package", "version")]
    rank = F.struct((F.col("evidence") == "").alias("none"), (-F.coalesce("cvss", F.lit(-1.0))).alias("low"), *order, *[c for c in rest if c not in order])
    best = findings.groupBy("cve_id", "package", "version").agg(F.min(rank).alias("r"))
    return best.select("cve_id", "package", "version", *[F.col(f"r.{c}").alias(c) for c in rest])


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings by known severity, with its rank; those without are left out."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.where(F.col("severity").isNotNull()).groupBy("severity", rank.cast("bigint").alias("severity_rank")).agg(F.count("*").alias("n"))


def node_markers(anomalies: DataFrame) -> DataFrame:
    """Of every node (anomalies: node_id, anomaly_type) the highest of vuln_high and vuln_medium, as high or medium."""
    grade = F.when(F.col("anomaly_type") == "vuln_high", 2).when(F.col("anomaly_type") == "vuln_medium", 1)
    return anomalies.withColumn("g", grade).where(F.col("g").isNotNull()).groupBy("node_id").agg(F.when(F.max("g") == 2, "high").otherwise("medium").alias("marker"))


def feature_markers(owned: DataFrame, markers: DataFrame) -> DataFrame:
    """The highest marker of a feature's nodes."""
    met = owned.join(markers, "node_id")
    group = [c for c in owned.columns if c != "node_id"]
    return met.groupBy(*group).agg(F.when(F.max(F.col("marker") == "high"), "high").otherwise("medium").alias("marker"))


def header(counts: DataFrame) -> DataFrame:
    """One line of text with the counts of all severities."""
    parts = [F.concat(F.lit(f"{s}: "), F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("string")) for s in SEVERITIES]
    return counts.agg(F.concat_ws(" | ", *parts).alias("line"))
