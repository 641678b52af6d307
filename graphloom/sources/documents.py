"""JSON documents and logs as tables: structures, snapshots, doubts, scopes, scanner reports, append-only logs.

Readers are given their schema, so nothing is inferred; what can't be read goes to a side table and not into the void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import region_of
from graphloom.operators.findings import SCAN_SCHEMA

STRUCTURE = (
    "files array<struct<path: string, language: string>>, nodes array<struct<node_id: string, type: string, name: string, file: string, language: string, decorators: array<string>, "
    "parameters: array<string>, return_type: string, docstring: string, comments: array<string>, start_line: int, end_line: int, body_hash: string>>, "
    "edges array<struct<`from`: string, `to`: string, type: string, resolution: string>>, "
    "topology array<struct<node_id: string, in_degree: int, out_degree: int, topology_rank: int, is_entry_point: boolean, batch_assignment: int>>"
)
SNAPSHOT = (
    "version_id string, timestamp string, trigger string, commit_hash string, git_tags array<string>, label string, codebase_path string, contract_version string, project_summary string, "
    "version_narratives map<string, string>, l1_snapshot map<string, struct<label: string, description: string, source_node_count: int, confidence: string, trigger_description: string, "
    "source_nodes: array<string>, confidence_reason: string>>, analyzed_files array<string>"
)
DOUBT = (
    "doubt_id string, source_node string, doubt_type string, current_state string, created_by string, created_at string, updated_at string, assigned_to string, "
    "state_history array<struct<from_state: string, to_state: string, timestamp: string, actor: string, reason: string>>, resolution struct<type: string, description: string, resolved_by: string, resolved_at: string>"
)
SCOPE = "scope_name string, description string, features array<struct<feature_id: string, expected_label: string>>"
NARRATIVE = (
    "record_type string, timestamp string, batch int, strategy string, llm_judgment string, pruned_nodes array<string>, pending_low_confidence array<string>, feature_id string, "
    "previous_summary string, new_summary string, added_nodes array<string>, removed_nodes array<string>, modified_nodes array<string>"
)
NOTE = "id string, mode string, target string, author string, text string, created_at string"


def documents(spark: SparkSession, path: str, schema: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The JSON documents under path, one for each file (or line), and the texts that are none."""
    raw = spark.read.text(path, wholetext=whole).select(F.col("value"), F.input_file_name().alias("file"))
    fine = F.try_parse_json("value").isNotNull()
    return raw.where(fine).select("file", F.from_json("value", schema).alias("d")).select("file", "d.*"), raw.where(~fine)


def structures(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Files, nodes, edges and topology of structure documents; an edge without a resolution is matched by name, lists are never null."""
    found, _ = documents(spark, path, STRUCTURE)
    nodes = found.select("file", F.posexplode("nodes").alias("node_ord", "n")).select(F.col("file").alias("document"), "node_ord", "n.*")
    empty = F.array().cast("array<string>")
    nodes = nodes.withColumns({c: F.coalesce(c, empty) for c in ("decorators", "parameters", "comments")})
    edges = found.select("file", F.posexplode("edges").alias("edge_ord", "e")).select(
        F.col("file").alias("document"), "edge_ord", F.col("e.from").alias("from_node"), F.col("e.to").alias("to_node"), F.col("e.type").alias("type"), F.coalesce("e.resolution", F.lit("name_match")).alias("resolution")
    )
    return {
        "files": found.select(F.col("file").alias("document"), F.inline("files")), "nodes": nodes, "edges": edges,
        "topology": found.select(F.col("file").alias("document"), F.inline("topology")),
    }


def write_structure(files: DataFrame, nodes: DataFrame, edges: DataFrame, topology: DataFrame, path: str, document: str = "document") -> None:
    """The tables of `structures` as one JSON document for each name in `document`, nodes and edges in their order."""
    def lists(df: DataFrame, out: str, *order: str, **renamed: str) -> DataFrame:
        fields = [F.col(c).alias(renamed.get(c, c)) for c in df.columns if c not in (document, *order)]
        rows = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("x"))))
        return df.groupBy(document).agg(F.transform(rows, lambda r: r["x"]).alias(out))

    whole = lists(files, "files").join(lists(nodes, "nodes", "node_ord"), document, "full").join(
        lists(edges, "edges", "edge_ord", from_node="from", to_node="to"), document, "full").join(lists(topology, "topology"), document, "full")
    whole.repartition(document).write.mode("overwrite").partitionBy(document).option("ignoreNullFields", "false").json(path)


def write_versions(rows: DataFrame, path: str, key: str = "version_id") -> None:
    """Rows as gzipped JSON, a folder for each version."""
    rows.write.mode("append").partitionBy(key).option("compression", "gzip").json(path)


def read_version(spark: SparkSession, path: str, schema: str, version: str, key: str = "version_id") -> DataFrame:
    """One version's rows; only its folder is read, corrupt files are passed over."""
    return spark.read.schema(f"{schema}, {key} string").option("ignoreCorruptFiles", "true").json(path).where(F.col(key) == version)


def write_regions(nodes: DataFrame, path: str) -> None:
    """Nodes as Parquet, a folder for each region of their paths."""
    nodes.withColumn("region", region_of(F.col("node_id"))).write.mode("overwrite").partitionBy("region").parquet(path)


def region_index(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The index of a regional artifact: of each region its nodes, files and edges within it, to it and from it."""
    own = nodes.groupBy(region_of(F.col("node_id")).alias("region")).agg(F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files"))
    ends = edges.select(region_of(F.col("from_node")).alias("a"), region_of(F.col("to_node")).alias("b"))
    inside = F.col("a") == F.col("b")
    sides = ends.select(F.inline(F.array(F.struct(F.col("a").alias("region"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("region"), F.lit(0).alias("o"), F.lit(1).alias("i")))), inside.alias("inside"))
    counts = sides.groupBy("region").agg(
        F.count(F.when(F.col("inside") & (F.col("o") == 1), 1)).alias("n_inside"), F.count(F.when(~F.col("inside") & (F.col("o") == 1), 1)).alias("n_outbound"), F.count(F.when(~F.col("inside") & (F.col("i") == 1), 1)).alias("n_inbound")
    )
    own.join(counts, "region", "full").na.fill(0).orderBy("region").write.mode("overwrite").parquet(path)


def read_regions(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """Nodes of the given regions, whose folders alone are read; of all without any."""
    rows = spark.read.parquet(path)
    return rows if regions is None else rows.where(F.col("region").isin(regions))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots under path; corrupt ones are left out."""
    return documents(spark, path, SNAPSHOT)[0]


def snapshot_features(found: DataFrame) -> DataFrame:
    """The features of snapshots; a count of source nodes that none are listed for becomes 0."""
    rows = found.select("version_id", F.explode("l1_snapshot").alias("feature_id", "f")).select("version_id", "feature_id", "f.*")
    return rows.withColumn("source_node_count", F.when(F.coalesce(F.size("source_nodes"), F.lit(0)) == 0, 0).otherwise(F.col("source_node_count")))


def snapshot_row(version_id: str, timestamp: str, trigger: str, label: str | None = None) -> dict:
    """A new snapshot; a manual one without a label is named by its time. Id and time are given, so runs repeat."""
    return {"version_id": version_id, "timestamp": timestamp, "trigger": trigger, "label": label or (f"manual-{timestamp[:19]}" if trigger == "manual" else None)}


def latest(versions: DataFrame, order: str = "stamp") -> DataFrame:
    """The last version by its time text."""
    return versions.orderBy(F.col(order).desc(), F.col("version_id").desc()).limit(1)


def with_structure_flag(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Versions with whether a structure is stored for them."""
    flag = stored.select("version_id").distinct().withColumn("stored", F.lit(True))
    return versions.join(flag, "version_id", "left").withColumn("has_structure", F.coalesce("stored", F.lit(False))).drop("stored")


def without(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """Versions but those deleted; deleting again changes nothing."""
    return versions.join(gone.select("version_id").distinct(), "version_id", "left_anti")


def log(spark: SparkSession, path: str, schema: str = NARRATIVE) -> tuple[DataFrame, DataFrame]:
    """An append-only log of JSON lines, and its lines that are none. Lines are numbered in each file."""
    return documents(spark, path, schema, whole=False)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def doubts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return documents(spark, path, DOUBT)


def scopes(spark: SparkSession, path: str) -> DataFrame:
    """scope_name, feature_id, expected_label of scope documents."""
    return documents(spark, path, SCOPE)[0].select("scope_name", F.inline("features"))


def scans(spark: SparkSession, path: str) -> DataFrame:
    """Scanner reports, for findings.flattened."""
    return documents(spark, path, SCAN_SCHEMA)[0]


def latest_report(reports: DataFrame) -> DataFrame:
    """The report made last: by its own time, or else by the file's; those with a time of their own come first."""
    return reports.orderBy(F.col("generated_at").isNotNull().desc(), F.coalesce("generated_at", F.col("mtime").cast("string")).desc(), "path").limit(1)


def store_state(exists: Column, n_files: Column, readable: Column, old_layout: Column) -> Column:
    """The state of a store: path_error, not_found, legacy, empty or ok."""
    return F.when(~readable, "path_error").when(~exists, "not_found").when(old_layout, "legacy").when(n_files == 0, "empty").otherwise("ok")


#: The stages of an analysis in order.
STAGES = ["extract_structure", "edge_residue", "validate_output", "snapshot_write", "snapshot_patch", "diff"]


def ledger(stamps: DataFrame) -> DataFrame:
    """The last stamp of each stage (stage, stamped_at, detail), known stages first in their order, others by name."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    last = stamps.groupBy("stage").agg(F.max("stamped_at").alias("stamped_at"), F.max_by("detail", "stamped_at").alias("detail"))
    return last.orderBy(F.when(place == 0, len(STAGES) + 1).otherwise(place), "stage")
