"""Deeply nested records as related flat tables.

One depth-first visitor passes over each payload once and emits tagged rows: the table's tag, the row's primary key (its
place in the record), its parent's key, the two positions and the row's own fields as JSON. Written partitioned by tag,
each partition is one flat table; its schema is applied when it is read.

Defined cases: a payload holds one complete JSON record, bare, in other text, in a code fence, as a JSON text in a JSON
string or alone in a list; of several records the first counts; null, empty, blank, cut-off and other payloads give no
rows. A single value stands for a list of one. A null entry gives no row and keeps its place. Parts of unexpected type
give no rows. A half surrogate in a text becomes U+FFFD. Repeated payloads give repeated rows until they are made
distinct. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import spread
from graphloom.session import shared_folder

#: Schema of each table's own fields.
TABLES = {
    "output": "summary string, infrastructure_label string",
    "feature": "feature_id string, label string, description string, trigger string, trigger_description string, confidence string, confidence_reason string, needs_source_review boolean, review_reason string",
    "feature_node": "node_id string",
    "unclassified_node": "node_id string",
    "infrastructure_node": "node_id string",
    "relation": "`from` string, `to` string, relation string, relation_type string, inferred_reason string",
    "block": "block_id string, label string, responsibility string, trigger_mechanism string",
    "block_feature": "feature_id string",
    "block_relation": "`from` string, `to` string, relation string, relation_type string, inferred_reason string",
    "infrastructure_component": "component string",
    "module": "module_id string, label string, confidence string, confidence_reason string",
    "module_node": "node_id string",
    "interaction": "`from` string, `to` string, description string, relation_type string, inferred_reason string",
    "anomaly": "anomaly_type string, explanation string, confidence string",
    "anomaly_node": "node_id string",
}
#: Where the lists lie: part of the record, list, tag, the nested list of ids and its tag.
_LISTS = [
    ("l1", "features", "feature", "source_nodes", "feature_node"),
    ("l1", "feature_relations", "relation", None, None),
    ("l1_5", "blocks", "block", "related_features", "block_feature"),
    ("l1_5", "block_relations", "block_relation", None, None),
    ("l2", "modules", "module", "source_nodes", "module_node"),
    ("l2", "module_interactions", "interaction", None, None),
    ("l2", "anomalies", "anomaly", "affected_node_ids", "anomaly_node"),
]
#: Lists of ids that hang on the record itself: part, list and tag.
_IDS = [("l1", "unclassified_nodes", "unclassified_node"), ("l1", "infrastructure_nodes", "infrastructure_node")]
_FIELDS = {tag: [c.split()[0].strip("`") for c in ddl.split(", ")] for tag, ddl in TABLES.items()}
_SCHEMA = pa.schema([
    ("tag", pa.string()), ("raw_id", pa.int64()), ("pk", pa.string()), ("parent_pk", pa.string()), ("parent_pos", pa.int64()), ("child_pos", pa.int64()), ("payload", pa.string()),
])
_DDL = "tag string, raw_id bigint, pk string, parent_pk string, parent_pos bigint, child_pos bigint, payload string"
_DECODER = json.JSONDecoder()
_HALF = re.compile("[\ud800-\udfff]")
_OPENING = re.compile(r"[{\[]\s*[\"{\[\]}]")


def record(text: str | None, depth: int = 0) -> dict | None:
    """The JSON record in a payload, or None."""
    if not text or depth > 3:
        return None
    bare = text.strip("﻿ \t\r\n")
    try:
        value = json.loads(bare)
    except RecursionError:
        return None
    except ValueError:
        value = None
        m = _OPENING.search(bare)
        while m:
            try:
                found, end = _DECODER.raw_decode(bare, m.start())
            except RecursionError:
                return None
            except ValueError:
                return None  # what begins as a record and doesn't end is cut off; what is inside it is none
            if isinstance(found, dict) and found or isinstance(found, list) and any(isinstance(x, dict) for x in found):
                value = found
                break
            m = _OPENING.search(bare, end)
    if isinstance(value, str):
        return record(value, depth + 1)
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, dict) else None


def _clean(value: str) -> str:
    return value if value.isascii() else _HALF.sub("\N{REPLACEMENT CHARACTER}", value)


def _as_text(value: object) -> str | bool | None:
    if value is None or isinstance(value, bool):
        return value
    return _clean(value) if isinstance(value, str) else json.dumps(value, ensure_ascii=True)


def _as_list(value: object) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def _payload(tag: str, values: dict) -> str:
    return json.dumps({k: _as_text(values[k]) for k in _FIELDS[tag] if values.get(k) is not None}, ensure_ascii=False)


def _ids(value: object) -> Iterator[tuple[int, object]]:
    """The ids of a list with their places; an object counts by its node_id, nulls and lists by none."""
    for j, node in enumerate(_as_list(value)):
        if isinstance(node, dict):
            node = node.get("node_id")
        if node is not None and not isinstance(node, (dict, list)):
            yield j, node


def visit(top: dict, raw_id: int | None) -> Iterator[tuple]:
    """The tagged rows of one record, depth first."""
    parts = {p: top.get(p) for p in ("l1", "l1_5", "l2")}
    if "l1" not in top and ("features" in top or "feature_relations" in top):
        parts["l1"] = top
    l1, block = (parts["l1"] if isinstance(parts["l1"], dict) else {}), parts["l1_5"]
    block = block.get("infrastructure_block") if isinstance(block, dict) else None
    block = block if isinstance(block, dict) else {}
    yield "output", raw_id, "", "", 0, 0, _payload("output", {"summary": l1.get("summary"), "infrastructure_label": block.get("label")})
    for part, name, tag in _IDS:
        for j, node in _ids(parts[part].get(name) if isinstance(parts[part], dict) else None):
            yield tag, raw_id, f"{part}.{name}[{j}]", "", 0, j, _payload(tag, {"node_id": node})
    for j, node in _ids(block.get("components")):
        yield "infrastructure_component", raw_id, f"l1_5.infrastructure_block.components[{j}]", "", 0, j, _payload("infrastructure_component", {"component": node})
    for part, name, tag, nested, nested_tag in _LISTS:
        holder = parts[part]
        for i, entry in enumerate(_as_list(holder.get(name)) if isinstance(holder, dict) else []):
            if not isinstance(entry, dict):
                continue
            pk = f"{part}.{name}[{i}]"
            yield tag, raw_id, pk, "", i, 0, _payload(tag, entry)
            for j, node in _ids(entry.get(nested)) if nested else ():
                yield nested_tag, raw_id, f"{pk}.{nested}[{j}]", pk, i, j, _payload(nested_tag, {_FIELDS[nested_tag][0]: node})


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for raw_id, text in zip(batch.column(0), batch.column(1), strict=True):
            found = record(text.as_py())
            if found is not None:
                rows += visit(found, raw_id.as_py())
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def tagged(df: DataFrame, id_column: str = "raw_id", text_column: str = "payload") -> DataFrame:
    """The tagged rows of all payloads: tag, raw_id, pk, parent_pk, parent_pos, child_pos, payload."""
    return spread(df.select(F.col(id_column).cast("bigint"), F.col(text_column)).where(F.col(text_column).isNotNull())).mapInArrow(_batches, _DDL)


def write_tables(rows: DataFrame, path: str) -> None:
    """One pass over rows of `tagged`, written partitioned by tag."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def tables(df: DataFrame, path: str | None = None, id_column: str = "raw_id", text_column: str = "payload") -> DataFrame:
    """The tagged rows of all payloads, visited once, written partitioned by tag (to path, else the shared folder) and read back.

    A filter on the tag then reads that table's files only.
    """
    path = path or f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    write_tables(tagged(df, id_column, text_column), path)
    return df.sparkSession.read.schema(_DDL).parquet(path)


def with_schema(rows: DataFrame, tag: str) -> DataFrame:
    """One tag's rows, of `tagged` or read from `write_tables`, as a flat table."""
    own = F.from_json("payload", TABLES[tag])
    return rows.where(F.col("tag") == tag).select("raw_id", "pk", "parent_pk", "parent_pos", "child_pos", own.alias("own")).select(
        "raw_id", "pk", "parent_pk", "parent_pos", "child_pos", "own.*"
    ).distinct()


def _own(field: str) -> Column:
    return F.get_json_object("payload", f"$.{field}")


def nested_keys(df: DataFrame) -> DataFrame:
    """raw_id, kind, parent_pos, child_pos, child_key of every feature node, relation and anomaly node."""
    rows = tables(df).where(F.col("tag").isin("feature_node", "relation", "anomaly_node"))
    key = F.when(F.col("tag") == "relation", F.coalesce(_own("relation_type"), F.lit(""))).otherwise(_own("node_id"))
    return rows.select("raw_id", F.col("tag").alias("kind"), "parent_pos", "child_pos", key.alias("child_key")).distinct()
