"""Queries of the problems on texts, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, docpairs, nl_in_code, packing, residue
from graphloom.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_names(table(spark, d, "source_files"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "source_files")).dropDuplicates(["file_id", "name", "line_no"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nl_in_code.file_languages(table(spark, d, "source_files")).select("file_id", "nl_lang")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return nl_in_code.file_languages(table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded, decoded again and compared."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    again = bpe.decoded(bpe.encoded(documents)).withColumnRenamed("text", "again")
    both = documents.join(again, "doc_id")
    return both.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("again")).alias("same"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counts = packing.sized(bpe.token_counts(table(spark, d, "documents")))
    return packing.packed(counts, table(spark, d, "token_budgets"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), table(spark, d, "token_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.cases(table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    return residue.without_cases(table(spark, d, "documents")).select("doc_id")


QUERIES = {
    "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_shares": p4_shares, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_kept": p9_kept,
}

ORACLES = {
    "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
