"""What changed between consecutive full snapshots.

Each snapshot's records are sorted by key and cut into content-defined chunks: a chunk starts at every record whose key
hash is divisible by `chunk_rows`, so a change moves no border but its own. A chunk's digest covers the keys and contents
of its records. Chunks whose digest is the same in both snapshots are discarded; only the records of the others are put
side by side and classified. Texts never leave their scan: a record travels as its key and a 128-bit digest.

Defined cases: of several rows of one key in a version the one with the latest load time is valid (of rows loaded at the
same time the one with the greater digest; they are alike); null differs from the empty text; a null key part is a value like any
other; a version without records makes all records of the one before removed, and those of the one after added; rows of
versions that no snapshot names, and versions whose time can't be read, are compared with nothing; equal times are
ordered by version id; empty tables give no rows; columns that aren't named here are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import HOT_ROWS, hot_keys, neighbour, with_hot
from graphloom.session import checkpoint

CHUNK_ROWS = 16
_SLICES = 256
_ID = ["version_id", "record_kind", "key1", "key2"]


def _digest(columns: list[str], seed: int) -> Column:
    """64 bits of the columns, nulls told from empty texts."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def records(df: DataFrame, kind: str, key1: str, key2: str | None, content: list[str]) -> DataFrame:
    """df as records of a snapshot: version_id, record_kind, key1, key2, loaded_at and the content's digest d1, d2."""
    return df.select(
        "version_id", F.lit(kind).alias("record_kind"), F.col(key1).alias("key1"),
        (F.col(key2) if key2 else F.lit("")).alias("key2"), "loaded_at",
        _digest(content, 1).alias("d1"), _digest(content, 2).alias("d2"),
    )


def version_pairs(snapshots: DataFrame) -> DataFrame:
    """version_id and previous_id of every snapshot but a project's first."""
    timed = snapshots.select("project_id", "version_id", F.expr("try_cast(timestamp as timestamp)").alias("at"))
    chained = neighbour(timed, ["project_id"], ["at", "version_id"], "version_id", "previous_id", back=True)
    return chained.where(F.col("previous_id").isNotNull()).select("version_id", "previous_id")


def sliced_versions(rows: DataFrame, snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The versions of every project that has a version of more than hot_rows rows; None if there is none.

    All of a project's versions are cut alike, so that the chunks of a large version match those of a small one beside it.
    """
    hot = hot_keys(rows.select("version_id"), ["version_id"], hot_rows)
    if hot is None:
        return None
    named = snapshots.select("version_id", "project_id")
    projects = named.join(hot, "version_id").select(F.col("project_id").alias("p")).distinct()
    alike = named.join(projects, F.col("project_id").eqNullSafe(F.col("p")), "left_semi").select("version_id")
    return checkpoint(alike.unionByName(hot).distinct())


def chunked(rows: DataFrame, sliced: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The valid records, each with the slice and the chunk of its version's sorted records that it lies in.

    The versions of `sliced` are cut into slices by key hash, so that no task sorts all of one.
    """
    key_hash = F.xxhash64("key1", F.col("key1").isNull(), "key2", F.col("key2").isNull())
    rows = rows.withColumn("key_hash", key_hash)
    rows = with_hot(rows, sliced, ["version_id"], F.pmod(F.shiftright("key_hash", 20), F.lit(_SLICES)))
    rows = rows.withColumn("slice", F.coalesce("slice", F.lit(-1).cast("bigint")))
    placed = rows.repartition("version_id", "record_kind", "slice")  # the one shuffle that all steps below share
    valid = placed.groupBy(*_ID, "slice", "key_hash").agg(F.max(F.struct("loaded_at", "d1", "d2")).alias("row"))
    line = Window.partitionBy("version_id", "record_kind", "slice").orderBy("key1", "key2").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.pmod("key_hash", F.lit(chunk_rows)) == 0, F.col("key_hash"))
    return valid.select(
        *_ID, "slice", F.coalesce(F.last(starts, ignorenulls=True).over(line), F.lit(0).cast("bigint")).alias("chunk"),
        F.col("row.d1").alias("d1"), F.col("row.d2").alias("d2"),
    )


def changed_chunks(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """The chunks that differ between the versions of a pair: pair, side, and the chunk's version_id, record_kind, slice, chunk."""
    place = ["record_kind", "slice", "chunk"]
    whole = [F.xxhash64(F.lit(s), "key1", F.col("key1").isNull(), "key2", F.col("key2").isNull(), "d1", "d2") for s in (3, 4)]
    digests = cut.groupBy("version_id", *place).agg(
        F.struct(F.count("*").alias("n"), F.bit_xor(whole[0]).alias("x1"), F.bit_xor(whole[1]).alias("x2")).alias("digest")
    )
    pairs = pairs.withColumnsRenamed({"version_id": "pair"})
    sides = F.explode(F.array(F.struct(F.col("pair").alias("version_id"), F.lit(1).alias("side")), F.struct(F.col("previous_id").alias("version_id"), F.lit(0).alias("side"))))
    roles = pairs.select("pair", sides.alias("role")).select("pair", "role.*")
    both = digests.join(roles, "version_id").groupBy("pair", *place).agg(
        *[F.max(F.when(F.col("side") == s, F.col("digest"))).alias(f"digest{s}") for s in (0, 1)],
        F.collect_list(F.struct("version_id", "side")).alias("roles"),  # two at most
    )
    differing = both.where(~F.col("digest0").eqNullSafe(F.col("digest1")))
    return differing.select("pair", *place, F.inline("roles"))


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records added, removed or changed since the previous version: version_id, record_kind, key1, key2, change."""
    cut = chunked(rows, sliced_versions(rows, snapshots, hot_rows), chunk_rows)
    differing = changed_chunks(cut, version_pairs(snapshots))
    sided = cut.join(differing, ["version_id", "record_kind", "slice", "chunk"])
    now, then = [F.max(F.when(F.col("side") == s, F.struct("d1", "d2"))) for s in (1, 0)]
    compared = sided.groupBy("pair", "record_kind", "key1", "key2").agg(now.alias("now"), then.alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return compared.select(F.col("pair").alias("version_id"), "record_kind", "key1", "key2", change.alias("change")).where(F.col("change").isNotNull())


def feature_and_relation_records(features: DataFrame, relations: DataFrame) -> DataFrame:
    """Records of both kinds as problem 2 compares them."""
    return records(features, "feature", "feature_id", None, ["label", "description"]).unionByName(
        records(relations, "relation", "from_feature", "to_feature", ["relation"])
    )
