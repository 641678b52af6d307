"""Hot groups: finding them, and neighbours within a group without gathering the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint

#: A group under this many rows always fits a task, whatever the size of the table.
HOT_ROWS = 500_000
#: Up to this many keys, and one row for each, are broadcast; more are joined with salted keys.
MOST_BROADCAST = 10_000
_BUCKETS = 4096
_SALTS = 64


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s]")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The groups of `keys` with more than hot_rows rows, written once; None if there are none.

    A first job counts rows by a hash of the key, which sends 4096 numbers a task. Only if a bucket is large, a second job
    counts the keys in such buckets. The limit doesn't grow with the table, so there may be one hot key for each hot_rows
    rows: they stay a table, and who joins them looks at their number first.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    counts = df.groupBy(bucket.alias("bucket")).count().where(F.col("count") > hot_rows).collect()  # at most 4096 rows
    if not counts:
        return None
    large = df if len(counts) > _BUCKETS // 2 else df.where(bucket.isin([x["bucket"] for x in counts]))
    found = checkpoint(large.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys))
    return None if found.isEmpty() else found


def _salt(df: DataFrame) -> Column:
    """A number from 0 to _SALTS - 1 that a row keeps when it is made again."""
    return F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(_SALTS))


def _salted(few: DataFrame) -> DataFrame:
    return few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def with_hot(df: DataFrame, hot: DataFrame | None, keys: list[str], slice_of: Column, name: str = "slice") -> DataFrame:
    """df with `name`: slice_of for rows of a hot group, else null."""
    if hot is None:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    flagged = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys]).withColumn("__hot", F.lit(True))
    if hot.count() <= MOST_BROADCAST:
        flagged, left, same = F.broadcast(flagged), df, F.lit(True)
    else:
        flagged, left = _salted(flagged), df.withColumn("__own", _salt(df))
        same = left["__own"] == flagged["__salt"]
    for k in keys:
        same = same & left[k].eqNullSafe(flagged[f"__hot_{k}"])
    out = left.join(flagged, same, "left").withColumn(name, F.when(F.col("__hot"), slice_of).cast("bigint"))
    return out.select(*df.columns, name)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined to right, which has at most one narrow row for a key; hot are the keys of too many rows of left.

    Rows of a hot key stay where they are: their one partner comes to them, by broadcast or, if there are many hot keys,
    once for each salt. Keys that are null find nothing.
    """
    if hot is None:
        return left.join(right, keys, how)
    marked = with_hot(left, hot, keys, F.lit(1), "__is_hot")
    cold = marked.where(F.col("__is_hot").isNull()).drop("__is_hot").join(right, keys, how)
    warm = marked.where(F.col("__is_hot").isNotNull()).drop("__is_hot")
    few = right.join(F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot, keys, "left_semi")
    if hot.count() <= MOST_BROADCAST:
        return cold.unionByName(warm.join(F.broadcast(few), keys, how))
    met = warm.withColumn("__salt", _salt(warm)).join(_salted(few), [*keys, "__salt"], how).drop("__salt")
    return cold.unionByName(met)


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, back: bool, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `out`: `value` of the row before (back) or after in its group by `order`, whose first column is a timestamp.

    The window runs within a group and a calendar month, so a group with a third of all rows is spread over its months. A
    second, compact window over one row a month carries the value over its border. If a group has too many rows even
    within a month, down to all of them at one moment, rows are numbered over range partitions and meet the next number.
    Null if there is no such row. Rows whose first order column is null get null and are nobody's neighbour; order leaves
    no ties.
    """
    rows = df.withColumn("__span", F.date_trunc("MONTH", F.col(order[0]).cast("timestamp")))
    known = rows.where(F.col(order[0]).isNotNull())
    if hot_keys(known.select(*keys, "__span"), [*keys, "__span"], hot_rows) is not None:
        return _next_number(df, keys, order, value, out, back, hot_rows)
    edge = F.max if back else F.min
    step = F.lag if back else F.lead
    compact = known.groupBy(*keys, "__span").agg(edge(F.struct(*order, F.col(value).alias("__value"))).alias("__edge"))
    compact = compact.select(
        *[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__span").alias("__c_span"),
        step(F.struct(F.col("__edge.__value").alias("v"))).over(Window.partitionBy(*keys).orderBy("__span")).alias("__over"),
    )
    inner = step(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "__span").orderBy(*order))
    rows = rows.withColumn("__near", F.when(F.col(order[0]).isNotNull(), inner))
    same = rows["__span"] == compact["__c_span"]
    for k in keys:
        same = same & rows[k].eqNullSafe(compact[f"__c_{k}"])
    joined = rows.join(compact, same, "left")
    near = F.coalesce(F.col("__near"), F.col("__over"))
    return joined.withColumn(out, near["v"]).select(*df.columns, out)


def _next_number(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, back: bool, hot_rows: int) -> DataFrame:
    known = df.where(F.col(order[0]).isNotNull())
    numbered = checkpoint(ranked(known, keys, [F.col(c).asc() for c in order], "__n", hot_rows))
    other = numbered.select(*[F.col(k).alias(f"__o_{k}") for k in keys], (F.col("__n") + (1 if back else -1)).alias("__m"), F.col(value).alias(out))
    same = numbered["__n"] == other["__m"]
    for k in keys:
        same = same & numbered[k].eqNullSafe(other[f"__o_{k}"])
    met = numbered.join(other, same, "left").select(*df.columns, out)
    return met.unionByName(df.where(F.col(order[0]).isNull()).withColumn(out, F.lit(None).cast(dict(df.dtypes)[value])))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan has fewer; else df as it is, without a shuffle.

    For rows that long Python work follows: one small file would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `out`: 1, 2, ... within each group of keys by order, which must leave no ties.

    Groups that fit a task are numbered by a window. If one doesn't, or there are no keys, rows are range-partitioned by
    group and order, numbered in their partition and written, and then moved by the counts of the partitions before: no
    task holds a group. The numbers are written before they are counted, as a second run of the range partitioning may
    draw other borders.
    """
    if keys and hot_keys(df, keys, hot_rows) is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order).withColumn("__part", F.spark_partition_id())
    local = checkpoint(placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)).cast("bigint")))
    counts = local.groupBy("__part", *keys).agg(F.max("__local").alias("__n"))  # a row for each partition of a group
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return local.join(offsets, same).select(*df.columns, (F.col("__local") + F.col("__before")).alias(out))
