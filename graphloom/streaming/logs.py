"""Streams of log lines and events: tolerant parsing, last entries by key, windows and sessions with late data, timeouts.

A stream is run to the end of what is there (available now) into Parquet in the shared folder and read back, so nothing
is gathered in the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.scope import DISCOVERY_DAYS, INVESTIGATION_DAYS
from graphloom.session import shared_folder


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines; lines that are none are left out."""
    return spark.readStream.text(path).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("d")).select("d.*")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table, a file or a folder, with times that watermarks can follow."""
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which may also mean one file
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in batch.dtypes])


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream has put out once it has read what is there."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    else:
        def keep(df: DataFrame, number: int) -> None:
            df.withColumn("batch_number", F.lit(number)).write.mode("append").parquet(f"{place}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch_number", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{place}/out")


def latest_by_key(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last entry of each key, kept up to date while the stream goes on."""
    changes = finished(stream.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("last")), "update")
    best = changes.groupBy(*keys).agg(F.max_by("last", "batch_number").alias("last"))
    return best.select(*keys, F.col(f"last.{value}").alias(value))


def windowed(stream: DataFrame, time: str, length: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and keys; a window comes out once the watermark, `late` behind the newest row, has passed it."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(span.alias("span"), *keys).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Runs of a key's rows with no gap longer than `gap`."""
    span = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(span.alias("span"), key).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), key, "n")


def escalations(stream: DataFrame, late: str = "1 hour", discovery_hours: int = 24 * DISCOVERY_DAYS, investigation_hours: int = 24 * INVESTIGATION_DAYS) -> DataFrame:
    """Doubts (doubt_id, ts, to_state) that wait too long for their next move, with the state they waited in since when.

    State of a doubt is its last state and since when; a timer stands at the moment it would be escalated, and fires when
    the watermark passes it. A move that comes later than that tells of the wait as well.
    """
    limits = {"discovered": discovery_hours * 3_600_000, "investigating": investigation_hours * 3_600_000}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waited: list[tuple[str, int]] = []
        name, since, told = state.get if state.exists else ("", 0, False)
        if state.hasTimedOut:
            state.update((name, since, True))
            waited.append((name, since))
        else:
            moves = [(int(ts.value // 1000), to) for part in parts for ts, to in zip(part["ts"], part["to_state"], strict=True)]
            for us, to in sorted(moves):
                if us >= since:
                    if name in limits and not told and us - since >= limits[name] * 1000:
                        waited.append((name, since))
                    name, since, told = to, us, False
            state.update((name, since, told))
            if name in limits:
                state.setTimeoutTimestamp(max(since // 1000 + limits[name], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"doubt_id": [key[0]] * len(waited), "from_state": [n for n, _ in waited], "since": [pd.Timestamp(t, unit="us") for _, t in waited]})

    watched = stream.withWatermark("ts", late)
    return watched.groupBy("doubt_id").applyInPandasWithState(
        step, "doubt_id bigint, from_state string, since timestamp", "name string, since bigint, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Of every root how many files are done, never more than there are."""
    counts = done.groupBy("root").agg(F.count("*").alias("n_done"))
    return totals.join(counts, "root", "left").select("root", F.least("n_total", F.coalesce("n_done", F.lit(0))).cast("bigint").alias("n_done"), "n_total")


def running_progress(done: DataFrame, order: str) -> DataFrame:
    return done.withColumn("n_done", F.row_number().over(Window.partitionBy("root").orderBy(order)).cast("bigint"))

