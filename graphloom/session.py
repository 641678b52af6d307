"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What every session of the engine wants; cluster sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    conf = DEFAULTS | {
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions or cpus),
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("graphloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as no executor would find
    what another one wrote on its own machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, rows are made once and read as often as needed.

    Read back, a table has its true size and none of what the optimizer inferred of its making; estimates that loops carry
    from round to round would double their digits each time. The table stays until `dropped`, or until the folder is
    cleared, as any plan made from it may still run.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of a checkpoint that nothing will read again, such as a loop's last round but one."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._table)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
