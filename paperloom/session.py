"""A local session with the settings that the engine's results assume."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("paperloom")
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
    }.items():
        builder = builder.config(key, value)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


@functools.lru_cache(4)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="paperloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session without one, as in tests, has a temporary folder of this machine;
    on a cluster its absence is an error, since executors don't see each other's folders."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of `df`: its rows from a table in the shared folder, written once (a checkpoint computes them twice)."""
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of checkpointed tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a partition of `dealt`.
PART_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of about so many rows, by its keys in partitions of about PART_ROWS, not fewer than the session's: what groups or
    orders it by these keys and others needs no other shuffle, and holds no more in a task as the table grows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)), *keys)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def kept_table(name: str, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table of this application by that name: read if it is there whole, else built and written."""
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/kept-{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
