"""Streams: documents added once, messages kept up to date, mail taken in by cursor, utterances grouped by silence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import exists


def added_once(stream: DataFrame, time: str = "added_at", delay: str = "1 day") -> DataFrame:
    """Documents of a stream by content hash, each once within `delay`. State older than that is dropped."""
    return stream.withWatermark(time, delay).withColumn("sha256", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["sha256"])


def grouped(stream: DataFrame, time: str = "ts", key: str = "speaker", gap: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """Utterances grouped by silence; a group is emitted when the watermark has passed its end."""
    groups = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return groups.agg(F.count(F.lit(1)).alias("pieces")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pieces")


def upserts(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch's latest row of each key as one version of a table of versions.

    Versions are folders named by the batch, overwritten if a batch runs again, so that repeating one changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
        batch.withColumn("__n", last).where("__n = 1").drop("__n").withColumn("__version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def current(spark, path: str, key: list[str]) -> DataFrame:
    """The latest version of each key."""
    rows = spark.read.parquet(path)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__version")))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n", "__version", "version")


MESSAGES = "cursor long, message_id string, text string"
REPORTS = "batch long, cursor long, added long, had long, failed long"


def synced(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on the mailbox source: adds the messages of a batch that no earlier batch has to `path`/messages, each
    where it comes first, and one row to `path`/reports: the last cursor, and how many messages were added, were there
    already (repeats in the batch included), or couldn't be read.

    A batch that runs again overwrites its own folder and sees earlier ones only, so it gives the same rows; its report is
    written last. Known messages are found by a join on their ids, so the ids of a start over cost a shuffle and no fetch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _batches(spark, f"{path}/messages", MESSAGES).where(F.col("batch") < number).select("message_id")
        good = batch.where("problem IS NULL")
        first = good.groupBy("message_id").agg(F.min_by("text", "cursor").alias("text"), F.min("cursor").alias("cursor"))
        first.join(before, "message_id", "left_anti").select("cursor", "message_id", "text").write.mode("overwrite").parquet(f"{path}/messages/batch={number}")
        added = _batches(spark, f"{path}/messages", MESSAGES).where(F.col("batch") == number).agg(F.count("*").alias("added"))
        counts = batch.agg(F.max("cursor").alias("cursor"), F.count("problem").alias("failed"), F.count("*").alias("all"))
        report = counts.crossJoin(added).select("cursor", "added", (F.col("all") - F.col("failed") - F.col("added")).alias("had"), "failed")
        report.coalesce(1).write.mode("overwrite").parquet(f"{path}/reports/batch={number}")

    return write


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    schema = schema if schema.startswith("batch") else f"{schema}, batch long"
    return spark.read.schema(schema).option("basePath", path).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """cursor, message_id, text and batch of the messages that `synced` has taken in; none before its first batch."""
    return _batches(spark, f"{path}/messages", MESSAGES)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """batch, cursor, added, had and failed of each batch of `synced`."""
    return _batches(spark, f"{path}/reports", REPORTS)
