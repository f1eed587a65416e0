"""Tables that cut lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` from a Parquet table in the shared folder, so that a lost executor costs no earlier stage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits that rule out rows before a join, in maps of MAP_BITS: 4 MB at most for each executor, however large the tables.
BITS, MAP_BITS = 1 << 25, 1 << 15


def perhaps(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Adds `perhaps`: whether a row of `ids` (one column of whole numbers) may have the value of `column`; false is sure.

    What is ruled out needs no join, so its other columns, texts above all, aren't shuffled."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITS))
    place = at(ids.columns[0])
    bits = ids.select(F.shiftright(place, 15).alias("__map"), (place % MAP_BITS).alias("bit"))
    maps = bits.repartition("__map").groupBy("__map").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    bit = at(column) % MAP_BITS
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("__map", F.shiftright(at(column), 15)).join(F.broadcast(maps), "__map", "left")
    return found.withColumn("perhaps", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__map", "__bits")
