"""Put-off tasks that come back on their day, as a stream with a timer for each group of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What the session must have set before a query of `returning` starts: a state store beside the heap.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000_000
RANKS = {"done": 0, "snooze": 1}
#: Groups that tasks are dealt to by their keys; each is one state with one timer, worked through as a table.
BUCKETS = 1024
COLUMNS = {"key": "object", "us": "int64", "rank": "int64", "day": "int64"}


def _snoozes(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest decision on each task of a bucket. It goes when its time is over: the end of a snooze, or the time of another
    decision, which is kept until nothing earlier can arrive. The bucket's timer stands at the first of these."""
    watermark = state.getCurrentWatermarkMs()
    tables = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    for rows in frames:
        tables.append(rows.loc[rows["key"].notna(), list(COLUMNS)].fillna({"day": -1}))
    # New rows that equal what is kept change nothing.
    all = pd.concat([t.astype(COLUMNS) for t in tables]).sort_values(["us", "rank", "day"]).drop_duplicates("key", keep="last")
    us, day = all["us"].to_numpy(), all["day"].to_numpy()
    ends = np.where(all["rank"] == RANKS["snooze"], np.maximum(us, day * DAY), us)
    due = -(ends // -1000)
    over = due <= watermark
    back = all[over & (ends > us)]
    if len(back):
        yield back[["key", "day", "us"]].astype({"day": "int32"})
    if over.all():
        state.remove()
        return
    kept = pa.Table.from_pandas(all[~over], pa.schema({"key": pa.string(), "us": pa.int64(), "rank": pa.int64(), "day": pa.int64()}), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as writer:
        writer.write_table(kept)
    state.update((sink.getvalue().to_pybytes(),))
    # A timer goes off once the watermark is beyond it.
    state.setTimeoutTimestamp(max(int(due[~over].min()) - 1, watermark, 1))


def returning(decisions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """key, day and decided_at of each put-off task, once, when its day (UTC) has begun.

    `decisions` is a stream of key, at (a time), action (snooze, done; others undo) and until (a date); other columns don't
    matter. The latest decision on a task counts, of those at one time the one that `agenda.task_states` takes; one that
    arrives more than `delay` late is not seen. Time is that of the rows, less `delay`: rows without a key carry it on where
    decisions are rare. A snooze without a day, or to a day that had begun when it was made, brings nothing back, and takes
    the place of an earlier one. Rows without a time are passed over, repeated rows change nothing. State holds the tasks that
    are put off or were decided on within `delay`, however long the log, in BUCKETS groups: a batch asks for the state of a
    group once, not for each of its tasks.
    """
    rank = F.when(F.col("action") == "done", RANKS["done"]).when(F.col("action") == "snooze", RANKS["snooze"]).otherwise(2)
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.col("us").cast("string"))), F.lit(BUCKETS))
    rows = decisions.where("at IS NOT NULL").withColumn("at", F.col("at").cast("timestamp")).select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("us"), rank.alias("rank"), F.unix_date("until").alias("day"))
    back = rows.withColumn("bucket", bucket).withWatermark("at", delay).groupBy("bucket").applyInPandasWithState(_snoozes, "key string, day int, us long", "tasks binary", "append", GroupStateTimeout.EventTimeTimeout)
    return back.select("key", F.date_from_unix_date("day").alias("day"), F.timestamp_micros("us").alias("decided_at"))
