"""Messages, change feeds and utterances."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.agenda import unique_names

#: Characters of an utterance at most, if it has more than one piece.
UTTERANCE = 700


def headers(raw: Column) -> Column:
    """Headers of a message as a map with lower-case names: folded lines joined, the last of a name wins."""
    head = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.replace(raw, F.lit("\r\n"), F.lit("\n")), r"(?s)^(.*?)(\n\n|$)", 1), r"\n[ \t]+", " "), "", "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))
    pairs = F.transform(lines, pair)
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def attachment_names(raw: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit('filename="([^"]*)"'), F.lit(1))))


def drafts(items: DataFrame) -> DataFrame:
    """File names of text items (id, text): the first useful line without Subject:, 70 characters at most, numbered where
    a name comes again, case aside."""
    line = F.regexp_replace(F.get(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), F.lit(0)), r"^\s*(?i:subject:)\s*", "")
    clean = F.trim(F.substring(F.regexp_replace(F.regexp_replace(line, r'[/\\:*?"<>|#]', " "), r"\s+", " "), 1, 70))
    named = items.select("id", F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("untitled")), F.lit(".md")).alias("name"))
    return unique_names(named).withColumnRenamed("unique_name", "file")


def changed(feed: DataFrame, since: int) -> DataFrame:
    """Messages (cursor, mailbox, message_id) after a cursor, each once: where it comes first."""
    return feed.where(F.col("cursor") > since).groupBy("mailbox", "message_id").agg(F.min("cursor").alias("cursor"))


def to_fetch(listed: DataFrame, seen: DataFrame) -> DataFrame:
    return listed.join(seen.select("message_id").distinct(), "message_id", "left_anti")


def utterances(rows: DataFrame, gap: str, most: int = UTTERANCE) -> DataFrame:
    """Groups of rows (speaker, ts, id) with no silence longer than `gap` seconds, numbered in order.

    Rows with a text are also parted where the next piece would take the texts of a group beyond `most` characters, and
    groups have the joined text; blank pieces do not count.
    """
    spoken = "text" in rows.columns
    if spoken:
        rows = rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    w = Window.partitionBy("speaker").orderBy("ts", "id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    new = F.coalesce(pause > F.lit(float(gap) * 1e6), F.lit(True)).cast("int")
    numbered = rows.withColumn("group", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("pieces")]
    if spoken:
        numbered = _parted(numbered.select("speaker", "ts", "id", "text", "group"), most)
        ends.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda p: p["text"]), " ").alias("text"))
    return numbered.groupBy("speaker", "group").agg(*ends)


def _parted(rows: DataFrame, most: int) -> DataFrame:
    """Rows (speaker, ts, id, text, group) with groups of `most` characters at most, numbered anew. A task reads its
    speakers in order of time and keeps the size of one group."""

    def parted(batches):
        before, number, size = None, 0, 0
        for batch in batches:
            numbers = []
            for speaker, group, n in zip(batch.column("speaker").to_pylist(), batch.column("group").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if before is None or before[0] != speaker:
                    number, size = 1, n
                elif before[1] != group or size + n > most:
                    number, size = number + 1, n
                else:
                    size += 1 + n
                before = (speaker, group)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("speaker", "ts", "id", "text")), pa.array(numbers, pa.int64())], names=["speaker", "ts", "id", "text", "group"])

    ordered = rows.withColumn("size", F.length("text")).repartition("speaker").sortWithinPartitions("speaker", "ts", "id")
    return ordered.mapInArrow(parted, rows.schema)


def clock(seconds: Column) -> Column:
    """[m:ss] or [h:mm:ss]."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("[%d:%02d:%02d]", h, m, s)).otherwise(F.format_string("[%d:%02d]", m, s))
