"""Mail, feeds and transcripts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import messages, upkeep
from paperloom.plans.agenda import unique_sql
from paperloom.plans.reading import table
from paperloom.registry import query
from paperloom.session import new_table
from paperloom.sources.mailbox import MailboxSource
from paperloom.streaming import intake


@query("""SELECT conv_id, turn, role, 'Message ' || conv_id AS subject, 'b@example.org' AS sender FROM conversations""")
def mail_headers(spark, sf_dir):
    """Headers of a message; folded lines are joined and the last of a name wins."""
    raw = F.concat(F.lit("Subject: Message\r\n "), F.col("conv_id").cast("string"), F.lit("\r\nFrom: a@example.org\r\nFROM: b@example.org\r\nX-Odd\r\n\r\nBody: none\r\n"))
    h = messages.headers(raw)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", h["subject"].alias("subject"), h["from"].alias("sender"))


@query("""WITH q AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN 1 THEN text || chr(10) || '> quoted' ELSE text END AS text FROM conversations), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM q)
SELECT conv_id, turn, role, CASE WHEN len(list_filter(lines, lambda x: starts_with(ltrim(x), '>'))) / len(lines) <= 0.6 THEN array_to_string(list_filter(lines, lambda x: NOT starts_with(ltrim(x), '>')), chr(10)) END AS body FROM l""")
def quoted_replies(spark, sf_dir):
    """Quoted threads are dropped."""
    t = F.col("text")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> ")))).when(F.col("turn") % 3 == 1, F.concat(t, F.lit("\n> quoted"))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.without_quotes(text).alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['a-' || (o_orderkey % 7) || '.pdf', 'z.png'] ELSE ['z.png'] END AS names FROM orders""")
def attachment_names(spark, sf_dir):
    """Names of attachments, sorted, each once."""
    part = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('x; filename="a-'), (F.col("o_orderkey") % 7).cast("string"), F.lit('.pdf"\n'))).otherwise("")
    raw = F.concat(F.lit('filename="z.png"\n'), part, F.lit('filename="z.png"'))
    return table(spark, sf_dir, "orders").select("o_orderkey", messages.attachment_names(raw).alias("names"))


@query(unique_sql("SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 5 = 1 THEN ' (2).md' ELSE '.md' END AS name FROM part", "regexp_extract(lower(name), '^([a-z]+ [a-z]+)')", ".md").replace("SELECT id, unique_name FROM walk", "SELECT id, unique_name AS file FROM walk"))
def tool_drafts(spark, sf_dir):
    """Documents from the text items of a tool's result."""
    text = F.concat(F.lit("\n  Subject: "), "p_name", F.when(F.col("p_partkey") % 5 == 1, " (2)").otherwise(""), F.lit("\nmore"))
    return messages.drafts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("""SELECT user_id AS mailbox, event_id % 500 AS message_id, min(event_id) AS cursor FROM events WHERE event_id > 200 GROUP BY ALL""")
def change_feed(spark, sf_dir):
    """What changed since a cursor, each message once."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("cursor"), F.col("user_id").alias("mailbox"), (F.col("event_id") % 500).alias("message_id"))
    return messages.changed(e, 200)


@query("""SELECT event_id AS message_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def messages_to_fetch(spark, sf_dir):
    """Listed messages that aren't known yet."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), "user_id", "event_type")
    return messages.to_fetch(e.select("message_id", "user_id"), e.where("event_type = 'purchase'"))


@query("""WITH m AS (SELECT event_id AS cursor, 'm' || (event_id * 7 % ((SELECT count(*) FROM events) * 2 // 3)) AS message_id, event_type AS text, CASE WHEN event_id < (SELECT count(*) FROM events) // 2 THEN 0 ELSE 1 END AS batch FROM events WHERE event_id % 50 <> 3)
SELECT message_id, min(cursor) AS cursor, arg_min(text, cursor) AS text, min(batch) AS batch FROM m GROUP BY message_id""")
def synced_mail(spark, sf_dir):
    """A mailbox of events, taken in from a stream with a partition a page. One line in 50 is damaged. Between two
    runs half of the events arrive and the mailbox forgets its changes, so that the second starts over and skips what is known."""
    spark.dataSource.register(MailboxSource)
    e = table(spark, sf_dir, "events")
    n, folder = e.count(), new_table(spark)
    line = F.to_json(F.struct(F.col("event_id").alias("cursor"), F.concat(F.lit("m"), (F.col("event_id") * 7 % (n * 2 // 3)).cast("string")).alias("message_id"), F.col("event_type").alias("text")))
    lines = e.select("event_id", F.when(F.col("event_id") % 50 == 3, F.substring(line, 2, 20)).otherwise(line).alias("line"))

    for round, which in enumerate([F.col("event_id") < n // 2, F.col("event_id") >= n // 2]):
        pages = lines.where(which).repartitionByRange("event_id").sortWithinPartitions("event_id").select("line")
        pages.write.mode("append").option("maxRecordsPerFile", 2000).text(f"{folder}/box")
        if round:
            upkeep._put(spark, f"{folder}/box/history.json", json.dumps({"oldest": n + 1}))
        stream = spark.readStream.format("mailbox").option("path", f"{folder}/box").load()
        stream.writeStream.foreachBatch(intake.synced(f"{folder}/out")).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return intake.messages(spark, f"{folder}/out").select("message_id", "cursor", "text", "batch")


@query("""WITH g AS (SELECT user_id AS speaker, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY speaker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM g)
SELECT speaker, "group", min(ts) AS start, max(ts) AS "end", count(*) AS pieces FROM n GROUP BY ALL""")
def utterance_groups(spark, sf_dir):
    """A22, E08 in part: utterances grouped by silence; events have no text whose length could part them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("speaker"), "ts", F.col("event_id").alias("id"))
    return messages.utterances(e, "1800")


@query("""SELECT event_id, CASE WHEN s // 3600 > 0 THEN format('[{}:{:02d}:{:02d}]', s // 3600, s % 3600 // 60, s % 60) ELSE format('[{}:{:02d}]', s // 60, s % 60) END AS clock FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)""")
def transcript_clock(spark, sf_dir):
    """The clock before an utterance."""
    return table(spark, sf_dir, "events").select("event_id", messages.clock((F.col("event_id") * 37 % 9000)).alias("clock"))
