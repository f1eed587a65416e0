"""Dates, kinds of dates and when they ask for attention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that a date is read by, in order.
PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy")

#: Parts of a date's name and the kind of commitment that they make it, in order.
KINDS = {
    "meeting": ["meet", "call", "appointment", "interview", "hearing", "standup", "sync"],
    "payment": ["pay", "invoice", "bill", "premium", "installment"],
    "reply": ["reply", "respond", "response", "follow_up", "followup", "rsvp", "confirm"],
    "milestone": ["start", "begin", "effective", "deliver", "ship", "commence", "kickoff"],
}
#: Parts of the names of dates that only describe the past.
RECORD_KEEPING = ["signed", "issued", "dated", "received", "sent", "paid", "closed", "completed", "filed"]
WEIGHTS = {"payment": 0, "meeting": 1, "deadline": 2, "reply": 3, "milestone": 4, "check": 5}
HORIZONS = ["overdue", "today", "tomorrow", "thisWeek", "later", "someday"]


def parsed(text: Column) -> Column:
    """The date by the first pattern that fits, or null; a year alone is its first day."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(t, F.lit(p))) for p in PATTERNS))


def plausible(day: Column, now: Column) -> Column:
    return F.year(day).between(1900, F.year(now) + 60)


def commitment_kind(kind: Column) -> Column:
    k = F.replace(F.lower(kind), F.lit(" "), F.lit("_"))
    out = F.when(F.lit(False), "")
    for name, parts in KINDS.items():
        out = out.when(k.rlike("|".join(parts)), name)
    return out.otherwise("deadline")


def is_record_keeping(kind: Column) -> Column:
    return F.lower(kind).rlike("|".join(RECORD_KEEPING))


def horizon(due: Column, today: Column) -> Column:
    days = F.datediff(due, today)
    return F.when(due.isNull(), "someday").when(days < 0, "overdue").when(days == 0, "today").when(days == 1, "tomorrow").when(days <= 7, "thisWeek").otherwise("later")


def task_key(document_id: Column, kind: Column, day: Column) -> Column:
    name = F.regexp_replace(F.replace(F.lower(kind), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")
    return F.concat_ws(":", F.lit("d"), document_id.cast("string"), name, F.date_format(day, "yyyyMMdd"))


def stable_hash(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, in base 36. The hash is kept as two halves of 32 bits, which never overflow."""
    low32, times = F.lit(0xFFFFFFFF), 0x1B3  # the prime is 2^40 + times

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        product = low * times
        high = h["high"] * times + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(low32).alias("high"), product.bitwiseAND(low32).alias("low"))

    code = F.hex(F.encode(text, "UTF-8"))
    bytes = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long"))
    begin = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    halves = F.aggregate(F.when(F.length(code) > 0, bytes).otherwise(F.array().cast("array<bigint>")), begin, step)
    joined = F.get(F.transform(F.array(halves), lambda h: F.concat(F.hex(h["high"]), F.lpad(F.hex(h["low"]), 8, "0"))), F.lit(0))
    return F.lower(F.conv(joined, 16, 36))
