"""Commitments, findings, facts and names that are derived from records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.session import checkpointed

#: Pairs of dates of one document whose order is fixed by their meaning, and what to say if it isn't kept.
MUST_PRECEDE = [
    ("invoice_date", "due_date", "Payment is due before the invoice was issued"),
    ("issued", "due", "Payment is due before it was issued"),
    ("issued", "expires", "Expires before it was issued"),
    ("signed", "term_end", "The term ends before it was signed"),
    ("term_start", "term_end", "The term ends before it starts"),
    ("shipped", "delivered", "Delivered before it shipped"),
    ("order_date", "ship_by", "Shipping was due before the order was placed"),
    ("departure", "return", "The return is before the departure"),
    ("start", "end", "It ends before it starts"),
    ("statement_date", "due", "Payment is due before the statement date"),
]

#: Phrases and the kind of finding that they make a sentence, in order.
FINDINGS = {
    "impossibleDate": ["does not exist", "doesn't exist", "not a valid date", "invalid date", "is not valid", "no 31st", "has 30 days", "has 28 days", "not a leap year", "month 13", "max 59", "is invalid"],
    "duplicate": ["appears twice", "duplicate", "duplicated", "listed twice", "same object", "appears two times"],
    "typo": ["misspell", "misspelt", "typo", "spelled", "spelling"],
    "inconsistentFormat": ["casing", "case", "inconsistent format", "different formats", "non-iso", "format is inconsistent", "mixed format"],
    "dateOrder": ["before", "precedes", "after the event", "impossible order", "reverse order", "earlier than"],
    "arithmetic": ["does not match", "doesn't match", "but total", "= ", "sum of", "should be", "adds up"],
    "countMismatch": ["lists only", "but only", "count", "listed but"],
    "contradiction": ["two different", "contradict", "stated as", "conflict", "but elsewhere", "inconsistent with"],
}
#: What a reporter may call a kind of finding, lower case with underscores, and the kind that it means.
LABELS = {
    "arithmetic": ["arithmetic", "math", "total_mismatch", "sum_mismatch"],
    "countMismatch": ["count", "count_mismatch"],
    "contradiction": ["contradiction", "inconsistency", "conflict"],
    "duplicate": ["duplicate", "duplicate_row", "duplicate_id"],
    "dateOrder": ["date_order", "dateorder"],
    "impossibleDate": ["impossible_date", "invalid_date"],
    "implausibleDate": ["implausible_date"],
    "typo": ["typo", "misspelling", "spelling"],
    "inconsistentFormat": ["inconsistent_format", "format", "formatting", "type_mismatch", "inconsistent_type", "unit_mismatch"],
}
PER_DOCUMENT = 6


def date_orders(dates: DataFrame) -> DataFrame:
    """document_id and detail of dates (document_id, kind, date, derived) in an impossible order.

    Of several dates of a kind the latest counts. Derived dates don't.
    """
    by = dates.where("NOT derived").groupBy("document_id", F.lower("kind").alias("kind")).agg(F.max("date").alias("date"))
    rules = dates.sparkSession.createDataFrame(MUST_PRECEDE, "earlier string, later string, why string")
    first = by.join(F.broadcast(rules), F.col("kind") == F.col("earlier")).select("document_id", "earlier", "later", "why", F.col("date").alias("early"))
    both = first.join(by.select("document_id", F.col("kind").alias("later"), F.col("date").alias("late")), ["document_id", "later"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    detail = F.concat("why", F.lit(" — "), "later", F.lit(" "), day("late"), F.lit(" is before "), "earlier", F.lit(" "), day("early"), F.lit("."))
    return both.where("late < early").select("document_id", F.lit("dateOrder").alias("kind"), detail.alias("detail"))


def finding_kind(detail: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, phrases in FINDINGS.items():
        says = F.lit(False)
        for p in phrases:
            says = says | F.lower(detail).contains(p)
        out = out.when(says, kind)
    return out


def labelled_kind(label: Column) -> Column:
    """The kind that a reporter's own word for it means, or other."""
    word, out = F.replace(F.lower(label), F.lit(" "), F.lit("_")), F.when(F.lit(False), "")
    for kind, words in LABELS.items():
        out = out.when(word.isin(words), kind)
    return out.otherwise("other")


def _short(number: Column) -> Column:
    """A decimal number with six significant digits, as printf's %g writes it."""
    x = number.cast("double")
    size = F.floor(F.log10(F.greatest(x, F.lit(1e-300))))
    mantissa = lambda t: F.regexp_replace(t, r"\.?0+(?=e|$)", "")
    far = mantissa(F.format_string("%.5e", x))
    # Rounded to five places behind the first digit by way of its scientific form.
    near = F.regexp_replace(F.format_string("%.5e", x).cast("double").cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, "0").when((size < -4) | (size >= 6), far).otherwise(near)


def figures(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda n: F.when(n.contains("."), _short(n)).otherwise(n))


def refutes_itself(detail: Column) -> Column:
    """Whether the number right of the last = stands left of it too."""
    left, right = F.regexp_extract(detail, r"(?s)^(.*)=", 1), F.regexp_extract(detail, r"(?s)=([^=]*)$", 1)
    first = F.get(figures(right), F.lit(0))
    return F.coalesce(F.contains(detail, F.lit("=")) & F.array_contains(figures(left), first), F.lit(False))


def signature(detail: Column, numbers: Column) -> Column:
    """What makes two findings one: their sorted figures, else their first long words."""
    words = F.filter(F.split(F.lower(detail), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) > 3)
    return F.when(F.size(numbers) > 0, F.array_join(numbers, " ")).otherwise(F.array_join(F.slice(F.array_sort(words), F.lit(1), F.lit(8)), " "))


def vetted(reported: DataFrame) -> DataFrame:
    """Reported findings (document_id, position, detail and, if there is one, label) worth showing.

    Those labelled impossible_date come first, all of them. Of the others those of 8 to 300 characters that don't refute
    themselves, the first of each signature, and PER_DOCUMENT of a document at most. What the detail says decides on the
    kind, then the label.
    """
    label = F.col("label") if "label" in reported.columns else F.lit(None).cast("string")
    sure, d = F.col("sure"), F.col("detail")
    rows = reported.select("document_id", "position", "detail", label.alias("label")).withColumn("sure", F.coalesce(F.col("label") == "impossible_date", F.lit(False)))
    # One pass over all, in which what is sure passes every test.
    rows = rows.withColumn("detail", F.when(sure, d).otherwise(T.trimmed(d)))
    rows = rows.where(sure | (F.length(d).between(8, 300) & ~refutes_itself(d)))
    rows = rows.withColumn("numbers", F.when(~sure, F.array_sort(figures(d))))
    rows = rows.withColumn("signature", F.when(~sure, signature(d, F.col("numbers")))).drop("numbers")
    first = F.row_number().over(Window.partitionBy("document_id", "sure", "signature").orderBy("position"))
    rows = rows.withColumn("first", first).where(sure | (F.col("first") == 1))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "sure").orderBy("position"))).where(sure | (F.col("nth") <= PER_DOCUMENT))
    kind = F.when(sure, "impossibleDate").otherwise(F.coalesce(finding_kind(d), labelled_kind(F.col("label"))))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("sure"), "position"))
    return rows.select("document_id", place.alias("place"), kind.alias("kind"), "detail")


def flagged(findings: DataFrame, limit: int = 200) -> DataFrame:
    """document_id, findings (how many) and details of the documents with most findings (document_id, detail), most first,
    ties by id; `limit` documents at most."""
    # Findings are made once: no list of details is longer than the longest of the result, so that all may be gathered.
    each = findings.groupBy("document_id").agg(F.count(F.lit(1)).alias("findings"), F.collect_list("detail").alias("details"))
    top = each.orderBy(F.desc("findings"), "document_id").limit(limit)
    return top.select("document_id", "findings", F.array_sort("details").alias("details")).orderBy(F.desc("findings"), "document_id")


def derived_deadlines(dates: DataFrame, notices: DataFrame) -> DataFrame:
    """notice_deadline: the notice period (document_id, notice_days) counted back from the first end of a term."""
    ends = dates.where(F.col("kind").isin("term_end", "expires")).groupBy("document_id").agg(F.min_by("date", "position").alias("end"))
    return ends.join(notices.where("notice_days > 0"), "document_id").select("document_id", F.lit("notice_deadline").alias("kind"), F.date_sub("end", F.col("notice_days")).alias("date"), F.lit(True).alias("derived"))


def commitments(dates: DataFrame, findings: DataFrame, states: DataFrame, now: str, back: int = 120, ahead: int = 365, settled: bool = False) -> DataFrame:
    """The agenda on a day: dates around it that ask for something, and findings to check, without what was done or set
    aside, in order of horizon, day, kind and title."""
    today = F.lit(now).cast("date")
    inside = F.col("date").between(F.date_sub(today, back), F.date_add(today, ahead)) & ~D.is_record_keeping(F.col("kind"))
    dated = dates.where(inside).select(D.task_key(F.col("document_id"), F.col("kind"), F.col("date")).alias("key"), "document_id", "title", F.col("date").alias("due"), D.commitment_kind(F.col("kind")).alias("kind"))
    checks = findings.select(F.concat_ws(":", F.lit("a"), F.col("document_id").cast("string"), "kind", D.stable_hash(F.col("detail"))).alias("key"), "document_id", F.col("detail").alias("title"), F.lit(None).cast("date").alias("due"), F.lit("check").alias("kind"))
    # Of dates with one key the first title in the alphabet stays.
    kept = dated.union(checks).groupBy("key", "document_id", "due", "kind").agg(F.min("title").alias("title")).select("key", "document_id", "title", "due", "kind")
    items = kept.join(states, "key", "left")
    if not settled:
        items = items.where(F.col("done_at").isNull() & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= today)))
    items = items.withColumn("horizon", D.horizon(F.col("due"), today))
    rank = lambda c, values: F.array_position(F.array(*map(F.lit, values)), c)
    return items.select("key", "document_id", "title", "due", "kind", "horizon").orderBy(rank(F.col("horizon"), D.HORIZONS), F.col("due").asc_nulls_last(), rank(F.col("kind"), list(D.WEIGHTS)), "title")


def task_states(decisions: DataFrame) -> DataFrame:
    """The latest decision of each key (key, at, action, until): done clears a snooze, undo clears both."""
    last = decisions.groupBy("key").agg(F.max_by(F.struct("action", "at", "until"), F.struct("at", "action")).alias("d"))
    done, asleep = F.col("d.action") == "done", F.col("d.action") == "snooze"
    return last.select("key", F.when(done, F.col("d.at")).alias("done_at"), F.when(asleep, F.col("d.until")).alias("snoozed_until"), F.col("d.at").alias("decided_at"))


def pruned(states: DataFrame, live: DataFrame) -> DataFrame:
    """Decisions whose key is live, and all finished ones."""
    gone = states.join(live.select("key").distinct(), "key", "left_anti").where("done_at IS NULL").select("key")
    return states.join(gone, "key", "left_anti")


def profile(facts: DataFrame) -> DataFrame:
    """Of each subject and predicate the current value and the history of other ones, newest first.

    Facts have id, subject_id, predicate, value, since, until, asserted_on. Standing facts go before ended ones, later
    ones before earlier, undated ones last, ties by id. Values that differ in case only are one. `effective` is when the
    current value began, and when others ended or, if that isn't known, began.
    """
    effective = F.coalesce("since", "asserted_on")
    rows = facts.withColumn("standing", F.col("until").isNull()).withColumn("began", effective)
    rank = F.struct(F.col("standing"), F.coalesce("began", F.lit("0001-01-01").cast("date")).alias("began"), (-F.col("id")).alias("id"))
    first = rows.groupBy("subject_id", "predicate", F.lower("value").alias("low")).agg(F.max_by(F.struct("value", "until", "began"), rank).alias("f"), F.max(rank).alias("rank"))
    order = Window.partitionBy("subject_id", "predicate").orderBy(F.desc("rank"))
    placed = first.withColumn("place", F.row_number().over(order))
    now = F.col("place") == 1
    return placed.select("subject_id", "predicate", F.col("f.value").alias("value"), F.when(now, F.col("f.began")).otherwise(F.coalesce("f.until", "f.began")).alias("effective"), "place", now.alias("is_current"))


#: What facts may say, and which of them name another entity.
PREDICATES = ("works_at", "role", "email", "phone", "located_in", "related_to", "owns", "member_of")
OF_ENTITIES = ("works_at", "located_in", "related_to", "owns", "member_of")


def admitted(proposed: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed facts (document_id, subject, predicate, object) with predicate and object as they are kept, subject_id, and
    object_id or object_value; or why one is refused: the first of an unknown subject, an unknown predicate, an object that
    is empty or longer than 120 characters, one that the document (`texts`: document_id, text) doesn't have, one that must
    be an entity and isn't, and one that is the subject itself.

    `known` are the document's entities by normalized name (document_id, name, entity_id); of two with one name the smaller
    id counts. Null subjects and objects count as empty. Repeated rows stay.
    """
    names = known.groupBy("document_id", "name").agg(F.min("entity_id").alias("entity_id"))
    named = lambda n, id: names.select("document_id", F.col("name").alias(n), F.col("entity_id").alias(id))
    kept = lambda c: T.trimmed(F.coalesce(F.col(c), F.lit("")))
    rows = proposed.select("document_id", kept("subject").alias("subject"), F.lower(kept("predicate")).alias("predicate"), kept("object").alias("object"))
    rows = rows.withColumns({"__subject": N.normalized(F.col("subject")), "__object": N.normalized(F.col("object"))})
    rows = rows.join(named("__subject", "subject_id"), ["document_id", "__subject"], "left").join(named("__object", "object_id"), ["document_id", "__object"], "left").join(texts.select("document_id", "text"), "document_id", "left")
    text, value, entity = F.lower("text"), F.lower("object"), F.col("predicate").isin(*OF_ENTITIES)
    loose = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    appears = text.contains(value) | ((F.length(loose(value)) >= 3) & loose(text).contains(loose(value)))
    reason = (
        F.when(F.col("subject_id").isNull(), "unknown subject")
        .when(~F.col("predicate").isin(*PREDICATES), "unknown predicate")
        .when(~F.length("object").between(1, 120), "object length")
        .when(~F.coalesce(appears, F.lit(False)), "not in the document")
        .when(entity & F.col("object_id").isNull(), "unknown object")
        .when(entity & (F.col("object_id") == F.col("subject_id")), "itself")
    )
    plain = F.when(F.col("predicate").isin("email", "phone"), value).otherwise(F.col("object"))
    rows = rows.withColumn("refused", reason)
    fine = F.col("refused").isNull()
    return rows.select("document_id", "subject", "predicate", "object", F.when(fine, F.col("subject_id")).alias("subject_id"), F.when(fine & entity, F.col("object_id")).alias("object_id"), F.when(fine & ~entity, plain).alias("object_value"), "refused")


NUMBERED = r"(?s)^(.*?)( \(\d+\))*(\.[^.]*)?$"


def unique_names(names: DataFrame) -> DataFrame:
    """Names (id, name) in order of id, case aside: one that an earlier row has taken gets the first of (2), (3), ... before
    its extension that none has. Rows with a null name or id are left out.

    Names can only clash within a family, which differ by such numbers at their end. Families that arrive without
    numbers, as nearly all do, are numbered by rank, in ranges of ids, so that a name that many rows have is no single
    task's work. Others are walked in order, each by one task that holds its numbered arrivals.
    """
    lower = F.lower("name")
    family = F.concat_ws("\n", F.regexp_extract(lower, NUMBERED, 1), F.regexp_extract(lower, NUMBERED, 3))
    rows = names.where("id IS NOT NULL AND name IS NOT NULL").select("id", "name", family.alias("family"), (F.regexp_extract(lower, NUMBERED, 2) != "").alias("odd"))
    odd = rows.where("odd").select("family").distinct()
    plain, rest = rows.join(odd, "family", "left_anti"), rows.join(odd, "family", "left_semi")
    stem, ext = F.regexp_replace("name", r"(\.[^.]*)$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    again = F.concat(stem, F.lit(" ("), F.col("place").cast("string"), F.lit(")"), ext)
    plain = ranked(plain.select("id", "name", "family"), "family", "id").select("id", F.when(F.col("place") == 1, F.col("name")).otherwise(again).alias("unique_name"))
    walked = rest.select("family", "id", "name").repartition("family").sortWithinPartitions("family", "id").mapInArrow(_walked, f"id {names.schema['id'].dataType.simpleString()}, unique_name string")
    return plain.union(walked)


def _walked(batches):
    family, taken, next_number = None, set(), {}
    for batch in batches:
        out = []
        for f, name in zip(batch.column("family").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if f != family:
                family, taken, next_number = f, set(), {}
            if name.lower() in taken:
                dot = name.rfind(".")
                stem, ext = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
                key, k = name.lower(), next_number.get(name.lower(), 2)
                while f"{stem} ({k}){ext}".lower() in taken:
                    k += 1
                # Lower numbers stay taken, so the next search goes on from here.
                next_number[key], name = k + 1, f"{stem} ({k}){ext}"
            taken.add(name.lower())
            out.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "unique_name"])


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds place, from 1: a row's rank by `order` within its `key`. Ranges of (key, order) are counted, so rows of one key
    can be in many tasks."""
    dealt = checkpointed(rows.repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(counts.withColumn("__before", before), [key, "__range"])
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(order))
    return dealt.select(*rows.columns, (within + F.col("__before")).alias("place"))


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space among them if there is one."""
    head = F.substring(text, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(cut, r"^[ .,;:\-—]+|[ .,;:\-—]+$", ""))


def proposed_name(day: Column, subject: Column, party: Column, extension: str) -> Column:
    """`[date ]subject[ — party].ext`: the party only if neither holds the other, the subject of 96 characters at most."""
    s = T.squeezed(F.regexp_replace(subject, r"[/\\:]", " "))
    s = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(truncated(s, 96), F.lit(2), F.lit(95)))
    p = truncated(T.squeezed(party), 44)
    apart = p.isNotNull() & ~F.lower(s).contains(F.lower(p)) & ~F.lower(p).contains(F.lower(s))
    return F.concat(F.coalesce(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ")), F.lit("")), s, F.when(apart, F.concat(F.lit(" — "), p)).otherwise(""), F.lit(extension))
