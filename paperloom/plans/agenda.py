"""Dates, findings, facts, names and what a person decided."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.operators import agenda
from paperloom.plans.identity import _normal_sql
from paperloom.plans.reading import table
from paperloom.registry import query
from paperloom.session import checkpointed, new_table
from paperloom.streaming import reminders

NOW = "2024-01-15"
KINDS_SQL = "list_extract(['payment due', 'call back', 'signed', 'term_end', 'ship_by', 'rsvp', 'expires', 'review'], CAST(event_id % 8 + 1 AS INTEGER))"
DATES_SQL = f"WITH dates AS (SELECT event_id AS document_id, {KINDS_SQL} AS kind, CAST(ts AS DATE) AS date, 'Event ' || event_id AS title FROM events)"
COMMIT_SQL = "CASE WHEN kind IN ('call back') THEN 'meeting' WHEN kind = 'payment due' THEN 'payment' WHEN kind = 'rsvp' THEN 'reply' WHEN kind = 'ship_by' THEN 'milestone' ELSE 'deadline' END"
KEY_SQL = "'d:' || document_id || ':' || replace(kind, ' ', '_') || ':' || strftime(date, '%Y%m%d')"


def dates(spark, sf_dir):
    kinds = ["payment due", "call back", "signed", "term_end", "ship_by", "rsvp", "expires", "review"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), kind.alias("kind"), F.to_date("ts").alias("date"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d') WHEN 2 THEN strftime(ts, '%m/%d/%Y') WHEN 3 THEN strftime(ts, '%B') || ' ' || day(ts) || ', ' || year(ts) WHEN 4 THEN strftime(ts, '%b') || ' ' || day(ts) || ', ' || year(ts) WHEN 5 THEN strftime(ts, '%Y-%m') WHEN 6 THEN strftime(ts, '%Y') WHEN 7 THEN '  ' || strftime(ts, '%Y-%m-%d') || ' ' ELSE 'soon' END AS text, CAST(ts AS DATE) AS d FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 9 = 5 THEN date_trunc('month', d) WHEN event_id % 9 = 6 THEN date_trunc('year', d) ELSE d END AS DATE) AS day, CASE WHEN event_id % 9 = 8 THEN NULL ELSE true END AS plausible FROM t""")
def parsed_dates(spark, sf_dir):
    """C11: dates by the first pattern that fits."""
    f = lambda p: F.date_format("ts", p)
    n = F.col("event_id") % 9
    text = F.when(n == 0, f("yyyy-MM-dd")).when(n == 1, f("yyyy/MM/dd")).when(n == 2, f("MM/dd/yyyy")).when(n == 3, f("MMMM d, yyyy")).when(n == 4, f("MMM d, yyyy")).when(n == 5, f("yyyy-MM")).when(n == 6, f("yyyy")).when(n == 7, F.concat(F.lit("  "), f("yyyy-MM-dd"), F.lit(" "))).otherwise("soon")
    day = D.parsed(text)
    return table(spark, sf_dir, "events").select("event_id", day.alias("day"), D.plausible(day, F.lit(NOW).cast("date")).alias("plausible"))


@query(DATES_SQL + f" SELECT document_id, {COMMIT_SQL} AS commitment, kind = 'signed' AS record_keeping, {KEY_SQL} AS key, CASE WHEN date < DATE '{NOW}' THEN 'overdue' WHEN date = DATE '{NOW}' THEN 'today' WHEN date - DATE '{NOW}' = 1 THEN 'tomorrow' WHEN date - DATE '{NOW}' <= 7 THEN 'thisWeek' ELSE 'later' END AS horizon FROM dates")
def commitment_kinds(spark, sf_dir):
    """Kinds, horizons and stable keys of dates."""
    d = dates(spark, sf_dir)
    today = F.lit(NOW).cast("date")
    return d.select("document_id", D.commitment_kind(F.col("kind")).alias("commitment"), D.is_record_keeping(F.col("kind")).alias("record_keeping"), D.task_key(F.col("document_id"), F.col("kind"), F.col("date")).alias("key"), D.horizon(F.col("date"), today).alias("horizon"))


@query(DATES_SQL + f" SELECT document_id, kind, date FROM dates WHERE date BETWEEN DATE '{NOW}' AND DATE '{NOW}' + 7")
def upcoming(spark, sf_dir):
    """What falls within the next days."""
    today = F.lit(NOW).cast("date")
    return dates(spark, sf_dir).where(F.col("date").between(today, F.date_add(today, 7))).select("document_id", "kind", "date").orderBy("date", "document_id")


def _hash_sql(text: str) -> str:
    """64-bit FNV-1a in base 36, in two parts since only signed numbers are converted."""
    hash = f"list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
    return f"lower(ltrim(to_base(CAST({hash} // 2176782336 AS BIGINT), 36) || lpad(to_base(CAST({hash} % 2176782336 AS BIGINT), 36), 6, '0'), '0'))"


STATES_SQL = f", raw AS (SELECT {KEY_SQL} AS key, e.ts AS made, CASE e.event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'snooze' ELSE 'undo' END AS action, CAST(e.ts AS DATE) + 20 AS until FROM dates d JOIN events e ON e.event_id = d.document_id), newest AS (SELECT key, arg_max((action, made, until), (made, action)) AS d FROM raw GROUP BY key), states AS (SELECT key, CASE WHEN d[1] = 'done' THEN d[2] END AS done_at, CASE WHEN d[1] = 'snooze' THEN d[3] END AS snoozed_until, d[2] AS decided_at FROM newest)"


def decisions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "snooze").otherwise("undo")
    d = dates(spark, sf_dir).select("document_id", D.task_key(F.col("document_id"), F.col("kind"), F.col("date")).alias("key"))
    return e.join(d, F.col("event_id") == F.col("document_id")).select("key", F.col("ts").alias("at"), action.alias("action"), F.date_add(F.to_date("ts"), 20).alias("until"))


def states(spark, sf_dir):
    return agenda.task_states(decisions(spark, sf_dir))


@query(DATES_SQL + STATES_SQL + " SELECT key, done_at, snoozed_until, decided_at FROM states")
def task_states(spark, sf_dir):
    """The latest decision on each task."""
    return states(spark, sf_dir)


@query(DATES_SQL + STATES_SQL + " SELECT key, snoozed_until AS day, decided_at FROM states WHERE snoozed_until <= (SELECT max(made) - INTERVAL 1 HOUR FROM raw)")
def returned_tasks(spark, sf_dir):
    """K02 on a stream: put-off tasks that have come back by the end of the log, from timers; the log is one batch."""
    log, out = checkpointed(decisions(spark, sf_dir)), new_table(spark)
    for name, value in reminders.STATE_STORE.items():
        spark.conf.set(name, value)
    stream = spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rsplit("/", 1)[0])
    back = reminders.returning(stream).writeStream.format("parquet").option("path", f"{out}/back").option("checkpointLocation", f"{out}/state")
    back.trigger(availableNow=True).start().awaitTermination()
    for name in reminders.STATE_STORE:
        spark.conf.unset(name)
    return spark.read.schema("key string, day date, decided_at timestamp").parquet(f"{out}/back")


@query(DATES_SQL + STATES_SQL + f" SELECT key, done_at, snoozed_until, decided_at FROM states WHERE done_at IS NOT NULL OR key IN (SELECT {KEY_SQL} FROM dates WHERE date >= DATE '{NOW}')")
def pruned_states(spark, sf_dir):
    """Decisions on tasks that are gone, here past ones, go; finished ones stay."""
    live = dates(spark, sf_dir).where(F.col("date") >= F.lit(NOW).cast("date")).select(D.task_key(F.col("document_id"), F.col("kind"), F.col("date")).alias("key"))
    return agenda.pruned(states(spark, sf_dir), live)


ORDERED_SQL = "od AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS early FROM orders), sd AS (SELECT l_orderkey AS document_id, max(CAST(l_shipdate AS DATE)) AS late FROM lineitem GROUP BY 1), found AS (SELECT document_id, 'dateOrder' AS kind, 'Shipping was due before the order was placed — ship_by ' || strftime(late, '%Y-%m-%d') || ' is before order_date ' || strftime(early, '%Y-%m-%d') || '.' AS detail FROM od JOIN sd USING (document_id) WHERE late < early)"


def record_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("order_date").alias("kind"), F.to_date("o_orderdate").alias("date"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("ship_by").alias("kind"), F.to_date("l_shipdate").alias("date"))
    return o.union(l).withColumn("derived", F.lit(False))


@query("WITH " + ORDERED_SQL + " SELECT * FROM found")
def date_orders(spark, sf_dir):
    """Dates in an impossible order."""
    return agenda.date_orders(record_dates(spark, sf_dir))


@query(DATES_SQL + STATES_SQL + ", " + ORDERED_SQL + f""", items AS (SELECT {KEY_SQL} AS key, document_id, title, date AS due, {COMMIT_SQL} AS kind FROM dates WHERE date BETWEEN DATE '{NOW}' - 120 AND DATE '{NOW}' + 365 AND kind <> 'signed' UNION SELECT 'a:' || document_id || ':' || kind || ':' || {_hash_sql('detail')}, document_id, detail, NULL, 'check' FROM found)
SELECT items.key, document_id, title, due, kind, CASE WHEN due IS NULL THEN 'someday' WHEN due < DATE '{NOW}' THEN 'overdue' WHEN due = DATE '{NOW}' THEN 'today' WHEN due - DATE '{NOW}' = 1 THEN 'tomorrow' WHEN due - DATE '{NOW}' <= 7 THEN 'thisWeek' ELSE 'later' END AS horizon
FROM items LEFT JOIN states ON states.key = items.key WHERE done_at IS NULL AND (snoozed_until IS NULL OR snoozed_until <= DATE '{NOW}')""")
def agenda_items(spark, sf_dir):
    """The agenda on a day."""
    return agenda.commitments(dates(spark, sf_dir), agenda.date_orders(record_dates(spark, sf_dir)), states(spark, sf_dir), NOW)


REPORTED_SQL = """r AS (SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, l_partkey AS n, l_quantity AS q FROM lineitem),
reported AS (SELECT document_id, position, CASE n % 10 WHEN 0 THEN 'Part ' || n || ' appears twice' WHEN 1 THEN 'Total ' || n || ' does not match (5 + 5 = ' || n || ')' WHEN 2 THEN 'The sum of ' || n || '.50 should be 1,2' WHEN 3 THEN 'short' WHEN 4 THEN '  Word is misspelt here ' WHEN 5 THEN 'Stated as red but elsewhere blue' WHEN 7 THEN 'Two dates on row ' || n WHEN 8 THEN 'bad' ELSE 'Something odd about this row' END AS detail,
 CASE n % 10 WHEN 6 THEN 'Sum mismatch' WHEN 7 THEN 'FORMAT' WHEN 8 THEN 'impossible_date' WHEN 9 THEN NULL WHEN 0 THEN 'typo' ELSE 'whatever' END AS label FROM r),
k AS (SELECT document_id, position, trim(detail) AS detail, CASE n % 10 WHEN 0 THEN 'duplicate' WHEN 2 THEN 'arithmetic' WHEN 4 THEN 'typo' WHEN 5 THEN 'contradiction' WHEN 6 THEN 'arithmetic' WHEN 7 THEN 'inconsistentFormat' ELSE 'other' END AS kind,
 CASE n % 10 WHEN 2 THEN array_to_string(list_sort(['12', n || '.5']), ' ') WHEN 0 THEN CAST(n AS VARCHAR) WHEN 7 THEN CAST(n AS VARCHAR) ELSE detail END AS sig FROM (SELECT reported.*, r.n FROM reported JOIN r USING (document_id, position)) WHERE n % 10 NOT IN (1, 3, 8)),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, sig ORDER BY position) AS first FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS nth FROM f WHERE first = 1),
vetted AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sure, position) AS place, kind, detail FROM (SELECT document_id, position, kind, detail, 1 AS sure FROM p WHERE nth <= 6 UNION ALL SELECT document_id, position, 'impossibleDate', detail, 0 FROM reported WHERE label = 'impossible_date'))"""


def reported(spark, sf_dir):
    order = Window.partitionBy("document_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n, s = F.col("l_partkey") % 10, F.col("l_partkey").cast("string")
    said = {0: F.concat(F.lit("Part "), s, F.lit(" appears twice")), 1: F.concat(F.lit("Total "), s, F.lit(" does not match (5 + 5 = "), s, F.lit(")")), 2: F.concat(F.lit("The sum of "), s, F.lit(".50 should be 1,2")), 3: F.lit("short")}
    said |= {4: F.lit("  Word is misspelt here "), 5: F.lit("Stated as red but elsewhere blue"), 7: F.concat(F.lit("Two dates on row "), s), 8: F.lit("bad")}
    labels = {6: "Sum mismatch", 7: "FORMAT", 8: "impossible_date", 0: "typo"}
    detail, label = F.when(F.lit(False), ""), F.when(n == 9, F.lit(None))
    for k, text in said.items():
        detail = detail.when(n == k, text)
    for k, text in labels.items():
        label = label.when(n == k, text)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    return lines.select("document_id", F.row_number().over(order).alias("position"), detail.otherwise("Something odd about this row").alias("detail"), label.otherwise("whatever").alias("label"))


@query("WITH " + REPORTED_SQL + " SELECT * FROM vetted")
def vetted_findings(spark, sf_dir):
    """Reported findings that are worth showing."""
    return agenda.vetted(reported(spark, sf_dir))


@query("WITH " + ORDERED_SQL + ", " + REPORTED_SQL + """, every AS (SELECT document_id, detail FROM found UNION ALL SELECT document_id, detail FROM vetted), top AS (SELECT document_id, count(*) AS findings FROM every GROUP BY document_id ORDER BY findings DESC, document_id LIMIT 200)
SELECT document_id, findings, list_sort(list(detail)) AS details FROM top JOIN every USING (document_id) GROUP BY ALL""")
def flagged(spark, sf_dir):
    """The documents with most findings, checked and reported."""
    found = agenda.date_orders(record_dates(spark, sf_dir)).select("document_id", "detail")
    return agenda.flagged(found.union(agenda.vetted(reported(spark, sf_dir)).select("document_id", "detail")))


@query("""WITH d AS (SELECT event_id AS document_id, CASE event_id % 3 WHEN 0 THEN 'term_end' WHEN 1 THEN 'expires' ELSE 'signed' END AS kind, CAST(ts AS DATE) AS date, CAST(event_id % 45 AS INTEGER) AS notice_days FROM events)
SELECT document_id, 'notice_deadline' AS kind, date - notice_days AS date, true AS derived FROM d WHERE kind <> 'signed' AND notice_days > 0""")
def derived_deadlines(spark, sf_dir):
    """Deadlines counted back from the end of a term."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "term_end").when(F.col("event_id") % 3 == 1, "expires").otherwise("signed")
    d = e.select(F.col("event_id").alias("document_id"), kind.alias("kind"), F.to_date("ts").alias("date"), F.lit(0).alias("position"))
    return agenda.derived_deadlines(d, e.select(F.col("event_id").alias("document_id"), (F.col("event_id") % 45).cast("int").alias("notice_days")))


@query("""WITH f AS (SELECT event_id AS id, user_id AS subject_id, 'prefers' AS predicate, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS value, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS since, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) + 30 END AS until, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) - 3 END AS asserted_on FROM events),
o AS (SELECT *, until IS NULL AS standing, coalesce(since, asserted_on) AS began FROM f), w AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, lower(value) ORDER BY standing DESC, began DESC NULLS LAST, id) AS k FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY standing DESC, began DESC NULLS LAST, id) AS place FROM w WHERE k = 1)
SELECT subject_id, predicate, value, CASE WHEN place = 1 THEN began ELSE coalesce(until, began) END AS effective, place, place = 1 AS is_current FROM p""")
def profiles(spark, sf_dir):
    """Current values and their history."""
    e, n, day = table(spark, sf_dir, "events"), F.col("event_id"), F.to_date("ts")
    value = F.when(n % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    dates = {"since": F.when(n % 5 != 0, day), "until": F.when(n % 2 == 0, F.date_add(day, 30)), "asserted_on": F.when(n % 4 != 0, F.date_sub(day, 3))}
    return agenda.profile(e.select(n.alias("id"), F.col("user_id").alias("subject_id"), F.lit("prefers").alias("predicate"), value.alias("value"), *(c.alias(k) for k, c in dates.items())))


_WORD = lambda n: f"split_part(text, ' ', {n})"
FACTS_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
    f"p AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'nobody at all' ELSE ' ' || {_WORD(1)} || '.' END AS subject, list_extract(['works_at', ' Role', 'EMAIL', 'phone', 'located_in ', 'invented', 'owns'], CAST(doc_id % 7 + 1 AS INTEGER)) AS predicate, "
    f"CASE doc_id % 8 WHEN 0 THEN {_WORD(2)} WHEN 1 THEN 'zzzz qqqq' WHEN 2 THEN ' ' WHEN 3 THEN {_WORD(1)} WHEN 4 THEN substr(text, 1, 121) ELSE {_WORD(2)} END AS object FROM d), "
    "w AS (SELECT doc_id, 'known' AS role, split_part(text, ' ', i) AS name, i FROM d, (SELECT unnest([1, 2]) AS i) UNION ALL SELECT doc_id, 'subject', regexp_replace(subject, '^\\s+|\\s+$', '', 'g'), 0 FROM p UNION ALL SELECT doc_id, 'object', regexp_replace(object, '^\\s+|\\s+$', '', 'g'), 0 FROM p), "
    + _normal_sql("w", "name", "doc_id, role, i")
    + """, known AS (SELECT doc_id, n, min(doc_id * 10 + i) AS id FROM norm WHERE role = 'known' GROUP BY ALL),
t AS (SELECT p.doc_id AS document_id, text, regexp_replace(subject, '^\\s+|\\s+$', '', 'g') AS subject, lower(regexp_replace(predicate, '^\\s+|\\s+$', '', 'g')) AS predicate, regexp_replace(object, '^\\s+|\\s+$', '', 'g') AS object, s.id AS sid, o.id AS oid FROM p
 JOIN norm x ON x.doc_id = p.doc_id AND x.role = 'subject' LEFT JOIN known s ON s.doc_id = p.doc_id AND s.n = x.n JOIN norm y ON y.doc_id = p.doc_id AND y.role = 'object' LEFT JOIN known o ON o.doc_id = p.doc_id AND o.n = y.n) USING_P
r AS (SELECT *, predicate IN ('works_at', 'located_in', 'related_to', 'owns', 'member_of') AS entity, CASE WHEN sid IS NULL THEN 'unknown subject' WHEN predicate NOT IN ('works_at', 'role', 'email', 'phone', 'located_in', 'related_to', 'owns', 'member_of') THEN 'unknown predicate' WHEN length(object) NOT BETWEEN 1 AND 120 THEN 'object length'
 WHEN NOT (contains(lower(text), lower(object)) OR (length(regexp_replace(lower(object), '[^\\p{L}\\p{N}]', '', 'g')) >= 3 AND contains(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(object), '[^\\p{L}\\p{N}]', '', 'g')))) THEN 'not in the document'
 WHEN predicate IN ('works_at', 'located_in', 'related_to', 'owns', 'member_of') AND oid IS NULL THEN 'unknown object' WHEN predicate IN ('works_at', 'located_in', 'related_to', 'owns', 'member_of') AND oid = sid THEN 'itself' END AS refused FROM t)
SELECT document_id, subject, predicate, object, CASE WHEN refused IS NULL THEN sid END AS subject_id, CASE WHEN refused IS NULL AND entity THEN oid END AS object_id, CASE WHEN refused IS NULL AND NOT entity THEN CASE WHEN predicate IN ('email', 'phone') THEN lower(object) ELSE object END END AS object_value, refused FROM r"""
).replace(" USING_P", ",")


@query(FACTS_SQL)
def admitted_facts(spark, sf_dir):
    """Proposed facts, what they say of whom, and why some are refused."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, word = F.col("document_id"), lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    subject = F.when(n % 5 == 0, "nobody at all").otherwise(F.concat(F.lit(" "), word(1), F.lit(".")))
    predicate = F.element_at(F.array(*map(F.lit, ["works_at", " Role", "EMAIL", "phone", "located_in ", "invented", "owns"])), (n % 7 + 1).cast("int"))
    value = F.when(n % 8 == 1, "zzzz qqqq").when(n % 8 == 2, " ").when(n % 8 == 3, word(1)).when(n % 8 == 4, F.substring("text", 1, 121)).otherwise(word(2))
    known = d.select("document_id", F.posexplode(F.array(word(1), word(2))).alias("i", "name"))
    known = known.select("document_id", N.normalized(F.col("name")).alias("name"), (n * 10 + F.col("i") + 1).alias("entity_id"))
    return agenda.admitted(d.select("document_id", subject.alias("subject"), predicate.alias("predicate"), value.alias("object")), d, known)


def unique_sql(names: str, family: str, ext: str) -> str:
    """Names (id, name) of a CTE source walked one by one, all families at once."""
    stem = f"substr(n.name, 1, length(n.name) - {len(ext)})"
    return f"""WITH RECURSIVE src AS ({names}), n AS (SELECT id, name, {family} AS family, row_number() OVER (PARTITION BY {family} ORDER BY id) AS i FROM src),
walk AS (SELECT i, family, id, name AS unique_name, [lower(name)] AS taken FROM n WHERE i = 1 UNION ALL SELECT i, family, id, u, list_append(taken, lower(u)) FROM (SELECT n.i, n.family, n.id, walk.taken,
 CASE WHEN list_contains(walk.taken, lower(n.name)) THEN list_filter(list_transform(range(2, n.i + 2), lambda k: {stem} || ' (' || k || ')' || substr(n.name, length(n.name) - {len(ext) - 1})), lambda c: NOT list_contains(walk.taken, lower(c)))[1] ELSE n.name END AS u FROM walk JOIN n ON n.family = walk.family AND n.i = walk.i + 1))
SELECT id, unique_name FROM walk"""


@query(unique_sql("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 3 AND length(p_name) % 2 = 0 THEN p_name || ' (' || (p_partkey % 3 + 2) || ').pdf' WHEN p_partkey % 11 = 5 THEN upper(p_name) || '.PDF' ELSE p_name || '.pdf' END AS name FROM part", "regexp_extract(lower(name), '^([a-z]+ [a-z]+)')", ".pdf"))
def unique_names(spark, sf_dir):
    """Display names without repetition, some of which arrive with a number."""
    n, name = F.col("p_partkey"), F.col("p_name")
    numbered = F.concat(name, F.lit(" ("), (n % 3 + 2).cast("string"), F.lit(").pdf"))
    name = F.when((n % 7 == 3) & (F.length(name) % 2 == 0), numbered).when(n % 11 == 5, F.concat(F.upper(name), F.lit(".PDF"))).otherwise(F.concat(name, F.lit(".pdf")))
    return agenda.unique_names(table(spark, sf_dir, "part").select(n.alias("id"), name.alias("name")))


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'order of ' || lower(c_mktsegment) AS s, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS p FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT id, strftime(day, '%Y-%m-%d') || ' ' || upper(substr(s, 1, 1)) || substr(s, 2) || CASE WHEN contains(s, lower(p)) THEN '' ELSE ' — ' || p END || '.pdf' AS name FROM n""")
def document_names(spark, sf_dir):
    """Names derived from a record."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    subject = F.concat(F.lit("order of "), F.lower("c_mktsegment"))
    party = F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return o.select(F.col("o_orderkey").alias("id"), agenda.proposed_name(F.to_date("o_orderdate"), subject, party, ".pdf").alias("name"))


@query("""SELECT DISTINCT p_type AS word, CASE WHEN regexp_matches(lower(p_type), '[^aeiou]y$') THEN substr(lower(p_type), 1, length(p_type) - 1) || 'ies' WHEN regexp_matches(lower(p_type), '(s|x|z|ch|sh)$') THEN lower(p_type) || 'es' ELSE lower(p_type) || 's' END AS plural FROM part""")
def plurals(spark, sf_dir):
    """C39."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("word"), T.plural(F.col("p_type")).alias("plural")).distinct()


@query("SELECT doc_id FROM documents WHERE coalesce(n_chars, 0) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def backlog(spark, sf_dir):
    """Documents that were rendered (not empty) and not yet understood (labelled)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("understood").alias("stage")).distinct()
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("stage", F.coalesce("stage", F.lit("rendered")))
    return d.withColumn("status", F.when(F.coalesce("n_chars", F.lit(0)) > 0, "ok").otherwise("failed")).where("stage = 'rendered' AND status <> 'failed'").select("doc_id")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cascaded(spark, sf_dir):
    """What belongs to deleted documents goes with them."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
