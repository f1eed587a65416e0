"""Replies of a model service, made of documents, some of them damaged; and code in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import replies
from paperloom.plans.reading import table
from paperloom.registry import query

# What documents reply: whole, of wrong types, no JSON, no object, empty, nulls, a bad thing in a list, cut off.
SHAPES = (
    """{"title":"T@","kind":"note","summary":"about #","amount":12.5,"notice_days":30,"fields":[{"name":"a","value":"#"},{"name":" ","value":"x","unit":null}]}""",
    """{"title":5,"kind":["x"],"amount":"12","notice_days":3.5,"currency":"EUR","fields":[{"name":"a","value":"1"},{"name":"b"}],"dates":[{"kind":"due","date":"2024-01-0@"}]}""",
    """no reply to @""",
    """[1, {"title":"@"}]""",
    """{}""",
    """{"title":null,"kind":null,"amount":null,"notice_days":null,"fields":null,"entities":[]}""",
    """{"title":"@","happened_on":"2024-02-03","amount":-3,"notice_days":4.0,"entities":[{"name":"Acme","kind":7}],"assertions":[{"subject":"a","predicate":"b","object":"c","since":"@"}],"problems":[{"kind":"k","detail":"d"},"x"]}""",
    """{"title":"T@","fields":[{"name":"a",""",
)
REPLY_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN replace(replace('{s}', '@', CAST(doc_id % 10 AS VARCHAR)), '#', lang)" for i, s in enumerate(SHAPES)) + " END"
_TEXT = lambda n: f"CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' THEN json_extract_string(j, '$.{n}') END"


def _list_sql(name: str) -> str:
    must, may = replies.LISTS[name]
    fine = " AND ".join(["json_type(x) = 'OBJECT'", *(f"coalesce(json_type(x, '$.{n}'), '') = 'VARCHAR'" for n in must), *(f"coalesce(json_type(x, '$.{n}'), 'NULL') IN ('VARCHAR', 'NULL')" for n in may)])
    shown = " || '~' || ".join(f"coalesce(json_extract_string(x, '$.{n}'), '')" for n in (*must, *may))
    keep = "trim(json_extract_string(x, '$.name')) <> ''" if name == "fields" else "true"
    items = f"CASE WHEN json_type(j, '$.{name}') = 'ARRAY' THEN CAST(json_extract(j, '$.{name}') AS JSON[]) ELSE [] END"
    return f"array_to_string(CASE WHEN len(list_filter({items}, lambda x: NOT ({fine}))) = 0 THEN list_transform(list_filter({items}, lambda x: {keep}), lambda x: {shown}) ELSE [] END, '|') AS {name}"


@query(f"""WITH r AS (SELECT doc_id, {REPLY_SQL} AS reply FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(reply) AND json_type(CASE WHEN json_valid(reply) THEN reply ELSE 'null' END) = 'OBJECT' THEN CAST(reply AS JSON) END AS j FROM r)
SELECT doc_id, j IS NULL AS malformed, coalesce({_TEXT("title")}, '') AS title, {", ".join(f"{_TEXT(n)} AS {n}" for n in replies.TEXTS)},
CASE WHEN json_type(j, '$.amount') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.amount') AS DOUBLE) END AS amount,
CASE WHEN json_type(j, '$.notice_days') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND CAST(json_extract_string(j, '$.notice_days') AS DOUBLE) = floor(CAST(json_extract_string(j, '$.notice_days') AS DOUBLE)) THEN CAST(CAST(json_extract_string(j, '$.notice_days') AS DOUBLE) AS BIGINT) END AS notice_days,
{", ".join(_list_sql(n) for n in replies.LISTS)} FROM v""")
def lenient_replies(spark, sf_dir):
    """Replies of which a bad member costs only itself."""
    d = table(spark, sf_dir, "documents")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % 8 + 1).cast("int"))
    reply = F.replace(F.replace(shape, F.lit("@"), (F.col("doc_id") % 10).cast("string")), F.lit("#"), F.col("lang"))
    out = replies.read(d.select("doc_id", reply.alias("reply"))).drop("reply")
    shown = lambda n: F.array_join(F.transform(n, lambda x: F.concat_ws("~", *(F.coalesce(x[m], F.lit("")) for m in (*replies.LISTS[n][0], *replies.LISTS[n][1])))), "|")
    return out.withColumns({n: shown(n) for n in replies.LISTS})


# Texts with fences: their first words as code of some language, closed or not.
CODE_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'Before' || chr(10) || '```Python' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '  ```' || chr(10) || 'after' WHEN 2 THEN '```' || chr(10) || coalesce(text, '') WHEN 3 THEN coalesce(text, '') || chr(10) || '``` sql ' || chr(10) || '```' ELSE chr(10) || '```x' || chr(10) || 'a' || chr(10) || '```' || chr(10) || ' ' || chr(10) || '```' || chr(10) || '  b' || chr(10) || '```' END AS t FROM documents"""


@query(f"""WITH s AS ({CODE_SQL}), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM s)),
f AS (SELECT *, regexp_matches(line, '^[\\p{{Zs}}\\t]*```') AS fence, CAST(coalesce(sum(CASE WHEN regexp_matches(line, '^[\\p{{Zs}}\\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS INTEGER) AS b FROM l),
n AS (SELECT doc_id, max(b) AS n FROM f GROUP BY doc_id),
p AS (SELECT doc_id, b, max(CASE WHEN fence THEN line END) AS head, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fence), '') AS body FROM f GROUP BY ALL),
k AS (SELECT doc_id, b, CASE WHEN b % 2 = 1 THEN 'code' ELSE 'prose' END AS kind, CASE WHEN b % 2 = 1 THEN nullif(lower(regexp_replace(regexp_replace(head, '^[\\p{{Zs}}\\t]*```', ''), '^[\\p{{Zs}}\\t]+|[\\p{{Zs}}\\t]+$', '', 'g')), '') END AS language,
 CASE WHEN b % 2 = 0 THEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') WHEN regexp_matches(body, '^[\\p{{Zs}}\\t\\n]*$') THEN '' ELSE regexp_replace(regexp_replace(body, '^([\\p{{Zs}}\\t]*\\n)+', ''), '(\\n[\\p{{Zs}}\\t]*)+$', '') END AS text, CASE WHEN b % 2 = 1 THEN b < n END AS closed FROM p JOIN n USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS place, kind, language, sha256(text) AS digest, length(text) AS chars, closed FROM k WHERE kind = 'code' OR text <> ''""")
def fenced_blocks(spark, sf_dir):
    """Prose and code of texts by their fences."""
    t, n, lines = F.coalesce("text", F.lit("")), F.col("doc_id") % 5, lambda *c: F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in c))
    made = F.when(n == 0, t).when(n == 1, lines("Before", "```Python", "", t, "  ```", "after")).when(n == 2, lines("```", t)).when(n == 3, lines(t, "``` sql ", "```")).otherwise(lines("", "```x", "a", "```", " ", "```", "  b", "```"))
    out = replies.blocks(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")), "doc_id", "text")
    return out.select("doc_id", "place", "kind", "language", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"), "closed")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def highlighted_texts(spark, sf_dir):
    """The spans of a text, put together, are the text."""
    d = replies.highlighted(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"), "lang"), "code", "lang")
    return d.select("doc_id", F.sha2(F.array_join(F.transform("spans", lambda s: s["text"]), ""), 256).alias("digest"))
