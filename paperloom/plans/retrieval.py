"""Search, question retrieval, citations and listings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import retrieval
from paperloom.plans.reading import table
from paperloom.registry import query

SPLIT = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')"
#: The words that have the stems of the queries below, as the test tables have them.
FORMS = {
    "licens": "licens license licensed licenses licensing",
    "work": "work works worked working",
    "agreement": "agreement agreements",
    "tenant": "tenant tenants",
}


def bm25(terms: list[str], source: str = "SELECT doc_id, text FROM documents") -> str:
    forms = ", ".join(f"('{w}', '{t}')" for t in terms for w in FORMS[t].split())
    return f"""WITH src AS ({source}), tok AS (SELECT doc_id, {SPLIT} AS w FROM src), corp AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
stems(token, term) AS (VALUES {forms}),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM tok) JOIN stems USING (token) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), parts AS (SELECT doc_id, tf, len, mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM post JOIN df USING (term), corp),
scored AS (SELECT doc_id, count(*) AS matched, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM parts GROUP BY doc_id)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _index(df, sf_dir: str, name: str) -> retrieval.Index:
    """The written index of a table; queries on one table share it."""
    return retrieval.written(df, f"{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


@query(bm25(["licens", "work"]) + " SELECT doc_id, score FROM scored WHERE matched = 2 ORDER BY score, doc_id LIMIT 20")
def full_text_search(spark, sf_dir):
    """The best documents with a form of each word."""
    return retrieval.search(_index(documents(spark, sf_dir), sf_dir, "documents"), "Licensing works")


@query(bm25(["licens", "agreement", "tenant"]) + ", m AS (SELECT count(*) AS k FROM scored WHERE matched = 3) SELECT doc_id, matched, score FROM scored, m WHERE k = 0 OR matched = 3 ORDER BY score, doc_id LIMIT 10")
def question_retrieval(spark, sf_dir):
    """A form of each content word of a question, or else of any."""
    row = spark.range(1).select(T.content_words(F.lit("What does the licensing agreement tell about the tenant?")).alias("w")).first()
    return retrieval.retrieve(_index(documents(spark, sf_dir), sf_dir, "documents"), " ".join(row["w"]))


@query("SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.QUESTION_WORDS) + ")) AS words FROM benchmark")
def content_words(spark, sf_dir):
    """C32."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.content_words(F.col("text")).alias("words"))


def _layer_sql(name: str, source: str, terms: list[str]) -> str:
    """The ten best documents of a layer that hold all terms, as a subquery."""
    return f"{name} AS (SELECT * FROM ({bm25(terms, source)} SELECT doc_id, score FROM scored WHERE matched = {len(terms)} ORDER BY score, doc_id LIMIT 20))"


RECORDS = "SELECT doc_id, lang || ' ' || source || ' ' || text AS text FROM documents JOIN labels USING (doc_id) WHERE quality = 1"


@query("WITH " + _layer_sql("a", RECORDS, ["licens", "work"]) + ", " + _layer_sql("b", "SELECT doc_id, text FROM documents", ["licens", "work"]) + """, u AS (SELECT doc_id, score, 0 AS layer FROM a UNION ALL SELECT doc_id, score, 1 FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY layer, score) AS k FROM u)
SELECT doc_id, layer, score FROM p WHERE k = 1 ORDER BY layer, score, doc_id LIMIT 20""")
def layered_search(spark, sf_dir):
    """The best records by what was understood of them, then the best texts, each document once."""
    d = table(spark, sf_dir, "documents")
    understood = d.select("doc_id", F.concat_ws(" ", "lang", "source", "text").alias("text"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    # All texts are indexed, since it takes less to narrow what is found than to send texts where labels are.
    layers = [retrieval.search(_index(x, sf_dir, n), "licensed work", within=w) for x, n, w in ((understood, "understood", good), (d.select("doc_id", "text"), "documents", None))]
    return retrieval.layered(layers)


@query("""WITH m AS (SELECT c_custkey AS entity_id, c_mktsegment AS surface FROM customer), n AS (SELECT c_custkey AS entity_id, c_name AS name FROM customer)
SELECT entity_id, name, contains(lower(name), '5') AS direct FROM n WHERE contains(lower(name), '5') UNION SELECT entity_id, name, false FROM n WHERE NOT contains(lower(name), '5') AND entity_id IN (SELECT entity_id FROM m WHERE contains(lower(surface), '5'))""")
def people_lookup(spark, sf_dir):
    """People by any spelling."""
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return retrieval.people(names, c.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("surface")), "5")


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS answer_id, text || ' See [d' || (conv_id % 9) || ':e1], (d' || length(text) || ':e' || (turn % 4) || '); D' || (conv_id % 9) || ':E1.' AS text FROM conversations),
t AS (SELECT answer_id, unnest(regexp_extract_all(text, 'd\\d+:e\\d+')) AS token FROM c), u AS (SELECT DISTINCT answer_id, token, CAST(regexp_extract(token, 'd(\\d+)', 1) AS BIGINT) AS document_id, regexp_extract(token, ':(e\\d+)', 1) AS tag FROM t)
SELECT answer_id, token, document_id, tag, NOT (document_id IN (SELECT doc_id FROM documents) AND tag IN ('e0', 'e1')) AS invented FROM u""")
def verified_citations(spark, sf_dir):
    """Citations in all turns held against the elements that were consulted."""
    c = table(spark, sf_dir, "conversations")
    s = lambda x: x.cast("string")
    text = F.concat("text", F.lit(" See [d"), s(F.col("conv_id") % 9), F.lit(":e1], (d"), s(F.length("text")), F.lit(":e"), s(F.col("turn") % 4), F.lit("); D"), s(F.col("conv_id") % 9), F.lit(":E1."))
    consulted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("tag"))
    return retrieval.verified(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), text.alias("text")), consulted)


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, text, lang, source FROM documents) SELECT rank, doc_id, '[d' || doc_id || ']' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || CASE WHEN rank <= 3 THEN chr(10) || substr(text, 1, 3000) ELSE '' END AS material FROM h WHERE rank <= 10""")
def answer_material(spark, sf_dir):
    """What an answer is written from."""
    d = table(spark, sf_dir, "documents")
    top = d.orderBy(F.desc("n_chars"), "doc_id").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    fields = d.select("doc_id", F.explode(F.array(F.struct(F.lit("lang").alias("name"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("name"), F.col("source").alias("value")))).alias("f")).select("doc_id", "f.name", "f.value")
    return retrieval.material(top.select("doc_id", "rank"), fields, d.select("doc_id", "text"))


@query("""WITH c AS (SELECT doc_id, lower(substr(text, 1, 3000)) AS t FROM documents), n AS (SELECT doc_id, unnest(['are', 'es', 'ing', 'und']) AS c, (length(t) - length(replace(t, unnest(['are', 'es', 'ing', 'und']), ''))) / length(unnest(['are', 'es', 'ing', 'und'])) AS k FROM c) SELECT doc_id, CASE WHEN max(k) > 0 THEN arg_min(c, (-k, c)) END AS category, max(k) > 0 AS found FROM n GROUP BY doc_id""")
def likely_categories(spark, sf_dir):
    """The category that a text names most, in 3,000 characters as in the SQL."""
    d = table(spark, sf_dir, "documents")
    c = retrieval.likely_category(F.col("text"), ["are", "es", "ing", "und"], considered=3000)
    return d.select("doc_id", c.alias("category"), c.isNotNull().alias("found"))


@query("SELECT doc_id, substr(text, greatest(instr(lower(text), 'the') - 30, 1), 120) AS snippet FROM documents WHERE instr(lower(text), 'the') > 0")
def snippets(spark, sf_dir):
    """A text around the first match."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("the")).alias("snippet")).where("snippet IS NOT NULL")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_records(spark, sf_dir):
    """The newest records."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query("""WITH r AS (SELECT lang, count(*) AS reach FROM documents GROUP BY lang ORDER BY reach DESC, lang LIMIT 3) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT list(lang ORDER BY reach DESC, lang) FROM r) AS known_for""")
def empty_result_guidance(spark, sf_dir):
    """What to say when nothing matched."""
    d = table(spark, sf_dir, "documents")
    top = d.groupBy("lang").agg(F.count(F.lit(1)).alias("reach")).orderBy(F.desc("reach"), "lang").limit(3)
    names = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("reach")).alias("r"), "lang"))), lambda x: x["lang"]).alias("known_for"))
    return d.agg(F.count(F.lit(1)).alias("documents")).join(names)


@query("""WITH p AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY lang) SELECT lang, 'Categories: ' || array_to_string(s, ', ') || chr(10) || 'Known fields: lang, source' AS prompt FROM p""")
def prompts(spark, sf_dir):
    """What a model is told of the library."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return d.select("lang", F.concat(F.lit("Categories: "), F.array_join("s", ", "), F.lit("\nKnown fields: lang, source")).alias("prompt"))


@query("""SELECT doc_id, 'Document ' || doc_id || ' ' || lang || ' Document ' || doc_id || ' ' || lang || ' Document ' || doc_id || ' ' || lang || ' source ' || source || ' ' || text AS comparable FROM documents""")
def comparable_texts(spark, sf_dir):
    """What a document is about, title and kind three times."""
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", *[title, F.col("lang")] * 3, F.lit("source"), "source", "text").alias("comparable"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '[d' || doc_id || ':e1]' WHEN 1 THEN ' (D' || doc_id || ':e2) ' WHEN 2 THEN doc_id || ':e3' WHEN 3 THEN 'd' || doc_id ELSE lang || ':x:y' END AS cite FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN doc_id END AS document_id, CASE doc_id % 5 WHEN 0 THEN 'e1' WHEN 1 THEN 'e2' WHEN 2 THEN 'e3' WHEN 4 THEN 'x:y' END AS tag, 'See [d' || doc_id || ':e' || doc_id || '], [e], [d1:e2].' AS rewritten FROM c""")
def citation_parts(spark, sf_dir):
    """Citations taken apart, and anchors that carry their document."""
    n, id = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    cite = F.when(n == 0, F.concat(F.lit("[d"), id, F.lit(":e1]"))).when(n == 1, F.concat(F.lit(" (D"), id, F.lit(":e2) "))).when(n == 2, F.concat(id, F.lit(":e3"))).when(n == 3, F.concat(F.lit("d"), id)).otherwise(F.concat("lang", F.lit(":x:y")))
    document, tag = T.cited(cite)
    rewritten = T.owned_anchors(F.concat(F.lit("See [e"), id, F.lit("], [e], [d1:e2].")), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", document.alias("document_id"), tag.alias("tag"), rewritten.alias("rewritten"))
