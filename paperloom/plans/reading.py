"""Reading: intake, blocks, anchors and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import elements
from paperloom.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || sha256(text) || '/' || 'document-' || doc_id || '.txt' AS vault_path FROM documents""")
def content_hash(spark, sf_dir):
    """Content hash and content-addressed path."""
    hash = F.sha2("text", 256)
    name = F.concat(F.lit("document-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", hash.alias("sha256"), F.concat_ws("/", F.substring(hash, 1, 2), hash, name).alias("vault_path"))


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS arrivals FROM documents WHERE length(text) > 0 GROUP BY sha256(text)""")
def idempotent_add(spark, sf_dir):
    """A content is added once, however often it arrives; an empty one is not."""
    d = table(spark, sf_dir, "documents").withColumns({"sha256": F.sha2("text", 256), "size": F.octet_length("text")})
    return elements.added_once(d, "sha256", "doc_id", "size")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.m4a' WHEN 3 THEN 'd.eml' WHEN 4 THEN 'e.xlsx' WHEN 5 THEN 'f.docx' WHEN 6 THEN 'g.md' WHEN 7 THEN 'h.xyz' ELSE 'none' END AS name FROM documents),
e AS (SELECT *, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM n),
r AS (SELECT doc_id, name, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png', 'jpg', 'jpeg', 'heic', 'tiff', 'gif') THEN 'image' WHEN ext IN ('m4a', 'mp3', 'wav', 'aiff') THEN 'audio' WHEN ext IN ('eml', 'emlx') THEN 'email' WHEN ext IN ('xlsx', 'pptx') THEN 'office' WHEN ext IN ('docx', 'doc', 'rtf', 'rtfd', 'html', 'htm') THEN 'rich_text' WHEN ext IN ('txt', 'md', 'markdown', 'csv', 'tsv', 'json') THEN 'plain_text' END AS reader FROM e)
SELECT *, CASE WHEN reader IS NULL THEN 'failed' ELSE 'ok' END AS status FROM r""")
def type_dispatch(spark, sf_dir):
    """The first reader that takes a file; none leaves a failed row."""
    names = ["a.PDF", "b.jpeg", "c.m4a", "d.eml", "e.xlsx", "f.docx", "g.md", "h.xyz", "none"]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 9 + 1).cast("int")).alias("name"))
    return docs.withColumn("reader", elements.reader(F.col("name"))).withColumn("status", F.when(F.col("reader").isNull(), "failed").otherwise("ok"))


HTML_SQL = """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '</p>|<br\\s*/?>|</div>|</tr>|</h[1-6]>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a),
html AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM b)"""


@query(HTML_SQL + " SELECT page_id, text FROM html")
def html_text(spark, sf_dir):
    """HTML to text."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


BLOCKS_SQL = """
WITH conv AS (SELECT conv_id AS document_id, string_agg(CASE turn % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM conversations) WHERE k = 1 GROUP BY conv_id),
parts AS (SELECT document_id, unnest(string_split(text, chr(10) || chr(10))) AS block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM conv),
trim1 AS (SELECT document_id, i, regexp_replace(block, '^\\s+|\\s+$', '', 'g') AS b FROM parts),
kinds AS (SELECT document_id, i, CASE WHEN b ~ '^#+ .*' THEN 'title' WHEN b LIKE '- %' OR b LIKE '* %' OR b LIKE '• %' THEN 'listItem' WHEN b LIKE '```%' THEN 'code' ELSE 'text' END AS kind,
  CASE WHEN b ~ '^#+ ' THEN length(regexp_extract(b, '^#+')) - 1 ELSE 0 END AS depth,
  CASE WHEN b ~ '^#+ ' THEN regexp_replace(regexp_replace(b, '^#+', ''), '^\\s+', '') WHEN b LIKE '- %' OR b LIKE '* %' OR b LIKE '• %' THEN substr(b, 3) ELSE b END AS text FROM trim1 WHERE b <> ''),
blocks AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INTEGER) AS position, kind, CAST(depth AS INTEGER) AS depth, text FROM kinds)"""


def conversation_documents(spark, sf_dir) -> DataFrame:
    """A markdown document for each conversation: turns in order, every fourth a heading or a list item."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min_by("text", F.struct("role", "text")).alias("text"))
    shaped = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("## "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    parts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", shaped.alias("t")))).alias("parts"))
    return parts.select(F.col("conv_id").alias("document_id"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))


@query(BLOCKS_SQL + " SELECT document_id, position, 'e' || position AS tag, kind, depth, text FROM blocks")
def markdown_blocks(spark, sf_dir):
    """Blocks of a markdown text with their anchors."""
    return elements.markdown_blocks(conversation_documents(spark, sf_dir))


FACT_SQL = T.FACT.replace("\\\\", "\\")


@query(BLOCKS_SQL + f""", anchored AS (SELECT *, regexp_matches(text, '{FACT_SQL}') AS fact, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM blocks),
lines AS (SELECT document_id, position, CASE WHEN kind = 'title' THEN repeat('#', least(6, depth + 1)) || ' ' || t || CASE WHEN fact THEN ' [e' || position || ']' ELSE '' END
  WHEN kind = 'listItem' THEN '- ' || t || CASE WHEN fact THEN ' [e' || position || ']' ELSE '' END WHEN kind = 'code' THEN '```' || chr(10) || t || chr(10) || '```' ELSE t || CASE WHEN fact THEN ' [e' || position || ']' ELSE '' END END AS line FROM anchored WHERE t <> '')
SELECT document_id, regexp_replace(regexp_replace(string_agg(line, chr(10) || chr(10) ORDER BY position), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown FROM lines GROUP BY document_id""")
def rendition(spark, sf_dir):
    """Elements as anchored markdown."""
    return elements.rendered(elements.markdown_blocks(conversation_documents(spark, sf_dir)))


@query("""WITH e AS (SELECT doc_id // 7 AS document_id, CAST(doc_id % 7 AS INTEGER) AS position, CAST(doc_id % 7 // 2 AS INTEGER) + 1 AS page, CASE WHEN doc_id % 5 = 0 THEN 'pageFooter' ELSE 'text' END AS kind FROM documents),
m AS (SELECT document_id, position, page, lag(page) OVER (PARTITION BY document_id ORDER BY position) AS before FROM e WHERE kind NOT IN ('pageHeader', 'pageFooter', 'pageNumber'))
SELECT document_id, position, '<!-- page ' || page || ' -->' AS marker FROM m WHERE before IS NULL OR before <> page""")
def page_markers(spark, sf_dir):
    """A marker where the page differs from that of the element before, furniture aside."""
    e = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 7").alias("document_id"), (F.col("doc_id") % 7).cast("int").alias("position"), (F.expr("doc_id % 7 div 2") + 1).cast("int").alias("page"), F.when(F.col("doc_id") % 5 == 0, "pageFooter").otherwise("text").alias("kind")
    )
    return elements.page_markers(e)


@query("""SELECT doc_id, regexp_matches(text, '""" + FACT_SQL + """') AS anchored, CAST(floor(length(text) / 3.7) AS BIGINT) AS tokens,
  length(regexp_replace(regexp_replace(regexp_replace(text, '\\[e\\d+\\]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS plain_length,
  round(length(regexp_replace(substr(text, 1, 2000), '[^A-Za-z0-9\\s.,;:!?''"()-]', '', 'g')) / length(substr(text, 1, 2000)), 6) AS readable FROM documents""")
def text_measures(spark, sf_dir):
    """C01, C06, C07, C08, C45 (readable share, of 2,000 characters as in the SQL)."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.has_fact(t).alias("anchored"), T.token_estimate(t).alias("tokens"), F.length(T.without_anchors(t)).alias("plain_length"), F.round(T.readable(t, considered=2000), 6).alias("readable"))


@query("""SELECT doc_id, replace(replace('ﬁ' || text, 'ﬁ', 'fi'), 'ﬀ', 'ff') = replace('fi' || text, 'ﬀ', 'ff') AS repaired,
 list_filter(list_transform(regexp_split_to_array('• ' || replace(text, ' ', ' • '), '[●•▪◦‣·]'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 2) AS items FROM documents WHERE len(regexp_split_to_array('• ' || replace(text, ' ', ' • '), '[●•▪◦‣·]')) >= 4""")
def tidied(spark, sf_dir):
    """Ligatures repaired, inline bullets split."""
    listed = F.concat(F.lit("• "), F.replace("text", F.lit(" "), F.lit(" • ")))
    repaired = T.without_ligatures(F.concat(F.lit("ﬁ"), "text")) == F.replace(F.concat(F.lit("fi"), "text"), F.lit("ﬀ"), F.lit("ff"))
    docs = table(spark, sf_dir, "documents").where(T.has_bullet_items(listed))
    return docs.select("doc_id", repaired.alias("repaired"), T.bullet_items(listed).alias("items"))


@query("""SELECT doc_id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda m: 'email:' || lower(m)),
 list_transform(list_filter(list_transform(regexp_extract_all(text, '\\+?\\d[\\d\\t\\n\\f\\r\\p{Z}().-]{8,}\\d'), lambda p: regexp_replace(p, '\\D', '', 'g')), lambda p: length(p) >= 10), lambda p: 'phone:' || right(p, 10))))) AS identifiers FROM documents""")
def identifiers(spark, sf_dir):
    """E-mail addresses and phone numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", T.identifiers(F.col("text")).alias("identifiers"))


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' AS row FROM lineitem)
SELECT l_orderkey, '| line | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(row, chr(10) ORDER BY i) AS markdown FROM s GROUP BY l_orderkey""")
def markdown_tables(spark, sf_dir):
    """Rows as a markdown table."""
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return elements.markdown_tables(rows, "l_orderkey", "i", {"line": "l_linenumber", "part": "l_partkey", "flag": "l_returnflag"})


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_extract(split_part(text, chr(10), 1), '^# (.*)$', 1), '^\\s+|\\s+$', '', 'g'), ''), 'Untitled') AS title,
 TRY_CAST(replace(nullif(regexp_extract(text, '\\$([\\d,]+(?:\\.\\d+)?)', 1), ''), ',', '') AS DOUBLE) AS amount, TRY_CAST(nullif(regexp_extract(text, '\\d{4}-\\d{2}-\\d{2}'), '') AS DATE) AS happened_on, 'Everything else' AS category FROM documents""")
def stand_in_records(spark, sf_dir):
    """The deterministic stand-in for a model."""
    return elements.stand_in(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, to_json({doc_id: doc_id, lang: lang, n_chars: n_chars}) AS json FROM documents""")
def element_json(spark, sf_dir):
    """Rows as JSON."""
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("json"))


@query("""WITH incoming AS (SELECT doc_id, 'new:' || lang AS value FROM documents WHERE doc_id % 3 = 0), old AS (SELECT doc_id, 'old:' || lang AS value FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM incoming UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM incoming)""")
def replace_on_reread(spark, sf_dir):
    """A document's rows are replaced when it is read again."""
    docs = table(spark, sf_dir, "documents")
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new:"), "lang").alias("value"))
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("old:"), "lang").alias("value"))
    return elements.replaced(old, new, ["doc_id"])


@query("""SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL""")
def insert_ignore(spark, sf_dir):
    """The first row of a unique key stays, later ones are ignored."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 20.0 WHEN n_chars > 1500 THEN 14.0 ELSE 12.0 END AS size, doc_id % 4 = 0 AS bold, split_part(text, chr(10), 1) AS line FROM documents)
SELECT doc_id, CASE WHEN size / 12.0 >= 1.45 OR size / 12.0 >= 1.15 THEN 'title' WHEN bold AND length(line) <= 80 AND NOT ends_with(line, '.') AND NOT line ~ '^[●•▪◦‣·-].*' THEN 'title' WHEN line ~ '^[●•▪◦‣·-].*' THEN 'listItem' ELSE 'text' END AS kind,
 CASE WHEN size / 12.0 >= 1.45 THEN 0 WHEN size / 12.0 >= 1.15 THEN 1 WHEN bold AND length(line) <= 80 AND NOT ends_with(line, '.') AND NOT line ~ '^[●•▪◦‣·-].*' THEN 2 ELSE 0 END AS depth FROM f""")
def heading_kinds(spark, sf_dir):
    """Kind and depth of a line from its size and weight."""
    size = F.when(F.col("n_chars") > 3000, 20.0).when(F.col("n_chars") > 1500, 14.0).otherwise(12.0)
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), (F.col("doc_id") % 4 == 0).alias("bold"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    kind, depth = elements.heading(F.col("line"), F.col("size"), F.lit(12.0), F.col("bold"))
    return rows.select("doc_id", kind.alias("kind"), depth.alias("depth"))


@query("""SELECT event_id, round(1 - value / 1000 - 0.1, 6) AS y, value / 2000 + 0.05 BETWEEN 0.2 AND 0.6 AND (1 - value / 1000 - 0.1) + 0.05 BETWEEN 0.2 AND 0.6 AS inside FROM events""")
def boxes(spark, sf_dir):
    """Boxes from the bottom left to the top left, and whether a centre lies within another box."""
    e = table(spark, sf_dir, "events")
    box = F.struct((F.col("value") / 2000).alias("x"), (F.col("value") / 1000).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    top = elements.from_bottom_left(box)
    return e.select("event_id", F.round(top["y"], 6).alias("y"), elements.centre_within(top, 0.2, 0.2, 0.6, 0.6).alias("inside"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[E' || doc_id || '].' WHEN 1 THEN ' “e' || doc_id || '” ' WHEN 2 THEN 'e ' || doc_id ELSE lang || doc_id END AS cited FROM documents)
SELECT doc_id, nullif(regexp_extract(lower(regexp_replace(cited, '^[ \\t\\n\\[\\](),.;:''"“”]+|[ \\t\\n\\[\\](),.;:''"“”]+$', '', 'g')), '^e\\d+$'), '') AS anchor FROM c""")
def cited_anchors(spark, sf_dir):
    """Cited anchors in their plain form."""
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    cited = F.when(kind == 0, F.concat(F.lit("[E"), n, F.lit("]."))).when(kind == 1, F.concat(F.lit(" “e"), n, F.lit("” "))).when(kind == 2, F.concat(F.lit("e "), n)).otherwise(F.concat("lang", n))
    return table(spark, sf_dir, "documents").select("doc_id", T.anchor(cited).alias("anchor"))


BOXES_SQL = "b AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, CASE WHEN l_partkey % 9 = 0 THEN 0.05 WHEN l_partkey % 2 = 0 THEN 0.05 + (l_suppkey % 5) / 100.0::DOUBLE ELSE 0.55 + (l_suppkey % 7) / 100.0::DOUBLE END AS x, CASE WHEN l_orderkey % 50 = 7 AND l_linenumber = 2 THEN NULL ELSE l_quantity / 60.0::DOUBLE END AS y, CASE WHEN l_partkey % 9 = 0 THEN 0.9 ELSE 0.3 + (l_suppkey % 12) / 100.0::DOUBLE END AS width FROM lineitem)"


def boxes_of(spark, sf_dir):
    """Boxes of the elements of pages: a page an order, an element a line of it."""
    order = Window.partitionBy("page_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n, s = F.col("l_partkey"), F.col("l_suppkey")
    x = F.when(n % 9 == 0, 0.05).when(n % 2 == 0, 0.05 + (s % 5) / 100.0).otherwise(0.55 + (s % 7) / 100.0)
    y = F.when(~((F.col("page_id") % 50 == 7) & (F.col("l_linenumber") == 2)), F.col("l_quantity") / 60.0)
    width = F.when(n % 9 == 0, 0.9).otherwise(0.3 + (s % 12) / 100.0)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    return lines.select("page_id", F.row_number().over(order).alias("position"), x.alias("x"), y.alias("y"), width.alias("width"))


@query("WITH " + BOXES_SQL + """, w AS (SELECT *, count(*) OVER p > 3 AND count(y) OVER p = count(*) OVER p AS whole FROM b WINDOW p AS (PARTITION BY page_id)),
o AS (SELECT page_id, list_sort(list_distinct(list(k) FILTER (WHERE k >= 0))) AS t FROM (SELECT page_id, unnest(CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE [-1] END) AS k FROM (SELECT page_id, greatest(25, CAST(trunc(x * 100) AS INT)) AS lo, least(75, CAST(trunc((x + width) * 100) AS INT)) AS hi FROM w WHERE whole)) GROUP BY 1),
r AS (SELECT page_id, unnest(list_transform(range(1, len(t) + 2), lambda i: {'k': i, 'a': CASE WHEN i = 1 THEN 25 ELSE t[i - 1] + 1 END, 'e': CASE WHEN i <= len(t) THEN t[i] ELSE 75 END})) AS f FROM (SELECT page_id, coalesce(t, []) AS t FROM o)),
g AS (SELECT page_id, arg_max((f.a + f.e) / 2.0::DOUBLE / 100, (f.e - f.a, -f.k)) AS gutter, max(f.e - f.a) AS free FROM r GROUP BY 1),
s AS (SELECT w.*, CASE WHEN x < gutter AND x + width > gutter THEN 0 WHEN x + width <= gutter THEN 1 WHEN gutter IS NOT NULL THEN 2 END AS side FROM w LEFT JOIN (SELECT * FROM g WHERE free >= 3) g USING (page_id)),
c AS (SELECT *, coalesce(whole AND count(*) FILTER (WHERE side = 1) OVER p >= 2 AND count(*) FILTER (WHERE side = 2) OVER p >= 2, false) AS two, min(y) FILTER (WHERE side = 1) OVER p AS top, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y NULLS FIRST, x NULLS FIRST, position) >= 0.012 THEN 1 ELSE 0 END AS lower FROM s WINDOW p AS (PARTITION BY page_id)),
l AS (SELECT *, sum(lower) OVER (PARTITION BY page_id ORDER BY y NULLS FIRST, x NULLS FIRST, position ROWS UNBOUNDED PRECEDING) AS line, CASE WHEN two AND side = 0 THEN CASE WHEN y < top THEN 0 ELSE 3 END WHEN two THEN side ELSE 0 END AS "column" FROM c)
SELECT page_id, position, row_number() OVER (PARTITION BY page_id ORDER BY "column", CASE WHEN NOT whole THEN 0 WHEN two THEN y ELSE line END, CASE WHEN NOT whole OR two THEN 0 ELSE x END, position) AS place, "column" FROM l""")
def reading_orders(spark, sf_dir):
    """Elements in the order in which a page of one or two columns is read."""
    return elements.reading_order(boxes_of(spark, sf_dir))


GLYPHS_SQL = "g AS (SELECT l_suppkey AS page_id, l_orderkey % 40 AS line, l_orderkey * 8 + l_linenumber AS position, (l_orderkey // 40 % 60) * 9 + l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 5 * 40 ELSE 0 END AS x, CASE WHEN l_partkey % 17 = 0 THEN 0 WHEN l_partkey % 31 = 0 THEN 30 ELSE 5 + l_partkey % 3 END::DOUBLE AS width FROM lineitem)"


@query("WITH " + GLYPHS_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY page_id, line) AS n, row_number() OVER (PARTITION BY page_id, line ORDER BY position, x, width) AS k FROM g), r AS (SELECT * FROM n WHERE n > 8 AND k <= 300 AND width > 0),
t AS (SELECT page_id, line, list_sort(list(width))[len(list(width)) // 2 + 1] AS typical FROM r GROUP BY ALL HAVING count(*) > 4), e AS (SELECT r.*, typical, lag(x + width) OVER (PARTITION BY page_id, line ORDER BY k) AS before FROM r JOIN t USING (page_id, line)),
c AS (SELECT page_id, CAST(trunc(CASE WHEN width > 3 * typical THEN x + width WHEN x - before > 3 * typical THEN x END / 12.0) AS BIGINT) AS bucket FROM e)
SELECT DISTINCT page_id FROM (SELECT page_id, bucket FROM c WHERE bucket IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)""")
def tabular_pages(spark, sf_dir):
    """Pages whose glyphs look like a table."""
    n, page = F.col("l_partkey"), F.col("l_suppkey")
    order = Window.partitionBy("page_id", "line").orderBy("at", "x", "width")
    x = (F.expr("l_orderkey div 40 % 60") * 9 + F.col("l_linenumber") + F.when(page % 3 == 0, n % 5 * 40).otherwise(0)).cast("double")
    width = F.when(n % 17 == 0, 0).when(n % 31 == 0, 30).otherwise(5 + n % 3).cast("double")
    glyphs = table(spark, sf_dir, "lineitem").select(page.alias("page_id"), (F.col("l_orderkey") % 40).alias("line"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), x.alias("x"), width.alias("width"))
    return elements.tabular(glyphs.withColumn("position", F.row_number().over(order)))
