"""Who is who: name forms, matching, resolution and conflicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import gate
from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.operators import linkage
from paperloom.plans.reading import table
from paperloom.registry import query

ENDINGS = ["", " Inc.", " Co. Inc.", " GmbH", " LLC", ", Ltd."]

def _normal_sql(source: str, column: str, keep: str, name: str = "norm") -> str:
    """A chain of CTEs, the last one `name`, that normalizes `column` of `source` as `n`."""
    steps, before = [f"{name}_0 AS (SELECT {keep}, strip_accents(lower({column})) AS n FROM {source})"], f"{name}_0"
    for i, e in enumerate(N.COMPANY_ENDINGS, 1):
        steps.append(f"{name}_{i} AS (SELECT {keep}, CASE WHEN ends_with(n, '{e}') THEN substr(n, 1, length(n) - {len(e)}) ELSE n END AS n FROM {before})")
        before = f"{name}_{i}"
    steps.append(f"{name} AS (SELECT {keep}, regexp_replace(regexp_replace(regexp_replace(n, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS n FROM {before})")
    return ", ".join(steps)


PARTY_SQL = "p AS (SELECT p_partkey, 'É' || p_name || list_extract(['', ' Inc.', ' Co. Inc.', ' GmbH', ' LLC', ', Ltd.'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS name FROM part)"


@query(f"WITH {PARTY_SQL}, {_normal_sql('p', 'name', 'p_partkey')} SELECT p_partkey, n AS normalized FROM norm")
def normalized_names(spark, sf_dir):
    """Names without legal forms, marks and punctuation."""
    name = F.concat(F.lit("É"), "p_name", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", N.normalized(name).alias("normalized"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Dr. ' || p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ', Mrs. ' || split_part(p_name, ' ', 1) || ' J. (' || p_name || ')' WHEN 2 THEN split_part(p_name, ' ', 1) || ', Inc.' ELSE p_name END AS name FROM part),
t AS (SELECT p_partkey, regexp_replace(regexp_replace(name, '\\(.*$', '', 's'), '^\\s+|\\s+$', '', 'g') AS t FROM p),
h AS (SELECT *, string_split(t, ',') AS parts, regexp_replace(string_split(t, ',')[1], '^\\s+|\\s+$', '', 'g') AS head, regexp_replace(string_split(t, ',')[2], '^\\s+|\\s+$', '', 'g') AS tail FROM t),
u AS (SELECT p_partkey, CASE WHEN len(parts) = 2 AND NOT regexp_matches(head, '[\\s\\d]') AND tail <> '' AND regexp_replace(lower(tail), '^[. ]+|[. ]+$', '', 'g') NOT IN ('inc', 'llc', 'l.l.c', 'ltd', 'co', 'corp', 'corporation', 'company', 'gmbh', 'plc', 'sa', 'nv', 'bv', 'ag', 'pty', 'llp', 'lp', 'pc', 'pllc') THEN tail || ' ' || head ELSE t END AS t FROM h)
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_replace(lower(w), '^[.,]+|[.,]+$', '', 'g') NOT IN ('', 'mr', 'mrs', 'dr', 'ms', 'miss')), ' ') AS form FROM u""")
def person_forms(spark, sf_dir):
    """Given names first, titles and brackets dropped."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Dr. "), "p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(b, F.lit(", Mrs. "), a, F.lit(" J. ("), "p_name", F.lit(")"))).when(F.col("p_partkey") % 4 == 2, F.concat(a, F.lit(", Inc."))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", N.person_form(name).alias("form"))


PAIRS_SQL = """WITH base AS (SELECT DISTINCT p_name AS n FROM part), v AS (SELECT n AS name FROM base UNION SELECT split_part(n, ' ', 1) FROM base UNION SELECT n || ' ii' FROM base WHERE length(n) % 2 = 0 UNION SELECT left(split_part(n, ' ', 1), 1) || ' ' || split_part(n, ' ', 2) FROM base UNION SELECT n || 's' FROM base WHERE length(n) % 3 = 0 UNION SELECT n || ' ' || CAST(length(n) AS VARCHAR) FROM base),
pairs AS (SELECT x.name AS a, y.name AS b, string_split(x.name, ' ') AS wa, string_split(y.name, ' ') AS wb FROM v x JOIN v y ON x.name < y.name)"""


def spellings(spark, sf_dir):
    """Part names in the spellings that the tests of the ladder need."""
    base = table(spark, sf_dir, "part").select(F.col("p_name").alias("n")).distinct()
    a, b = F.split_part("n", F.lit(" "), F.lit(1)), F.split_part("n", F.lit(" "), F.lit(2))
    n = F.length("n")
    all = F.array(F.col("n"), a, F.when(n % 2 == 0, F.concat("n", F.lit(" ii"))), F.concat(F.left(a, F.lit(1)), F.lit(" "), b), F.when(n % 3 == 0, F.concat("n", F.lit("s"))), F.concat("n", F.lit(" "), n.cast("string")))
    return base.select(F.explode(F.array_compact(all)).alias("name")).distinct()


@query(PAIRS_SQL + """, t AS (SELECT a, b, list_distinct(list_transform(range(1, length(a) + 2), lambda i: substr('  ' || a || ' ', i, 3))) AS x, list_distinct(list_transform(range(1, length(b) + 2), lambda i: substr('  ' || b || ' ', i, 3))) AS y FROM pairs)
SELECT a, b, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM t WHERE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.5""")
def trigram_pairs(spark, sf_dir):
    """C14: names alike by trigrams."""
    pairs = linkage.alike_pairs(spellings(spark, sf_dir), 0.5)
    return pairs.select("a", "b", F.round(T.trigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query(PAIRS_SQL + """, o AS (SELECT CASE WHEN length(a) >= length(b) THEN a ELSE b END AS longer, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS shorter FROM pairs), w AS (SELECT *, string_split(longer, ' ') AS x, string_split(shorter, ' ') AS y,
 list_distinct(list_transform(range(1, length(longer) + 2), lambda i: substr('  ' || longer || ' ', i, 3))) AS gx, list_distinct(list_transform(range(1, length(shorter) + 2), lambda i: substr('  ' || shorter || ' ', i, 3))) AS gy FROM o),
r AS (SELECT longer, shorter, CASE WHEN len(y) < len(x) AND length(shorter) >= 3 AND shorter NOT IN ('the', 'a', 'an', 'and', 'for', 'new', 'old', 'one', 'two', 'st', 'dr', 'mr', 'ms', 'mrs', 'san', 'los', 'las', 'north', 'south', 'east', 'west') AND x[1:len(y)] = y THEN 'short form' WHEN 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) >= 0.9 THEN 'alike' END AS why FROM w) SELECT * FROM r WHERE why IS NOT NULL""")
def merge_candidates(spark, sf_dir):
    """Names of one thing, by blocking."""
    return linkage.same_thing(linkage.merge_pairs(spellings(spark, sf_dir)))


@query(PAIRS_SQL + """, m AS (SELECT a, b, regexp_extract_all(a, '\\d+') AS na, regexp_extract_all(b, '\\d+') AS nb, CASE WHEN len(wa) >= 2 AND wa[-1] IN ('ii', 'iii') THEN wa[-1] END AS ga, CASE WHEN len(wb) >= 2 AND wb[-1] IN ('ii', 'iii') THEN wb[-1] END AS gb,
 CASE WHEN len(wa) = len(wb) AND len(wa) >= 2 AND len(list_filter(list_zip(wa, wb), lambda p: p[1] <> p[2])) = 1 THEN list_filter(list_zip(wa, wb), lambda p: p[1] <> p[2])[1] END AS one, len(wa) = len(wb) AND len(wa) >= 2 AND len(list_filter(list_zip(wa, wb), lambda p: NOT (p[1] = p[2] OR (length(p[1]) = 1 AND starts_with(p[2], p[1])) OR (length(p[2]) = 1 AND starts_with(p[1], p[2]))))) = 0 AS initials FROM pairs)
SELECT a, b, coalesce(na[1:least(len(na), len(nb))] <> nb[1:least(len(na), len(nb))], false) AS numbers_contradict, coalesce(ga <> gb, false) AS generations_differ,
 coalesce(greatest(length(one[1]), length(one[2])) >= 4 AND levenshtein(one[1], one[2]) = 1, false) AS typo, initials FROM m
 WHERE coalesce(greatest(length(one[1]), length(one[2])) >= 4 AND levenshtein(one[1], one[2]) = 1, false) OR initials""")
def name_tests(spark, sf_dir):
    """Tests of name pairs."""
    pairs = linkage.name_pairs(spellings(spark, sf_dir))
    a, b = F.col("a"), F.col("b")
    tests = {"numbers_contradict": N.numbers_contradict(a, b), "generations_differ": N.generations_differ(a, b), "typo": F.coalesce(N.is_typo(a, b), F.lit(False)), "initials": N.initials_match(a, b)}
    return pairs.select("a", "b", *(c.alias(n) for n, c in tests.items())).where("typo OR initials")


@query()
def match_kinds(spark, sf_dir):
    """The ladder over all pairs that can meet on it."""
    return linkage.matched(linkage.ladder_pairs(spellings(spark, sf_dir)))


# Persons: a given name from one word of a part's name and a surname from the other; documents are groups of ten parts.
PEOPLE_SQL = """b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s FROM part),
e AS (SELECT row_number() OVER (ORDER BY g, s) AS entity_id, CASE WHEN length(g) % 3 = 0 THEN g || ' h w ' || s WHEN length(g || s) % 5 = 0 THEN g || ' j ' || s ELSE g || ' ' || s END AS name, CASE WHEN length(s) = 6 THEN 'org' ELSE 'person' END AS kind FROM b WHERE length(g) + length(s) <> 8),
m AS (SELECT p_partkey AS mention_id, p_partkey // 10 AS document_id, CASE p_partkey % 8 WHEN 0 THEN g || ' ' || s WHEN 1 THEN left(g, 1) || ' ' || s WHEN 2 THEN s WHEN 3 THEN g || ' w ' || s WHEN 4 THEN g || ' ' || s || 'x' WHEN 5 THEN g || ' ' || s || ' ii' WHEN 6 THEN 'nobody at all' ELSE '' END AS name, CASE WHEN length(s) = 6 THEN 'org' ELSE 'person' END AS kind FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s FROM part)),
owned AS (SELECT entity_id, 'mail:' || entity_id AS identifier FROM e WHERE entity_id % 4 = 1), seen AS (SELECT DISTINCT document_id, 'mail:' || (document_id % 40) AS identifier FROM m WHERE document_id % 3 = 0),
context AS (SELECT x.entity_id, y.entity_id AS other_id FROM e x JOIN e y ON y.entity_id = x.entity_id + 1 OR y.entity_id = x.entity_id + 2)"""
# The likenesses, over all pairs of a kind: this is the whole ladder without blocking.
def _likeness_sql(i: int, j: int) -> str:
    """Jaro-Winkler of the i-th and the j-th word that two names don't share."""
    a, b = f"ra[{i}]", f"rb[{j}]"
    return f"(jaro_similarity({a}, {b}) + 0.1 * least(4, len(list_filter(range(1, 5), lambda k: left({a}, k) = left({b}, k) AND length({a}) >= k AND length({b}) >= k))) * (1 - jaro_similarity({a}, {b})))"


RESOLVED_SQL = f"WITH {PEOPLE_SQL}" + """, x AS (SELECT m.mention_id, min(e.entity_id) AS entity_id FROM m JOIN e ON m.name = e.name AND m.name <> '' GROUP BY 1),
rest AS (SELECT * FROM m WHERE name <> '' AND mention_id NOT IN (SELECT mention_id FROM x)),
own AS (SELECT s.document_id, e.kind, min(entity_id) AS entity_id FROM seen s JOIN owned USING (identifier) JOIN e USING (entity_id) GROUP BY ALL HAVING count(DISTINCT entity_id) = 1),
i AS (SELECT mention_id, own.entity_id FROM rest JOIN own USING (document_id, kind)),
n AS (SELECT DISTINCT r.name, r.kind, e.entity_id, e.name AS f, string_split(r.name, ' ') AS wa, string_split(e.name, ' ') AS wb FROM (SELECT DISTINCT name, kind FROM rest) r JOIN e ON e.kind = r.kind AND e.name <> r.name),
o AS (SELECT *, CASE WHEN len(wa) >= len(wb) THEN wa ELSE wb END AS l, CASE WHEN len(wa) >= len(wb) THEN wb ELSE wa END AS s, CASE WHEN len(wa) = len(wb) THEN list_filter(list_zip(wa, wb), lambda p: p[1] <> p[2]) ELSE [] END AS d,
 list_filter(wa, lambda w: NOT list_contains(wb, w) AND length(w) > 1) AS ra, list_filter(wb, lambda w: NOT list_contains(wa, w) AND length(w) > 1) AS rb,
 CASE WHEN len(wa) > 2 THEN list_filter(wa[2:-2], lambda w: length(w) = 1) ELSE [] END AS ia, CASE WHEN len(wb) > 2 THEN list_filter(wb[2:-2], lambda w: length(w) = 1) ELSE [] END AS ib FROM n),
j AS (SELECT *, jaro_similarity(name, f) AS jaro, least(4, len(list_filter(range(1, 5), lambda k: left(name, k) = left(f, k) AND length(name) >= k AND length(f) >= k))) AS pre FROM o),
k AS (SELECT *, CASE WHEN len(wa) >= 2 AND len(wb) >= 2 AND wa[-1] IN ('ii', 'iii') AND wb[-1] IN ('ii', 'iii') AND wa[-1] <> wb[-1] THEN NULL
 WHEN len(s) = 1 AND len(l) > 1 THEN CASE WHEN length(s[1]) >= 3 AND list_contains(l, s[1]) THEN 'surname' END
 WHEN regexp_matches(' ' || array_to_string(l, ' ') || ' ', array_to_string(list_transform(s, lambda w: ' ' || w || ' '), '(.* )?')) OR (len(s) = 2 AND list_position(l, s[1]) < list_position(l, s[2])) OR (len(s) = 3 AND list_position(l, s[1]) < list_position(l, s[2]) AND list_position(l, s[2]) < list_position(l, s[3])) THEN 'subsequence'
 WHEN len(wa) = len(wb) AND len(wa) >= 2 AND len(d) > 0 AND len(list_filter(d, lambda p: NOT ((length(p[1]) = 1 AND starts_with(p[2], p[1])) OR (length(p[2]) = 1 AND starts_with(p[1], p[2]))))) = 0 THEN 'initials'
 WHEN len(wa) >= 2 AND len(d) = 1 AND greatest(length(d[1][1]), length(d[1][2])) >= 4 AND levenshtein(d[1][1], d[1][2]) = 1 THEN 'typo'
 WHEN jaro + 0.1 * pre * (1 - jaro) >= 0.92 AND (len(ra) = 0 AND len(rb) = 0 OR len(ra) = 1 AND len(rb) = 1 AND §11§ >= 0.82 OR len(ra) = 2 AND len(rb) = 2 AND CASE WHEN greatest(§11§, §22§) >= greatest(§12§, §21§) THEN least(§11§, §22§) ELSE least(§12§, §21§) END >= 0.82) THEN 'similar' END AS match FROM j),
p AS (SELECT kind, count(*) AS population FROM e GROUP BY kind), h AS (SELECT kind, string_split(name, ' ')[-1] AS surname, count(*) AS sharing FROM e GROUP BY ALL),
fit AS (SELECT k.name, k.kind, entity_id, match, CASE match WHEN 'subsequence' THEN NOT (len(ia) > 0 AND len(ib) > 0 AND ia <> ib) WHEN 'initials' THEN len(list_filter(wb, lambda w: length(w) = 1)) = 0 WHEN 'surname' THEN false ELSE population >= 12 AND coalesce(sharing, 0) <= 3 END AS decides
 FROM k JOIN p USING (kind) LEFT JOIN h ON h.kind = k.kind AND h.surname = wa[-1] WHERE match IS NOT NULL AND (match <> 'surname' OR k.kind = 'person')),
c AS (SELECT mention_id, document_id, entity_id, decides FROM rest JOIN fit USING (name, kind) WHERE mention_id NOT IN (SELECT mention_id FROM i)),
u AS (SELECT mention_id, min(entity_id) AS entity_id FROM c WHERE decides GROUP BY 1 HAVING count(DISTINCT entity_id) = 1),
one AS (SELECT *, 'exact' AS how FROM x UNION ALL SELECT *, 'identifier' FROM i UNION ALL SELECT *, 'unambiguous' FROM u),
beside AS (SELECT DISTINCT document_id, entity_id AS other_id FROM one JOIN m USING (mention_id)),
two AS (SELECT mention_id, min(c.entity_id) AS entity_id, 'context' AS how FROM c JOIN context USING (entity_id) JOIN beside USING (document_id, other_id) WHERE mention_id NOT IN (SELECT mention_id FROM one) GROUP BY 1 HAVING count(DISTINCT c.entity_id) = 1)
SELECT m.mention_id, a.entity_id, a.how AS resolved_by FROM m LEFT JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) a USING (mention_id)"""
for _i, _j in ((1, 1), (2, 2), (1, 2), (2, 1)):
    RESOLVED_SQL = RESOLVED_SQL.replace(f"§{_i}{_j}§", _likeness_sql(_i, _j))


@query(RESOLVED_SQL)
def resolved_mentions(spark, sf_dir):
    """Mentions and the entities that they mean; what stays open is null."""
    part = table(spark, sf_dir, "part")
    g, s = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    join = lambda *c: F.concat_ws(" ", *c)
    kind = lambda s: F.when(F.length(s) == 6, "org").otherwise("person")
    base = part.select(g.alias("g"), s.alias("s")).distinct()
    name = F.when(F.length("g") % 3 == 0, join("g", F.lit("h w"), "s")).when((F.length("g") + F.length("s")) % 5 == 0, join("g", F.lit("j"), "s")).otherwise(join("g", "s"))
    # Numbered in order: fewer than a hundred names, whatever the size of the table.
    numbered = base.where(F.length("g") + F.length("s") != 8).withColumn("entity_id", F.row_number().over(Window.orderBy("g", "s")).cast("long"))
    entities = numbered.select("entity_id", name.alias("name"), kind(F.col("s")).alias("kind"))
    n = F.col("p_partkey") % 8
    said = F.when(n == 0, join(g, s)).when(n == 1, join(F.left(g, F.lit(1)), s)).when(n == 2, s).when(n == 3, join(g, F.lit("w"), s)).when(n == 4, F.concat(g, F.lit(" "), s, F.lit("x"))).when(n == 5, join(g, s, F.lit("ii"))).when(n == 6, "nobody at all").otherwise("")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.expr("p_partkey div 10").alias("document_id"), said.alias("name"), kind(s).alias("kind"))
    mail = lambda c: F.concat(F.lit("mail:"), c.cast("string")).alias("identifier")
    owned = entities.where("entity_id % 4 = 1").select("entity_id", mail(F.col("entity_id")))
    seen = mentions.where("document_id % 3 = 0").select("document_id", mail(F.col("document_id") % 40)).distinct()
    ids = entities.select("entity_id")
    context = ids.select("entity_id", F.explode(F.array(F.col("entity_id") + 1, F.col("entity_id") + 2)).alias("other_id")).join(ids.withColumnRenamed("entity_id", "other_id"), "other_id", "left_semi")
    return linkage.resolved(mentions, entities, (owned, seen), context)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', -1) AS surname FROM part) SELECT name, surname, count(*) OVER (PARTITION BY surname) AS sharing FROM n""")
def surname_frequency(spark, sf_dir):
    """F16: how many names share the last word."""
    return linkage.surname_frequency(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct())


@query("""WITH s AS (SELECT p_size AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS spelling, lower(p_name) AS normalized, p_partkey AS seen FROM part), f AS (SELECT entity_id, normalized, arg_min(spelling, seen) AS spelling FROM s GROUP BY ALL)
SELECT entity_id, list_sort(list(spelling)) AS aliases FROM f GROUP BY entity_id""")
def alias_lists(spark, sf_dir):
    """the spellings of an entity, one for each normalized form."""
    part = table(spark, sf_dir, "part")
    spelling = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return linkage.aliases(part.select(F.col("p_size").alias("entity_id"), spelling.alias("spelling"), F.lower("p_name").alias("normalized"), F.col("p_partkey").alias("seen")))


@query("""WITH f AS (SELECT o_custkey AS entity_id, 'order_priority' AS field, o_orderpriority AS value, CAST(o_orderdate AS DATE) AS day, o_orderkey AS record_id FROM orders)
SELECT * FROM (SELECT entity_id, field, count(DISTINCT lower(value)) AS "values", arg_min(value, (day, record_id)) AS oldest, arg_max(value, (day, record_id)) AS newest, arg_min(record_id, (day, record_id)) AS oldest_record, arg_max(record_id, (day, record_id)) AS newest_record FROM f GROUP BY entity_id, field) WHERE "values" > 1 AND oldest <> newest""")
def conflicting_fields(spark, sf_dir):
    """Fields whose oldest and newest values contradict."""
    o = table(spark, sf_dir, "orders")
    return linkage.conflicts(o.select(F.col("o_custkey").alias("entity_id"), F.lit("order_priority").alias("field"), F.col("o_orderpriority").alias("value"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("record_id")))


@query("""WITH j AS (SELECT d.n_chars > 200 AS predicted, l.quality = 1 AS actual FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT CAST(sum(CAST(predicted AND actual AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(predicted AND NOT actual AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(NOT predicted AND actual AS INT)) AS BIGINT) AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM t""")
def quality_measures(spark, sf_dir):
    """precision, recall and F1 of a rule."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return linkage.measures(j.select((F.col("n_chars") > 200).alias("predicted"), (F.col("quality") == 1).alias("actual")))


def _listed_sql(values: str) -> str:
    return ", ".join(f"'{v}'" for v in gate.listed(values))


PROPOSED = ["Tenant", "invoice", "California", "2026", "stakeholder", "x", "nobody at all", "!!"]
GATE_SQL = (
    "WITH q AS (SELECT doc_id, text, unnest([split_part(text, ' ', 2), split_part(text, ' ', 9) || ' ' || split_part(text, ' ', 10), "
    + ", ".join(f"'{p}'" for p in PROPOSED)
    + "]) AS name FROM (SELECT doc_id, 'Sworn before ' || text AS text FROM documents)), p AS (SELECT doc_id, text, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name FROM q GROUP BY ALL), t AS (SELECT DISTINCT doc_id, text FROM p), "
    + _normal_sql("p", "name", "doc_id, text, name", "plain")
    + ", "
    + _normal_sql("t", "text", "doc_id", "body")
    + f""", a AS (SELECT plain.doc_id, name, plain.n AS plain, body.n AS body, instr(lower(text), lower(name)) AS spot, lower(text) AS low FROM plain JOIN body USING (doc_id)),
 l AS (SELECT *, CASE WHEN spot > 1 THEN list_filter([{_listed_sql(gate.HANDLERS)}], lambda h: contains(substr(low, greatest(spot - 60, 1), spot - greatest(spot - 60, 1)), h))[1] END AS role FROM a)
SELECT doc_id, name, CASE WHEN length(plain) < 2 THEN 'too short' WHEN NOT regexp_matches(name, '\\p{{L}}') THEN 'no letters' WHEN regexp_matches(plain, '^[\\p{{N}}\\s]*$') THEN 'just a number' WHEN plain IN ({_listed_sql(gate.ROLES)}) THEN 'generic role'
 WHEN plain IN ({_listed_sql(gate.PAPERWORK)}) THEN 'paperwork term' WHEN NOT contains(plain, ' ') AND regexp_matches(plain, '(holder|payer|payee|signer|writer)$') AND length(plain) > 5 THEN 'generic role' WHEN role IS NOT NULL THEN 'named as the ' || role
 WHEN plain IN ({_listed_sql(gate.REGIONS)}) THEN 'too broad a place' WHEN NOT contains(body, plain) THEN 'not in the document' END AS refused FROM l"""
)


@query(GATE_SQL)
def gated_names(spark, sf_dir):
    """Proposed names, and why some are no entities."""
    text = F.concat(F.lit("Sworn before "), "text")
    part = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    names = F.array(part(2), F.concat(part(9), F.lit(" "), part(10)), *map(F.lit, PROPOSED))
    return gate.gated(docs.withColumn("names", F.array_distinct(F.transform(names, T.trimmed))), "doc_id")


@query("""WITH p AS (SELECT l_suppkey AS document_id, l_partkey AS name, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.75 END) AS confidence, count(*) AS mentions FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, mentions DESC, name) AS place FROM p)
SELECT document_id, name, place, place <= 15 AS admitted FROM r""")
def salient_entities(spark, sf_dir):
    """The 15 most salient entities of a document; the rest is refused."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("name"))
    p = p.agg(F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.75)).alias("confidence"), F.count(F.lit(1)).alias("mentions"))
    return linkage.salient(p).select("document_id", "name", "place", "admitted")


def _walked_sql(names: str, source: str) -> str:
    """CTEs, the last one `kept` (kind, name, keeper): names of `names` (kind, name) in order of length, each absorbed by the
    first name before it that is the same thing and that nothing absorbed, one name a step."""
    return f"""{names}, o AS (SELECT kind, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS longer, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS shorter FROM (SELECT x.kind, x.name AS a, y.name AS b FROM {source} x JOIN {source} y ON x.kind = y.kind AND x.name < y.name)),
w AS (SELECT *, string_split(longer, ' ') AS x, string_split(shorter, ' ') AS y, list_distinct(list_transform(range(1, length(longer) + 2), lambda i: substr('  ' || longer || ' ', i, 3))) AS gx, list_distinct(list_transform(range(1, length(shorter) + 2), lambda i: substr('  ' || shorter || ' ', i, 3))) AS gy FROM o),
same AS (SELECT kind, longer, shorter FROM w WHERE (len(y) < len(x) AND length(shorter) >= 3 AND shorter NOT IN ('the', 'a', 'an', 'and', 'for', 'new', 'old', 'one', 'two', 'st', 'dr', 'mr', 'ms', 'mrs', 'san', 'los', 'las', 'north', 'south', 'east', 'west') AND x[1:len(y)] = y) OR 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) >= 0.9),
near AS (SELECT kind, name, list(other) AS others FROM (SELECT kind, longer AS name, shorter AS other FROM same UNION ALL SELECT kind, shorter, longer FROM same) GROUP BY ALL),
n AS (SELECT s.kind, s.name, coalesce(others, []) AS others, row_number() OVER (PARTITION BY s.kind ORDER BY length(s.name) DESC, s.name) AS i FROM {source} s LEFT JOIN near USING (kind, name)),
walk AS (SELECT kind, i, name, name AS keeper, [name] AS keepers FROM n WHERE i = 1 UNION ALL
 SELECT n.kind, n.i, n.name, coalesce(list_filter(walk.keepers, lambda k: list_contains(n.others, k))[1], n.name), CASE WHEN len(list_filter(walk.keepers, lambda k: list_contains(n.others, k))) = 0 THEN list_append(walk.keepers, n.name) ELSE walk.keepers END FROM walk JOIN n ON n.kind = walk.kind AND n.i = walk.i + 1),
kept AS (SELECT kind, name, keeper FROM walk)"""


@query(PAIRS_SQL.replace("WITH base", "WITH RECURSIVE base").split(",\npairs AS")[0] + ", " + _walked_sql("k AS (SELECT '' AS kind, name FROM v)", "k") + " SELECT name, keeper FROM kept")
def merged_names(spark, sf_dir):
    """names that are one thing, longest first, and the name that each is merged into."""
    names = spellings(spark, sf_dir)
    return linkage.merged(names, linkage.same_thing(linkage.merge_pairs(names)))
