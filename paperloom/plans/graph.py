"""Queries on the graph of orders (records) and the customers, suppliers, parts and nations that they name (entities)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import graph
from paperloom.plans.agenda import agenda_items
from paperloom.plans.reading import table
from paperloom.registry import ORACLES, query
from paperloom.session import dealt

CUSTOMER, SUPPLIER, PART, NATION, STATUS = 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000, 5_000_000_000

LINKS_SQL = f"""WITH links AS (
SELECT o_orderkey AS record_id, 'party_to' AS rel, {CUSTOMER} + o_custkey AS entity_id FROM orders UNION
SELECT l_orderkey, 'issued_by', {SUPPLIER} + l_suppkey FROM lineitem UNION SELECT l_orderkey, 'covers', {PART} + l_partkey FROM lineitem UNION
SELECT o_orderkey, 'located_at', {NATION} + c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
entities AS (SELECT {CUSTOMER} + c_custkey AS entity_id, c_name AS name, 'org' AS kind FROM customer UNION ALL SELECT {SUPPLIER} + s_suppkey, s_name, 'org' FROM supplier UNION ALL SELECT {PART} + p_partkey, p_name, 'product' FROM part UNION ALL SELECT {NATION} + n_nationkey, n_name, 'place' FROM nation),
reach AS (SELECT entity_id, count(DISTINCT record_id) AS reach FROM links GROUP BY entity_id)"""


def links(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, id, rel, entity: df.select(F.col(id).alias("record_id"), F.lit(rel).alias("rel"), entity.cast("long").alias("entity_id"))
    placed = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    all = row(t("orders"), "o_orderkey", "party_to", F.col("o_custkey") + CUSTOMER)
    for other in (row(t("lineitem"), "l_orderkey", "issued_by", F.col("l_suppkey") + SUPPLIER), row(t("lineitem"), "l_orderkey", "covers", F.col("l_partkey") + PART), row(placed, "o_orderkey", "located_at", F.col("c_nationkey").cast("long") + NATION)):
        all = all.union(other)
    return dealt(all, 2 * (t("orders").count() + t("lineitem").count()), "record_id").distinct()


def entities(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, id, name, kind, base: df.select((F.col(id).cast("long") + base).alias("entity_id"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    return row(t("customer"), "c_custkey", "c_name", "org", CUSTOMER).union(row(t("supplier"), "s_suppkey", "s_name", "org", SUPPLIER)).union(row(t("part"), "p_partkey", "p_name", "product", PART)).union(row(t("nation"), "n_nationkey", "n_name", "place", NATION))


def records(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("happened_on"), F.col("o_totalprice").alias("amount"))


FIELDS_SQL = """fields AS (SELECT c_mktsegment AS category, o_orderkey AS record_id, f.k AS field FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('order_status', 0), ('order_priority', 0), ('total_price', 2), ('clerk', 3), ('ship_mode', 5)) f(k, m) WHERE f.m = 0 OR o_orderkey % f.m = 0)"""


def fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    when = lambda n, m: F.when(F.col("o_orderkey") % m == 0, n)
    names = F.array_compact(F.array(F.lit("order_status"), F.lit("order_priority"), when("total_price", 2), when("clerk", 3), when("ship_mode", 5)))
    return o.select(F.col("c_mktsegment").alias("category"), F.col("o_orderkey").alias("record_id"), F.explode(names).alias("field"))


@query(LINKS_SQL + " SELECT record_id, rel, name, kind FROM links JOIN entities USING (entity_id) WHERE rel <> 'covers'")
def record_parties(spark, sf_dir):
    """The parties of each record."""
    return links(spark, sf_dir).where("rel <> 'covers'").join(entities(spark, sf_dir), "entity_id").select("record_id", "rel", "name", "kind")


@query(LINKS_SQL + ", m AS (SELECT * FROM links WHERE rel IN ('party_to', 'located_at')) SELECT x.entity_id, y.entity_id AS beside, count(*) AS documents FROM m x JOIN m y USING (record_id) WHERE x.entity_id <> y.entity_id GROUP BY ALL")
def named_together(spark, sf_dir):
    """Entities that the same documents name."""
    m = links(spark, sf_dir).where("rel IN ('party_to', 'located_at')").select("record_id", "entity_id")
    return m.join(m.withColumnRenamed("entity_id", "beside"), "record_id").where("entity_id <> beside").groupBy("entity_id", "beside").agg(F.count(F.lit(1)).alias("documents"))


@query(LINKS_SQL + f" SELECT entity_id, record_id, CAST(o_orderdate AS DATE) AS happened_on, row_number() OVER (PARTITION BY entity_id ORDER BY o_orderdate DESC, record_id) AS place FROM links JOIN orders ON o_orderkey = record_id WHERE rel = 'party_to'")
def dossiers(spark, sf_dir):
    """The records of an entity, newest first."""
    from pyspark.sql import Window

    rows = links(spark, sf_dir).where("rel = 'party_to'").join(table(spark, sf_dir, "orders"), F.col("record_id") == F.col("o_orderkey"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("o_orderdate"), "record_id"))
    return rows.select("entity_id", "record_id", F.to_date("o_orderdate").alias("happened_on"), place.alias("place"))


@query(LINKS_SQL + " SELECT entity_id, name, coalesce(reach, 0) AS reach FROM entities LEFT JOIN reach USING (entity_id)")
def entity_degrees(spark, sf_dir):
    """How many records name each entity, none included."""
    return entities(spark, sf_dir).join(graph.reach(links(spark, sf_dir)), "entity_id", "left").select("entity_id", "name", F.coalesce("reach", F.lit(0)).alias("reach"))


@query(LINKS_SQL + ", t AS (SELECT count(*) AS records FROM orders), r AS (SELECT * FROM entities LEFT JOIN reach USING (entity_id), t) SELECT any_value(records) AS records, count(*) AS entities, (SELECT count(*) FROM links) AS links, round((SELECT count(*) FROM (SELECT DISTINCT record_id, entity_id FROM links)) / any_value(records), 6) AS per_record, CAST(sum(CASE WHEN reach = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, round(sum(CASE WHEN reach = 1 THEN 1 ELSE 0 END) / count(*), 6) AS singleton_share, CAST(sum(CASE WHEN reach > 1 AND reach / records >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS hubs FROM r")
def graph_health(spark, sf_dir):
    """F05."""
    return graph.health(links(spark, sf_dir), records(spark, sf_dir), entities(spark, sf_dir))


@query(LINKS_SQL + " SELECT entity_id, min(CAST(o_orderdate AS DATE)) AS first_seen, max(CAST(o_orderdate AS DATE)) AS last_seen FROM links JOIN orders ON o_orderkey = record_id GROUP BY entity_id")
def seen_dates(spark, sf_dir):
    """When an entity was named first and last."""
    rows = links(spark, sf_dir).join(records(spark, sf_dir), "record_id")
    return rows.groupBy("entity_id").agg(F.min("happened_on").alias("first_seen"), F.max("happened_on").alias("last_seen"))


@query(LINKS_SQL + " SELECT record_id, rel, entity_id FROM links WHERE record_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def orphaned_links(spark, sf_dir):
    """Links whose record is gone."""
    return links(spark, sf_dir).join(records(spark, sf_dir).where("record_id % 10 <> 0"), "record_id", "left_anti")


@query("""WITH l AS (SELECT 99 AS entity_id, o_orderkey AS record_id FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT ascii(substr(o_orderpriority, 1, 1)), o_orderkey FROM orders),
r AS (SELECT entity_id, count(DISTINCT record_id) AS reach FROM l GROUP BY entity_id), p AS (SELECT *, row_number() OVER (ORDER BY reach DESC, entity_id) AS k FROM r), t AS (SELECT count(*) AS total FROM orders)
SELECT CAST(entity_id AS BIGINT) AS entity_id, reach FROM p, t WHERE k = 1 AND total >= 8 AND reach / total >= 0.3 AND reach >= 1.25 * coalesce((SELECT reach FROM p WHERE k = 2), 0)""")
def library_owner(spark, sf_dir):
    """the entity that most records name, if it stands out."""
    o = table(spark, sf_dir, "orders")
    row = lambda df, entity: df.select(F.col("o_orderkey").alias("record_id"), entity.cast("long").alias("entity_id"))
    return graph.owner(row(o, F.ascii(F.substring("o_orderpriority", 1, 1))).union(row(o.where("o_orderstatus <> 'F'"), F.lit(99))), o)


TIES_SQL = """, wide AS (SELECT record_id FROM links GROUP BY record_id HAVING count(DISTINCT entity_id) <= 5),
r AS (SELECT entity_id, count(DISTINCT record_id) AS reach FROM links GROUP BY entity_id HAVING count(DISTINCT record_id) > 1), t AS (SELECT count(*) AS total FROM orders),
bind AS (SELECT entity_id, reach FROM r, t WHERE NOT (total >= 5 AND reach >= 3 AND reach / total > CASE WHEN total >= 20 THEN 0.35 ELSE 0.6 END)),
pairs AS (SELECT DISTINCT record_id, entity_id FROM links SEMI JOIN wide USING (record_id)),
ties AS (SELECT x.record_id AS a, y.record_id AS b, CAST(sum(greatest(1, 1000 // reach)) AS BIGINT) AS weight FROM pairs x JOIN pairs y USING (entity_id) JOIN bind USING (entity_id) WHERE x.record_id < y.record_id GROUP BY ALL)"""


@query(LINKS_SQL + TIES_SQL + " SELECT a, b, weight, true AS binds FROM ties")
def record_ties(spark, sf_dir):
    """Records tied by the entities that they share, hubs and broad records aside."""
    return graph.ties(links(spark, sf_dir), records(spark, sf_dir))


@query()
def record_communities(spark, sf_dir):
    """Labels of the communities of records tied by entities."""
    return graph.communities(graph.ties(links(spark, sf_dir).where("rel IN ('party_to', 'covers')"), records(spark, sf_dir)))


ALIKE_SQL = """WITH w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array({text}, '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: lower(w)), lambda w: length(w) > 3 AND length(w) < 24 AND NOT regexp_matches(w, '\\d'))) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN ('this','that','these','those','with','from','have','has','had','been','will','shall','would','should','must','may','any','all','such','each','which','there','their','them','then','than','when','what','were','was','your','yours','you','our','ours','into','upon','under','over','also','other','more','most','some','only','same','both','here','does','made','make','page','date','dated','please','thank','regards','sincerely','email','phone','address','name','number','total','amount','document') GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), x AS (SELECT doc_id, term, tf * ln(n / df) AS w FROM c JOIN d USING (term), n WHERE df > 1 AND df / n <= 0.5),
m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), u AS (SELECT doc_id, term, w / norm AS w FROM x JOIN m USING (doc_id)),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, sum(p.w * q.w) AS cosine FROM u p JOIN u q USING (term) WHERE p.doc_id < q.doc_id GROUP BY ALL HAVING sum(p.w * q.w) >= 0.14)"""


@query(ALIKE_SQL.replace("{text}", "text") + " SELECT a, b, round(cosine, 4) AS cosine FROM pairs")
def alike_documents(spark, sf_dir):
    """Documents alike by the weighted terms of their whole texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return graph.alike(d).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query(ALIKE_SQL.replace("{text}", "text") + """, links AS (SELECT doc_id AS record_id, n_chars % 97 AS entity_id FROM documents), r AS (SELECT entity_id, count(*) AS reach FROM links GROUP BY 1 HAVING count(*) > 1), t AS (SELECT count(*) AS total FROM documents),
top AS (SELECT *, row_number() OVER (ORDER BY reach DESC, entity_id) AS k FROM r), own AS (SELECT a.entity_id FROM top a, t WHERE a.k = 1 AND total >= 8 AND a.reach / total >= 0.3 AND a.reach >= 1.25 * coalesce((SELECT reach FROM top WHERE k = 2), 0)),
bind AS (SELECT entity_id, reach FROM r, t WHERE NOT (reach >= 3 AND reach / total > CASE WHEN total >= 20 THEN 0.35 ELSE 0.6 END) AND entity_id NOT IN (SELECT entity_id FROM own)),
e AS (SELECT x.record_id AS a, y.record_id AS b, greatest(1, 1000 // reach) AS weight, true AS binds FROM links x JOIN links y USING (entity_id) JOIN bind USING (entity_id) WHERE x.record_id < y.record_id),
every AS (SELECT * FROM e UNION ALL SELECT a, b, CAST(floor(round(cosine, 6) * 400) AS BIGINT), round(cosine, 6) >= 0.3 OR EXISTS (SELECT 1 FROM e WHERE e.a = pairs.a AND e.b = pairs.b) FROM pairs WHERE floor(round(cosine, 6) * 400) > 0)
SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight, bool_or(binds) AS binds FROM every GROUP BY ALL""")
def text_ties(spark, sf_dir):
    """Records tied by what they share and by their texts."""
    d = table(spark, sf_dir, "documents")
    return graph.ties(d.select(F.col("doc_id").alias("record_id"), (F.col("n_chars") % 97).alias("entity_id")), d, d.select(F.col("doc_id").alias("id"), "text"))


@query("WITH " + FIELDS_SQL + " SELECT category, count(DISTINCT record_id) AS records FROM fields GROUP BY category ORDER BY records DESC, category LIMIT 40")
def taxonomy(spark, sf_dir):
    """categories by size."""
    return fields(spark, sf_dir).groupBy("category").agg(F.count_distinct("record_id").alias("records")).orderBy(F.desc("records"), "category").limit(40)


@query("WITH " + FIELDS_SQL + ", u AS (SELECT category, field, count(*) AS uses FROM fields GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY uses DESC, field) AS place FROM u) WHERE place <= 14")
def field_vocabulary(spark, sf_dir):
    """field names of a category by use."""
    return graph.vocabulary(fields(spark, sf_dir))


@query("WITH " + FIELDS_SQL + ", r AS (SELECT DISTINCT record_id FROM fields ORDER BY record_id DESC LIMIT 80) SELECT field, count(*) AS uses FROM fields SEMI JOIN r USING (record_id) GROUP BY field ORDER BY uses DESC, field LIMIT 14")
def recent_field_vocabulary(spark, sf_dir):
    """field names of the latest records, where there is no category."""
    return graph.recent_vocabulary(fields(spark, sf_dir))


@query("WITH " + FIELDS_SQL + ", n AS (SELECT category, record_id, count(*) AS n FROM fields GROUP BY ALL) SELECT category, arg_min(record_id, (-n, record_id)) AS record_id, max(n) AS fields FROM n GROUP BY category")
def exemplars(spark, sf_dir):
    """the record of a category with most fields."""
    n = fields(spark, sf_dir).groupBy("category", "record_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("category").agg(F.min_by("record_id", F.struct(-F.col("n"), "record_id")).alias("record_id"), F.max("n").alias("fields"))


@query("""WITH r AS (SELECT o_custkey AS group_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' || o_orderpriority || ' ' ELSE 'Everything else' END AS value, CASE WHEN o_orderkey % 4 > 0 THEN lower(c_mktsegment) || o_orderstatus END AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT group_id, count(*) AS size FROM r GROUP BY 1), g AS (SELECT group_id, trim(value) AS v, count(*) AS n FROM r WHERE value IS NOT NULL AND value <> 'Everything else' GROUP BY ALL), k AS (SELECT group_id, kind AS v, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY ALL),
gb AS (SELECT group_id, arg_min(v, (-n, v)) AS v, max(n) AS n FROM g GROUP BY 1), kb AS (SELECT group_id, arg_min(v, (-n, v)) AS v, max(n) AS n FROM k GROUP BY 1),
p AS (SELECT s.group_id, size, gb.v AS guess, gb.n AS gn, kb.n AS kn, upper(substr(kb.v, 1, 1)) || substr(lower(kb.v), 2) || 's' AS shelf FROM s LEFT JOIN gb USING (group_id) LEFT JOIN kb USING (group_id)),
f AS (SELECT *, CASE WHEN size < 3 THEN 'Everything else' WHEN guess IS NOT NULL AND gn >= 2 THEN guess WHEN shelf IS NOT NULL AND kn >= 2 THEN shelf ELSE 'Everything else' END AS first FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY size DESC, group_id) AS k, min((-size, group_id)) OVER (PARTITION BY first) AS lead FROM f WHERE size >= 3),
-- A shelf's name is taken too once a group that lost its vote has it.
l AS (SELECT shelf AS name, min((-size, group_id)) AS lead FROM o WHERE k > 1 AND shelf IS NOT NULL GROUP BY shelf)
SELECT f.group_id, f.size, CASE WHEN f.shelf IS NOT NULL AND (o.k > 1 OR l.lead < (-f.size, f.group_id)) THEN f.shelf ELSE f.first END AS category FROM f LEFT JOIN o USING (group_id) LEFT JOIN l ON l.name = f.first AND f.size >= 3""")
def category_votes(spark, sf_dir):
    """The names that groups vote for, each for one group as far as can be."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = F.col("o_orderkey")
    value = F.when(n % 3 == 1, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).when(n % 3 == 2, graph.HOLDING)
    return graph.voted(o.select(F.col("o_custkey").alias("group_id"), value.alias("value"), F.when(n % 4 > 0, F.concat(F.lower("c_mktsegment"), "o_orderstatus")).alias("kind")))


@query("WITH " + FIELDS_SQL + ", z AS (SELECT category, count(DISTINCT record_id) AS records FROM fields GROUP BY category HAVING count(DISTINCT record_id) >= 3), u AS (SELECT category, field, count(*) AS uses FROM fields GROUP BY ALL), o AS (SELECT category, field, CASE WHEN uses <= records / 2 THEN 1 ELSE 0 END AS odd FROM u JOIN z USING (category)) SELECT category, record_id, round(avg(odd), 6) AS odd_share FROM fields JOIN o USING (category, field) GROUP BY ALL HAVING round(avg(odd), 6) >= 0.34")
def divergent_records(spark, sf_dir):
    """records whose field names aren't those of their category."""
    return graph.divergent(fields(spark, sf_dir))


@query("WITH " + FIELDS_SQL + ", u AS (SELECT category, field, count(*) AS uses FROM fields WHERE category <> '' GROUP BY ALL), b AS (SELECT category, max(uses) AS most, sum(uses) AS al FROM u GROUP BY category) SELECT round(sum(most) / sum(al), 6) AS coherence FROM b")
def schema_coherence(spark, sf_dir):
    """F13."""
    return graph.coherence(fields(spark, sf_dir))


@query("WITH agenda AS (" + ORACLES["agenda_items"] + """) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lineitem) AS elements, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM customer) AS people,
(SELECT count(*) FROM agenda) AS waiting, (SELECT count(*) FROM agenda WHERE horizon = 'overdue') AS overdue""")
def library_counts(spark, sf_dir):
    """what a library has, and what of it waits for a person."""
    n = lambda t, c: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(c))
    waits = agenda_items(spark, sf_dir).agg(F.count(F.lit(1)).alias("waiting"), F.count_if(F.col("horizon") == "overdue").alias("overdue"))
    return n("documents", "documents").join(n("lineitem", "elements")).join(n("orders", "records")).join(n("customer", "people")).join(waits)
