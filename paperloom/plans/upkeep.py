"""Merged entities, cascades and schema versions of a library made of parts, orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import linkage, upkeep
from paperloom.plans.identity import _walked_sql
from paperloom.plans.reading import table
from paperloom.registry import query
from paperloom.session import dealt, new_table

# Entities are parts under different spellings of their names; lines of orders link, mention and state things of them.
NAME_SQL = "CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name || 's' WHEN 2 THEN p_name || ' ltd' ELSE p_name END"
ENTITY_SQL = f"""entity AS (SELECT p_partkey AS entity_id, {NAME_SQL} AS name, CASE WHEN p_size % 3 = 0 THEN 'org' ELSE 'product' END AS kind, ['no ' || (p_partkey % 4), upper(p_name)] AS aliases FROM part),
line AS (SELECT DISTINCT ON (id) l_orderkey * 10 + l_linenumber AS id, * FROM lineitem ORDER BY id, l_partkey, l_suppkey, l_linestatus, l_returnflag), parts AS (SELECT count(*) AS n FROM part)"""
MERGED_SQL = (
    f"WITH RECURSIVE {ENTITY_SQL}, "
    + _walked_sql("d AS (SELECT DISTINCT kind, name FROM entity)", "d")
    + """, first AS (SELECT kind, name, min(entity_id) AS first FROM entity GROUP BY ALL),
map AS (SELECT entity_id, f.first AS keeper_id FROM entity e JOIN kept USING (kind, name) JOIN first f ON f.kind = kept.kind AND f.name = kept.keeper WHERE e.entity_id <> f.first)"""
)


def library(spark, sf_dir) -> upkeep.Library:
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    word, whole = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_name")
    name = F.when(n == 0, word).when(n == 1, F.concat(whole, F.lit("s"))).when(n == 2, F.concat(whole, F.lit(" ltd"))).otherwise(whole)
    aliases = F.array(F.concat(F.lit("no "), (F.col("p_partkey") % 4).cast("string")), F.upper("p_name"))
    entity = part.select(F.col("p_partkey").alias("entity_id"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, "org").otherwise("product").alias("kind"), aliases.alias("aliases"))
    line = table(spark, sf_dir, "lineitem")
    line = dealt(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag"), line.count(), "l_orderkey").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey")
    line = line.agg(F.min(F.struct("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")).alias("first")).select("id", "l_orderkey", "first.*")
    line = line.join(F.broadcast(part.agg(F.count(F.lit(1)).alias("parts")))).withColumn("other", (F.col("l_suppkey") * 7 + F.col("l_partkey")) % F.col("parts") + 1)
    link = line.select("id", F.concat(F.lit("record:"), (F.expr("l_orderkey div 4")).cast("string")).alias("src"), F.col("l_linestatus").alias("rel"), F.concat(F.lit("entity:"), F.col("l_partkey").cast("string")).alias("dst"))
    mention = line.select("id", F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id"))
    assertion = line.select("id", F.col("l_partkey").alias("subject_id"), F.col("l_linestatus").alias("predicate"), F.when(F.col("l_returnflag") != "N", F.col("other")).alias("object_id"), F.col("l_returnflag").alias("object_key"), F.expr("l_orderkey div 100").alias("document_id"))
    return {"entity": entity, "link": link, "mention": mention, "assertion": assertion}


def _merged(spark, sf_dir) -> upkeep.Library:
    tables = library(spark, sf_dir)
    names = tables["entity"].select("name", "kind").distinct()
    kept = linkage.merged(names, linkage.same_thing(linkage.merge_pairs(names, "kind")), "kind")
    return upkeep.merged_library(tables, upkeep.keepers(tables["entity"], kept), count=table(spark, sf_dir, "lineitem").count())


@query(MERGED_SQL + """, moved AS (SELECT id, src, rel, coalesce('entity:' || keeper_id, dst) AS dst, keeper_id IS NOT NULL AS changed FROM (SELECT id, 'record:' || (l_orderkey // 4) AS src, l_linestatus AS rel, 'entity:' || l_partkey AS dst, l_partkey FROM line) LEFT JOIN map ON entity_id = l_partkey)
SELECT id, src, rel, dst FROM moved QUALIFY row_number() OVER (PARTITION BY src, rel, dst ORDER BY changed, id) = 1""")
def merged_links(spark, sf_dir):
    """links after a merge, pointed at the entities that are left, each once."""
    return _merged(spark, sf_dir)["link"]


@query(MERGED_SQL + """, more AS (SELECT keeper_id, alias, min((entity_id, i)) AS seen FROM (SELECT keeper_id, entity_id, unnest(range(1, 4)) AS i, unnest([name, aliases[1], aliases[2]]) AS alias FROM entity JOIN map USING (entity_id)) GROUP BY ALL),
taken AS (SELECT keeper_id, list(alias ORDER BY seen) AS more FROM more GROUP BY keeper_id)
SELECT entity_id, name, kind, array_to_string(list_concat(aliases, list_filter(coalesce(more, []), lambda a: NOT list_contains(aliases, a))), '|') AS aliases FROM entity LEFT JOIN taken ON keeper_id = entity_id WHERE entity_id NOT IN (SELECT entity_id FROM map)""")
def merged_entities(spark, sf_dir):
    """the entities that are left after a merge, with the names of those that they absorbed."""
    return _merged(spark, sf_dir)["entity"].withColumn("aliases", F.array_join("aliases", "|"))


@query(MERGED_SQL + """, said AS (SELECT id, l_partkey AS s, l_linestatus AS predicate, CASE WHEN l_returnflag <> 'N' THEN (l_suppkey * 7 + l_partkey) % n + 1 END AS o, l_returnflag AS object_key, l_orderkey // 100 AS document_id FROM line, parts),
moved AS (SELECT id, coalesce(a.keeper_id, s) AS subject_id, predicate, coalesce(b.keeper_id, o) AS object_id, object_key, document_id, a.keeper_id IS NOT NULL OR b.keeper_id IS NOT NULL AS changed FROM said LEFT JOIN map a ON a.entity_id = s LEFT JOIN map b ON b.entity_id = o)
SELECT id, subject_id, predicate, object_id, object_key, document_id FROM moved QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_key, document_id ORDER BY changed, id) = 1""")
def merged_assertions(spark, sf_dir):
    """facts after a merge."""
    return _merged(spark, sf_dir)["assertion"]


@query(MERGED_SQL + " SELECT l_orderkey AS document_id, coalesce(keeper_id, l_partkey) AS entity_id, count(*) AS mentions FROM line LEFT JOIN map ON entity_id = l_partkey GROUP BY ALL")
def merged_mentions(spark, sf_dir):
    """mentions after a merge."""
    return _merged(spark, sf_dir)["mention"].groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("mentions"))


# Documents are orders; their elements are lines, their record has dates; lines mention suppliers, and customers state
# something of suppliers in them. Orders of some customers are deleted, and some suppliers.
REFERENCES = [
    upkeep.Reference("element", "document_id", "document"),
    upkeep.Reference("record", "document_id", "document"),
    upkeep.Reference("record_date", "record_id", "record"),
    upkeep.Reference("mention", "document_id", "document"),
    upkeep.Reference("mention", "entity_id", "entity", nulls=True),
    upkeep.Reference("assertion", "document_id", "document"),
    upkeep.Reference("assertion", "object_id", "entity"),
]
GONE_SQL = "WITH lost AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey % 7 = 3), away AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 1), line AS (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM lost))"


def _deleted(spark, sf_dir) -> upkeep.Library:
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    tables = {
        "document": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        "entity": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "element": line.select("id", F.col("l_orderkey").alias("document_id")),
        "record": t("orders").select((-F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("document_id")),
        "record_date": line.select("id", (-F.col("l_orderkey")).alias("record_id"), F.to_date("l_shipdate").alias("day")),
        "mention": line.select("id", F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("entity_id")),
        "assertion": line.select((F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("id"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_orderkey")).alias("document_id"), F.col("l_suppkey").alias("object_id")).distinct(),
    }
    gone = {"document": t("orders").where("o_custkey % 7 = 3").select(F.col("o_orderkey").alias("id")), "entity": t("supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("id"))}
    return upkeep.deleted(tables, REFERENCES, gone)


@query(GONE_SQL + " SELECT id, l_orderkey AS document_id FROM line")
def cascaded_elements(spark, sf_dir):
    """Elements go with their document."""
    return _deleted(spark, sf_dir)["element"]


@query(GONE_SQL + " SELECT -o_orderkey AS id, o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM lost)")
def cascaded_records(spark, sf_dir):
    """So does its record."""
    return _deleted(spark, sf_dir)["record"]


@query(GONE_SQL + " SELECT id, -l_orderkey AS record_id, CAST(l_shipdate AS DATE) AS day FROM line")
def cascaded_dates(spark, sf_dir):
    """And the dates of that record."""
    return _deleted(spark, sf_dir)["record_date"]


@query(GONE_SQL + " SELECT id, l_orderkey AS document_id, CASE WHEN l_suppkey NOT IN (SELECT id FROM away) THEN l_suppkey END AS entity_id FROM line")
def cascaded_mentions(spark, sf_dir):
    """Mentions go with the document, and lose an entity that goes."""
    return _deleted(spark, sf_dir)["mention"]


@query(GONE_SQL + ", a AS (SELECT DISTINCT l_orderkey * 1000000 + l_suppkey AS id, CASE WHEN l_suppkey % 3 > 0 THEN l_orderkey END AS document_id, l_suppkey AS object_id FROM lineitem) SELECT * FROM a WHERE (document_id IS NULL OR document_id NOT IN (SELECT id FROM lost)) AND object_id NOT IN (SELECT id FROM away)")
def cascaded_assertions(spark, sf_dir):
    """Facts go with the document that states them, or the entity that they are about."""
    return _deleted(spark, sf_dir)["assertion"]


CHANGES = [upkeep.Change("v2_status", "entry", "status", "string", "'unread'"), upkeep.Change("v3_label", "entry", "label", "string", "concat(status, ':', id)")]


@query("""SELECT o_orderkey AS id, o_totalprice AS total, CASE o_orderkey % 3 WHEN 0 THEN 'unread' ELSE o_orderstatus END AS status,
CASE o_orderkey % 3 WHEN 0 THEN 'unread:' || o_orderkey WHEN 1 THEN o_orderstatus || ':' || o_orderkey ELSE o_orderpriority END AS label FROM orders""")
def schema_versions(spark, sf_dir):
    """Files from before and after two changes of a table, read as one."""
    o, folder = table(spark, sf_dir, "orders"), new_table(spark)
    columns = [F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("label")]
    for n in range(3):
        upkeep.migrated(spark, folder, CHANGES[:n])
        upkeep.appended(spark, folder, "entry", o.where(F.col("o_orderkey") % 3 == n).select(*columns[: 2 + n]))
    return upkeep.read(spark, folder, "entry", "id BIGINT, total DOUBLE")
