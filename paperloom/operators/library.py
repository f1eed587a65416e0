"""A whole library from files: read, understand, sweep, merge, sort, settle and name. Each stage is a published version of the
tables, so that a run which stops anywhere goes on from the stage after the last one that was published.

    run(spark, folder, files, model)

Tables: document, element, record (id: its document's), entity, mention, link, and run, whose one row says what the latest run
has done. A stage reads tables and gives those that it changes; none depends on rows that a stopped run left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import names as N
from paperloom.operators import agenda, elements, graph, linkage, upkeep
from paperloom.operators.upkeep import Library
from paperloom.session import checkpointed

#: Takes documents (document_id, name, text), gives REPLY for each; the seam for a service or a rule.
Model = Callable[[DataFrame], DataFrame]
REPLY = "document_id long, title string, kind string, category string, happened_on date, fields map<string,string>, entities array<struct<name:string,kind:string>>, problem string"
DOCUMENT = "id long, name string, sha256 string, size long, text string, stage string, status string, problem string, display_name string"
SCHEMAS = {
    "document": DOCUMENT,
    "element": "document_id long, position int, tag string, kind string, depth int, text string",
    "record": "id long, title string, kind string, category_hint string, category string, happened_on date, fields map<string,string>",
    "entity": "entity_id long, name string, kind string, aliases array<string>",
    "mention": "id long, document_id long, surface string, entity_id long, resolved_by string",
    "link": "id long, src string, rel string, dst string",
}
COUNTS = "run long, stage string, files long, read long, present long, rejected long, understood long, not_understood long"


def _numbered(rows: DataFrame, order: list[str], after: DataFrame, id: str) -> DataFrame:
    """Rows with ids from the next free one on, in order; `after` has the ids in use. No task gets all rows."""
    last = after.agg(F.coalesce(F.max(id), F.lit(0)).alias("last")).first()[0]
    keyed = rows.withColumn("__key", F.lit(0)).withColumn("__order", F.struct(*order))
    return agenda.ranked(keyed, "__key", "__order").withColumn(id, F.col("place").cast("long") + last).drop("__key", "__order", "place")


def _record_id(end: Column) -> Column:
    return F.regexp_extract(end, r"^record:(\d+)$", 1).try_cast("long")


def read(tables: Library, files: DataFrame) -> tuple[Library, dict[str, int]]:
    """Documents and elements of `files` (name, text) whose content isn't there yet, in order of name and content.

    Contents are the same if their hashes are; of equal ones the smallest name counts. Null and empty texts are rejected,
    documents without any element are kept as failed. Also how many files were read, were present, or were rejected.
    """
    rows = files.select("name", "text", F.sha2("text", 256).alias("sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    first = rows.where("size > 0").groupBy("sha256", "size").agg(F.min("text").alias("text"), F.min("name").alias("name"))
    new = first.join(tables["document"].select("sha256"), "sha256", "left_anti")
    new = checkpointed(_numbered(new, ["name", "sha256"], tables["document"], "id"))
    made = checkpointed(elements.markdown_blocks(new.select(F.col("id").alias("document_id"), "text")))
    whole = new.join(made.select(F.col("document_id").alias("id")).distinct().withColumn("whole", F.lit(True)), "id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    problem = F.when(~F.col("whole"), "no readable text")
    documents = whole.select("id", "name", "sha256", "size", "text", F.lit("rendered").alias("stage"), F.when(F.col("whole"), "ok").otherwise("failed").alias("status"), problem.alias("problem"), F.lit(None).cast("string").alias("display_name"))
    count = rows.agg(F.count("*").alias("files"), F.count_if(F.col("size") == 0).alias("rejected")).first().asDict()
    count["read"] = new.count()
    count["present"] = count["files"] - count["rejected"] - count["read"]
    return {"document": tables["document"].unionByName(documents), "element": tables["element"].unionByName(made.select(*tables["element"].columns))}, count


def _backlog(documents: DataFrame) -> DataFrame:
    return documents.where("stage = 'rendered' AND status <> 'failed'")


def understand(tables: Library, model: Model) -> tuple[Library, dict[str, int]]:
    """Records, mentions, entities and links of the documents that were read and not yet understood.

    One with a problem, or without a reply, keeps its text and stays to be understood by a later run. A reply takes the place
    of what was known of its document. Mentions mean entities as `linkage.resolved` says; a name that means none becomes one,
    of the kind that it has in its first document. Names that are empty once normalized are no mentions.
    """
    todo = checkpointed(_backlog(tables["document"]).select(F.col("id").alias("document_id"), "name", "text"))
    replies = checkpointed(todo.select("document_id").join(model(todo), "document_id", "left").withColumn("problem", F.when(F.col("title").isNull(), F.coalesce("problem", F.lit("no reply"))).otherwise(F.col("problem"))))
    good = replies.where("problem IS NULL")
    record = good.select(F.col("document_id").alias("id"), "title", "kind", F.col("category").alias("category_hint"), F.lit(graph.HOLDING).alias("category"), "happened_on", "fields")
    said = good.select("document_id", F.explode("entities").alias("e")).select("document_id", F.col("e.name").alias("surface"), F.col("e.kind").alias("kind")).distinct()
    said = said.withColumn("name", N.normalized(F.col("surface"))).where("name <> ''")
    said = checkpointed(said.withColumn("mention_id", F.xxhash64("document_id", "surface", "kind")))
    told = checkpointed(linkage.resolved(said.select("mention_id", "document_id", "name", "kind"), tables["entity"].select("entity_id", "name", "kind")))
    open = said.join(told.where("entity_id IS NULL").select("mention_id"), "mention_id")
    made = open.groupBy("name").agg(F.min_by("kind", F.struct("document_id", "kind")).alias("kind"))
    made = checkpointed(_numbered(made, ["name"], tables["entity"], "entity_id"))
    mention = said.join(told, "mention_id").join(made.select("name", F.col("entity_id").alias("made")), "name", "left")
    mention = mention.select(F.col("mention_id").alias("id"), "document_id", "surface", F.coalesce("entity_id", "made").alias("entity_id"), F.coalesce("resolved_by", F.lit("new")).alias("resolved_by"))
    mention = checkpointed(mention)
    ends = mention.select(F.concat(F.lit("record:"), F.col("document_id").cast("string")).alias("src"), F.lit("names").alias("rel"), F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("dst")).distinct()
    link = ends.withColumn("id", F.xxhash64("src", "rel", "dst"))
    read_again = good.select(F.col("document_id").alias("id"))
    old_link = tables["link"].join(read_again.select(F.concat(F.lit("record:"), F.col("id").cast("string")).alias("src")), "src", "left_anti")
    states = replies.select(F.col("document_id").alias("id"), F.col("problem").alias("found"), F.lit(True).alias("asked"))
    document = tables["document"].join(states, "id", "left")
    asked = F.col("asked").isNotNull()
    document = document.withColumn("stage", F.when(asked & F.col("found").isNull(), "understood").otherwise(F.col("stage"))).withColumn("problem", F.when(asked, F.col("found")).otherwise(F.col("problem")))
    out = {
        "document": document.select(*tables["document"].columns),
        "record": elements.replaced(tables["record"], record, ["id"]),
        "entity": tables["entity"].unionByName(made.select("entity_id", "name", "kind", F.array().cast("array<string>").alias("aliases"))),
        "mention": tables["mention"].join(read_again.withColumnRenamed("id", "document_id"), "document_id", "left_anti").unionByName(mention),
        "link": old_link.unionByName(link),
    }
    count = replies.agg(F.count_if(F.isnull("problem")).alias("understood"), F.count("problem").alias("not_understood")).first().asDict()
    return out, count


def sweep(tables: Library) -> Library:
    """Links without those of records that are gone."""
    of = tables["link"].withColumn("__id", _record_id(F.col("src")))
    gone = of.where("__id IS NOT NULL").join(tables["record"].select(F.col("id").alias("__id")), "__id", "left_anti").select("id")
    return {"link": tables["link"].join(gone, "id", "left_anti")}


def consolidate(tables: Library) -> Library:
    """Entities of one kind that are the same thing are one, wherever they are named."""
    names = tables["entity"].select("name", "kind").distinct()
    kept = linkage.merged(names, linkage.same_thing(linkage.merge_pairs(names, "kind")), "kind")
    out = upkeep.merged_library({n: tables[n] for n in ("entity", "link", "mention")}, checkpointed(upkeep.keepers(tables["entity"], kept)))
    return {n: out[n].select(*tables[n].columns) for n in out}


def _ends(link: DataFrame) -> DataFrame:
    return link.select(_record_id(F.col("src")).alias("record_id"), F.regexp_extract("dst", r"^entity:(\d+)$", 1).try_cast("long").alias("entity_id")).where("record_id IS NOT NULL AND entity_id IS NOT NULL")


def organize(tables: Library) -> Library:
    """Categories of records: groups by what they share and how alike they are, named by their votes."""
    record = tables["record"]
    said = F.concat_ws(" ", *(["title", "kind"] * 3), F.array_join(F.map_keys("fields"), " "), F.array_join(F.map_values("fields"), " "))
    tied = graph.ties(_ends(tables["link"]), record.select(F.col("id").alias("record_id")), record.select("id", said.alias("text")))
    label = graph.communities(tied).withColumnRenamed("record_id", "id")
    grouped = checkpointed(record.join(label, "id", "left").withColumn("group_id", F.coalesce("label", "id")))
    named = graph.voted(grouped.select("group_id", F.col("category_hint").alias("value"), "kind"))
    return {"record": grouped.drop("category").join(named.select("group_id", "category"), "group_id").select(*record.columns)}


def settle(tables: Library, model: Model) -> Library:
    """Records whose fields are unlike their category's are read again (`graph.settled`), which replaces all that a reply says
    of them but whom they name; nothing is changed by a reply with a problem. Categories are those from before."""
    latest = tables["record"]
    docs = tables["document"].select(F.col("id").alias("document_id"), "name", "text")

    def reread(bad: DataFrame) -> DataFrame:
        nonlocal latest
        told = model(docs.join(bad.select(F.col("record_id").alias("document_id")), "document_id", "left_semi")).where("problem IS NULL AND title IS NOT NULL")
        told = told.join(bad.select(F.col("record_id").alias("document_id"), F.col("category").alias("now")), "document_id")
        new = checkpointed(told.select(F.col("document_id").alias("id"), "title", "kind", F.col("category").alias("category_hint"), F.col("now").alias("category"), "happened_on", "fields"))
        latest = checkpointed(elements.replaced(latest, new, ["id"]))
        return new.select("category", F.col("id").alias("record_id"), F.explode(F.map_keys("fields")).alias("field"))

    graph.settled(latest.select("category", F.col("id").alias("record_id"), F.explode(F.map_keys("fields")).alias("field")), reread)
    return {"record": latest.select(*tables["record"].columns)}


def name(tables: Library) -> Library:
    """Display names of all understood documents, in order of ids: day, title and, if there is one, a party that the document
    names (organizations before persons, then by name). The extension stays; documents without a record keep their names."""
    rank = F.when(F.col("kind") == "org", 0).when(F.col("kind") == "person", 1)
    party = _ends(tables["link"]).join(tables["entity"].select("entity_id", "name", rank.alias("rank")).where("rank IS NOT NULL"), "entity_id")
    party = party.groupBy(F.col("record_id").alias("id")).agg(F.min(F.struct("rank", "name")).alias("p")).select("id", F.initcap("p.name").alias("party"))
    of = tables["document"].select("id", "name").join(tables["record"].select("id", "title", "happened_on"), "id", "left").join(party, "id", "left")
    proposed = F.concat(agenda.proposed_name(F.col("happened_on"), F.col("title"), F.col("party"), ""), F.coalesce(F.regexp_extract("name", r"(\.[^.]*)$", 1), F.lit("")))
    unique = agenda.unique_names(of.select("id", F.coalesce(proposed, "name").alias("name"))).withColumnRenamed("unique_name", "display_name")
    return {"document": tables["document"].drop("display_name").join(unique, "id", "left").select(*tables["document"].columns)}


STAGES = ["read", "understand", "sweep", "consolidate", "organize", "settle", "organize again", "name"]


def run(spark: SparkSession, folder: str, files: DataFrame, model: Model) -> dict:
    """Takes `files` (name, text) into the library in `folder`, and returns the row of its run.

    A run that stopped is finished first. Where nothing is new and nothing waits to be understood, nothing else is done.
    Each stage publishes its tables together with its place in the run, so it is done as a whole or not at all.
    """
    tables, _ = upkeep.current(spark, folder)
    last = tables["run"].first().asDict() if "run" in tables else None
    if last and last["stage"] != STAGES[-1]:
        last = _from(spark, folder, last, None, model)
    began = {"run": last["run"] + 1 if last else 1, "stage": None, "files": 0, "read": 0, "present": 0, "rejected": 0, "understood": 0, "not_understood": 0}
    return _from(spark, folder, began, files, model)


def _from(spark: SparkSession, folder: str, state: dict, files: DataFrame | None, model: Model) -> dict:
    stages = STAGES[STAGES.index(state["stage"]) + 1 if state["stage"] else 0 :]
    for stage in stages:
        tables, version = upkeep.current(spark, folder)
        tables = {n: tables[n] if n in tables else spark.createDataFrame([], schema) for n, schema in SCHEMAS.items()}
        counts: dict[str, int] = {}
        if stage == "read":
            changed, counts = read(tables, files)
            if not counts["read"] and _backlog(tables["document"]).isEmpty():
                stage = STAGES[-1]
        elif stage == "understand":
            changed, counts = understand(tables, model)
        elif stage == "settle":
            changed = settle(tables, model)
        else:
            changed = {"sweep": sweep, "consolidate": consolidate, "organize": organize, "organize again": organize, "name": name}[stage](tables)
        state = state | counts | {"stage": stage}
        row = spark.createDataFrame([tuple(state[c.split()[0]] for c in COUNTS.split(", "))], COUNTS)
        upkeep.published(spark, folder, changed | {"run": row.coalesce(1)}, version)
        if stage == STAGES[-1]:
            break
    return state
