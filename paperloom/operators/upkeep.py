"""Changes to a library of tables that belong together: merging entities for good, deleting with what depends on it,
versions that appear at once, and schemas that grow."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import checkpointed, dealt

Library = dict[str, DataFrame]


# Merging


def keepers(entities: DataFrame, merged: DataFrame) -> DataFrame:
    """entity_id and keeper_id of each entity (entity_id, name, kind) that another of its kind absorbs, by names and the
    names that they are merged into (name, keeper, kind). Of entities with one name and kind the smallest id stands for the
    name, and keeps the others."""
    first = entities.groupBy("name", "kind").agg(F.min("entity_id").alias("first"))
    into = merged.select("name", "keeper", "kind").join(first.withColumnsRenamed({"name": "keeper", "first": "keeper_id"}), ["keeper", "kind"])
    of = entities.join(into, ["name", "kind"], "left").join(first, ["name", "kind"])
    return of.select("entity_id", F.coalesce("keeper_id", "first").alias("keeper_id")).where("entity_id <> keeper_id")


def repointed(rows: DataFrame, ends: list[str], key: list[str], into: DataFrame, id: str = "id", count: int = 0) -> DataFrame:
    """Rows whose columns `ends` name entities, pointed at the keepers (`into`: entity_id, keeper_id). Where rows meet on the
    unique `key` (none if it is empty), the one that was there before stays, else the one with the smallest id; rows with a
    null in the key never meet, as in SQL. The map has a row for each absorbed entity only, and is joined once for each end.
    Rows are dealt by the key in as many partitions as their `count` calls for."""
    changed = F.lit(False)
    out = rows
    for i, end in enumerate(ends):
        of = into.select(F.col("entity_id").alias(f"__from{i}"), F.col("keeper_id").alias(f"__to{i}"))
        out = out.join(of, F.col(end) == F.col(f"__from{i}"), "left")
        changed = changed | F.col(f"__to{i}").isNotNull()
    pointed = [F.coalesce(F.col(f"__to{ends.index(c)}"), F.col(c)).alias(c) if c in ends else F.col(c) for c in rows.columns]
    out = out.select(*pointed, changed.alias("__changed"))
    if not key:
        return out.select(*rows.columns)
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("__changed", id))
    return dealt(out, count, *key).withColumn("__place", F.when(whole, place).otherwise(1)).where("__place = 1").select(*rows.columns)


def united_aliases(entities: DataFrame, into: DataFrame) -> DataFrame:
    """Entities (entity_id, name, kind, aliases) that are left, each with the names and aliases of those that it absorbed;
    its own first, then the others' in order of their ids, each once."""
    # An entity can absorb very many: their names are put in order by a sort, and gathered as distinct ones only.
    taken = into.join(entities, "entity_id").select("keeper_id", F.col("entity_id").alias("of"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "alias"))
    first = taken.where("alias IS NOT NULL").groupBy("keeper_id", "alias").agg(F.min(F.struct("of", "i")).alias("at"))
    more = first.groupBy(F.col("keeper_id").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("more"))
    left = entities.join(into.select("entity_id"), "entity_id", "left_anti").join(more, "entity_id", "left")
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    return left.select("entity_id", "name", "kind", F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("aliases"))


def merged_library(library: Library, into: DataFrame, count: int = 0) -> Library:
    """The tables entity, link (src, rel, dst; entities as "entity:<id>"), mention (entity_id) and assertion (subject_id,
    object_id) after a merge. `into` must not chain: a keeper is no one's absorbed entity, as `linkage.merged` gives it. Other tables stay. A table
    has `count` rows or fewer, if that is known."""
    out = dict(library)
    out["entity"] = united_aliases(library["entity"], into)
    if "link" in library:
        name = lambda c: F.concat(F.lit("entity:"), F.col(c).cast("string")).alias(c)
        out["link"] = repointed(library["link"], ["src", "dst"], ["src", "rel", "dst"], into.select(name("entity_id"), name("keeper_id")), count=count)
    if "mention" in library:
        out["mention"] = repointed(library["mention"], ["entity_id"], [], into)
    if "assertion" in library:
        out["assertion"] = repointed(library["assertion"], ["subject_id", "object_id"], ["subject_id", "predicate", "object_key", "document_id"], into, count=count)
    return out


# Deleting


class Reference(NamedTuple):
    """Column `column` of `child` names the `id` of `parent`; when that goes, the row goes too, or the column becomes null."""

    child: str
    column: str
    parent: str
    nulls: bool = False


def deleted(library: Library, references: Iterable[Reference], gone: Library) -> Library:
    """The tables without the rows `gone` (by table: id) and all that depends on them, directly or through others.

    Tables are followed from parents to children until nothing new goes, so that tables which refer to each other, or to
    themselves, are right too; each step joins only what went in the step before. Ids that aren't there are no matter.
    """
    references = list(references)
    all_gone: Library = {n: checkpointed(df.select("id").where("id IS NOT NULL").distinct()) for n, df in gone.items()}
    new = dict(all_gone)
    while new:
        found: dict[str, DataFrame] = {}
        for r in references:
            if r.nulls or r.parent not in new:
                continue
            rows = library[r.child].join(new[r.parent].withColumnRenamed("id", r.column), r.column, "left_semi").select("id")
            found[r.child] = found[r.child].union(rows) if r.child in found else rows
        new = {}
        for n, rows in found.items():
            rows = rows.distinct()
            rows = checkpointed(rows.join(all_gone[n], "id", "left_anti") if n in all_gone else rows)
            if not rows.isEmpty():
                new[n] = rows
                all_gone[n] = all_gone[n].union(rows) if n in all_gone else rows
    out = {}
    for n, df in library.items():
        rows = df.join(all_gone[n], "id", "left_anti") if n in all_gone else df
        for r in references:
            if r.nulls and r.child == n and r.parent in all_gone:
                lost = all_gone[r.parent].select(F.col("id").alias(r.column), F.lit(True).alias("__lost"))
                rows = rows.join(lost, r.column, "left").withColumn(r.column, F.when(F.col("__lost").isNull(), F.col(r.column))).drop("__lost")
        out[n] = rows.select(*df.columns)
    return out


# Versions


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if it is there, so that of two writers of one version one fails."""
    hadoop, fs = _files(spark, path)
    out = fs.create(hadoop, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    """The JSON files of a folder by their number."""
    hadoop, fs = _files(spark, folder)
    if not fs.exists(hadoop):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    return {int(n.removesuffix(".json")): f"{folder}/{n}" for n in names if n.endswith(".json") and n[:-5].isdigit()}


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def published(spark: SparkSession, folder: str, library: Library, version: int | None = None) -> int:
    """Writes tables as the next version of a library in `folder`. Tables that aren't given are those of the version before.
    The manifest is written last and names all files, so a reader sees the whole version or the one before; a writer that
    stops on the way leaves nothing that is read. `version`: that which was read; an error if it isn't the latest."""
    versions = _numbered(spark, f"{folder}/manifests")
    latest = max(versions, default=0)
    if version is not None and version != latest:
        raise RuntimeError(f"version {latest} was published since version {version} was read")
    paths = _get(spark, versions[latest]) if latest else {}
    for name, df in library.items():
        paths[name] = f"{folder}/tables/{name}/{latest + 1}-{spark.sparkContext.applicationId}"
        df.write.mode("overwrite").parquet(paths[name])
    _put(spark, f"{folder}/manifests/{latest + 1}.json", json.dumps(paths))
    return latest + 1


def current(spark: SparkSession, folder: str, version: int | None = None) -> tuple[Library, int]:
    """The tables of the latest version of a library, or of the one asked for, and its number; nothing and 0 without one."""
    versions = _numbered(spark, f"{folder}/manifests")
    version = version if version is not None else max(versions, default=0)
    paths = _get(spark, versions[version]) if version else {}
    return {n: spark.read.parquet(p) for n, p in paths.items()}, version


# Schemas


@dataclass(frozen=True)
class Change:
    """A column that a table gets: a type of Spark's, and the value of rows from before, as an SQL expression over the
    columns that they have."""

    name: str
    table: str
    column: str
    type: str
    before: str = "NULL"


def _log(spark: SparkSession, folder: str) -> list[Change]:
    files = _numbered(spark, f"{folder}/changes")
    return [Change(**_get(spark, files[n])) for n in sorted(files)]


def migrated(spark: SparkSession, folder: str, changes: Iterable[Change]) -> list[str]:
    """Records, in order, those changes that aren't recorded yet, and returns their names. A change is known by its name;
    one that was recorded otherwise than it reads now is an error, and so is one that comes before a recorded one. No file
    of a table is rewritten."""
    log, changes, new = _log(spark, folder), list(changes), []
    for i, (was, change) in enumerate(zip(log, changes, strict=False)):
        if was != change:
            raise ValueError(f"change {i + 1} is recorded as {was.name} and reads {change.name}")
    if len({c.name for c in changes}) < len(changes):
        raise ValueError("two changes have one name")
    for n, change in enumerate(changes[len(log) :], len(log) + 1):
        _put(spark, f"{folder}/changes/{n}.json", json.dumps(asdict(change)))
        new.append(change.name)
    return new


def appended(spark: SparkSession, folder: str, table: str, rows: DataFrame) -> None:
    """Adds rows to a table, in files that bear the number of changes recorded by then."""
    rows.write.mode("append").parquet(f"{folder}/tables/{table}/changes={len(_log(spark, folder))}")


def read(spark: SparkSession, folder: str, table: str, columns: str) -> DataFrame:
    """A table of files from before and after changes, as one. `columns`: its first schema, as DDL. Columns that a file
    lacks have what their change says of rows from before; those are filled in order, so that a later one may read an
    earlier one. One scan, whose filters and columns are pushed down."""
    mine = [(n, c) for n, c in enumerate(_log(spark, folder), 1) if c.table == table]
    schema = ", ".join([columns, *(f"`{c.column}` {c.type}" for _, c in mine), "changes INT"])
    df = spark.read.schema(schema).option("basePath", f"{folder}/tables/{table}").parquet(f"{folder}/tables/{table}")
    for n, c in mine:
        df = df.withColumn(c.column, F.when(F.col("changes") < n, F.expr(c.before).cast(c.type)).otherwise(_column(c.column)))
    return df.drop("changes")


def _column(name: str) -> Column:
    return F.col(f"`{name}`")
