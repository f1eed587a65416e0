"""Merges, cascades, versions and schemas on small tables with odd rows."""

import json

import pytest

from paperloom.operators import upkeep
from paperloom.operators.upkeep import Change, Reference


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def library(spark):
    t = spark.createDataFrame
    return {
        "entity": t([(1, "alcon laboratories", "org", ["Alcon Labs"]), (2, "alcon", "org", ["ALC", "Alcon Labs"]), (3, "alcon", "person", None), (4, "alcon lab", "org", []), (5, "alcon", "org", ["x"])], "entity_id long, name string, kind string, aliases array<string>"),
        "link": t([(1, "record:1", "names", "entity:2"), (2, "record:1", "names", "entity:1"), (3, "record:2", "names", "entity:4"), (4, "record:2", "names", "entity:2"), (5, "entity:2", "knows", "entity:3"), (6, None, "names", "entity:2"), (7, None, "names", "entity:1"), (8, "entity:4", "knows", "entity:2")], "id long, src string, rel string, dst string"),
        "mention": t([(1, 10, 2), (2, 10, None), (3, 11, 3), (1, 12, 5)], "id long, document_id long, entity_id long"),
        "assertion": t([(1, 2, "runs", 4, "k", 10), (2, 1, "runs", 1, "k", 10), (3, 4, "runs", None, "k", None), (4, 1, "runs", None, "k", None)], "id long, subject_id long, predicate string, object_id long, object_key string, document_id long"),
        "other": t([(1,)], "id long"),
    }


def test_a_merge_reaches_all_tables(spark, library):
    kept = spark.createDataFrame([("alcon laboratories", "alcon laboratories", "org"), ("alcon", "alcon laboratories", "org"), ("alcon lab", "alcon laboratories", "org"), ("alcon", "alcon", "person")], "name string, keeper string, kind string")
    into = upkeep.keepers(library["entity"], kept)
    assert rows(into) == [(2, 1), (4, 1), (5, 1)]
    out = upkeep.merged_library(library, into)
    assert rows(out["entity"]) == [(1, "alcon laboratories", "org", ["Alcon Labs", "alcon", "ALC", "alcon lab", "x"]), (3, "alcon", "person", [])]
    assert rows(out["link"]) == sorted([(2, "record:1", "names", "entity:1"), (3, "record:2", "names", "entity:1"), (5, "entity:1", "knows", "entity:3"), (6, None, "names", "entity:1"), (7, None, "names", "entity:1"), (8, "entity:1", "knows", "entity:1")], key=repr)
    assert rows(out["mention"]) == sorted([(1, 10, 1), (2, 10, None), (3, 11, 3), (1, 12, 1)], key=repr)
    assert rows(out["assertion"]) == sorted([(2, 1, "runs", 1, "k", 10), (3, 1, "runs", None, "k", None), (4, 1, "runs", None, "k", None)], key=repr)
    assert out["other"] is library["other"]
    nothing = upkeep.merged_library(library, into.limit(0))
    assert rows(nothing["link"]) == rows(library["link"]) and nothing["entity"].count() == 5
    empty = upkeep.merged_library({n: df.limit(0) for n, df in library.items()}, into)
    assert all(empty[n].count() == 0 and empty[n].columns == library[n].columns for n in ("entity", "link", "mention", "assertion"))


def test_deleting_follows_references(spark):
    t = spark.createDataFrame
    tables = {
        "document": t([(1, None), (2, None), (3, None)], "id long, extra string"),
        "record": t([(10, 1), (20, 2), (30, None)], "id long, document_id long"),
        "date": t([(100, 10), (200, 20), (300, 30), (300, 30)], "id long, record_id long"),
        "entity": t([(5,), (6,)], "id long"),
        "mention": t([(1, 1, 5), (2, 2, 5), (3, 2, 6), (4, None, None)], "id long, document_id long, entity_id long"),
        "folder": t([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "id long, parent_id long"),
        "left": t([(7, 2), (8, 9)], "id long, right_id long"),
        "right": t([(2, 8), (9, 7)], "id long, left_id long"),
    }
    references = [Reference("record", "document_id", "document"), Reference("date", "record_id", "record"), Reference("mention", "document_id", "document"), Reference("mention", "entity_id", "entity", nulls=True), Reference("folder", "parent_id", "folder"), Reference("left", "right_id", "right"), Reference("right", "left_id", "left")]
    one = lambda *ids: t([(i,) for i in ids], "id long")
    out = upkeep.deleted(tables, references, {"document": one(1, 77, None), "entity": one(5), "folder": one(2), "left": one(7)})
    assert rows(out["document"]) == [(2, None), (3, None)]
    assert rows(out["record"]) == [(20, 2), (30, None)]
    assert rows(out["date"]) == [(200, 20), (300, 30), (300, 30)]
    assert rows(out["mention"]) == [(2, 2, None), (3, 2, 6), (4, None, None)]
    assert rows(out["folder"]) == [(1, None), (5, None)]
    assert rows(out["left"]) == [] and rows(out["right"]) == []
    same = upkeep.deleted(tables, references, {"document": one()})
    assert all(rows(same[n]) == rows(tables[n]) for n in tables)


def test_versions_appear_whole(spark, tmp_path, monkeypatch):
    folder, t = f"file://{tmp_path}/library", spark.createDataFrame
    assert upkeep.current(spark, folder) == ({}, 0)
    a, b = t([(1,)], "x int"), t([(2,)], "y int")
    assert upkeep.published(spark, folder, {"a": a, "b": b}) == 1
    tables, version = upkeep.current(spark, folder)
    # A writer that stops before its manifest leaves what was there.
    with monkeypatch.context() as m:
        m.setattr(upkeep, "_put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            upkeep.published(spark, folder, {"a": t([(7,)], "x int")})
    assert [rows(df) for df in upkeep.current(spark, folder)[0].values()] == [[(1,)], [(2,)]]
    assert upkeep.published(spark, folder, {"a": tables["a"].selectExpr("x + 10 AS x")}, version) == 2
    with pytest.raises(RuntimeError, match="version 2"):
        upkeep.published(spark, folder, {"a": a}, version)
    now, version = upkeep.current(spark, folder)
    assert (rows(now["a"]), rows(now["b"]), version) == ([(11,)], [(2,)], 2)
    assert rows(upkeep.current(spark, folder, 1)[0]["a"]) == [(1,)]


def test_schemas_grow(spark, tmp_path):
    folder, t = f"file://{tmp_path}/grown", spark.createDataFrame
    changes = [Change("v2", "note", "day", "date", "date '2020-01-01'"), Change("v3", "note", "label", "string", "concat(text, '/', day)"), Change("v4", "other", "z", "int")]
    assert upkeep.migrated(spark, folder, []) == []
    upkeep.appended(spark, folder, "note", t([(1, "a"), (2, None)], "id long, text string"))
    assert upkeep.migrated(spark, folder, changes[:1]) == ["v2"]
    upkeep.appended(spark, folder, "note", t([(3, "c")], "id long, text string").selectExpr("*", "date '2024-05-06' AS day"))
    assert upkeep.migrated(spark, folder, changes) == ["v3", "v4"]
    assert upkeep.migrated(spark, folder, changes) == []
    upkeep.appended(spark, folder, "note", t([(4, "d", "own")], "id long, text string, label string").selectExpr("id", "text", "cast(null AS date) AS day", "label"))
    df = upkeep.read(spark, folder, "note", "id BIGINT, text STRING")
    assert [(r.id, r.text, str(r.day), r.label) for r in df.orderBy("id").collect()] == [(1, "a", "2020-01-01", "a/2020-01-01"), (2, None, "2020-01-01", None), (3, "c", "2024-05-06", "c/2024-05-06"), (4, "d", "None", "own")]
    assert df.columns == ["id", "text", "day", "label"]
    assert len(list((tmp_path / "grown/changes").glob("*.json"))) == 3
    assert json.loads((tmp_path / "grown/changes/1.json").read_text())["name"] == "v2"
    for bad in ([Change("v2", "note", "day", "string")], [*changes[:2], Change("v9", "note", "y", "int"), changes[2]], [*changes, changes[0]]):
        with pytest.raises(ValueError):
            upkeep.migrated(spark, folder, bad)
