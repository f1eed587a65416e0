"""A whole library, run at once, in parts, and stopped on the way."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import library, upkeep

TABLES = list(library.SCHEMAS)


def model(docs):
    """Title, kind, day, fields and names as lines of the text say."""
    line = lambda word: F.nullif(F.regexp_extract("text", rf"(?m)^{word}: (.*)$", 1), F.lit(""))
    named = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^(?:org|person): (.*)$"), F.lit(0)), lambda x: F.struct(F.split_part(x, F.lit(": "), F.lit(2)).alias("name"), F.split_part(x, F.lit(": "), F.lit(1)).alias("kind")))
    fields = F.map_from_arrays(F.regexp_extract_all("text", F.lit(r"(?m)^f (\w+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^f \w+ (\w+)"), F.lit(1)))
    return docs.select("document_id", line("title").alias("title"), line("kind").alias("kind"), line("category").alias("category"), line("day").try_cast("date").alias("happened_on"), fields.alias("fields"), named.alias("entities"), line("problem").alias("problem")).where("text NOT LIKE '%silent%'")


def invoice(n, who="Apex Metals Ltd"):
    return f"title: invoice for metal plates\nkind: invoice\ncategory: Bills\nday: 2024-01-0{n}\norg: {who}\nperson: Nora Quill\nf total {n}\nf due soon"


FILES = [
    ("a.md", invoice(1)), ("b.md", invoice(2, "Apex Metals")), ("c.md", invoice(3)), ("copy of c.md", invoice(3)), ("d.md", "title: diary of a walk\nkind: diary\nperson: Osbert Finch"),
    ("empty.md", ""), ("none.md", None), ("blank.md", " \n\n "), ("e.md", invoice(1) + "\nmore"), (None, invoice(4)),
    *((f"note {i}.md", f"title: note {'abcdefghijkl'[i] * 4}\nkind: note\norg: {'abcdefghijkl'[i] * 5} Works") for i in range(9)),
]


def rows(spark, folder):
    tables, _ = upkeep.current(spark, folder)
    return {n: sorted(map(str, tables[n].collect())) for n in TABLES}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "name string, text string")


@pytest.fixture(scope="module")
def whole(spark, files, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('whole')}"
    state = library.run(spark, folder, files, model)
    return folder, state, rows(spark, folder)


def test_whole_library(spark, files, whole):
    folder, state, before = whole
    assert state == {"run": 1, "stage": "name", "files": 19, "read": 16, "present": 1, "rejected": 2, "understood": 15, "not_understood": 0}
    tables, version = upkeep.current(spark, folder)
    docs = {r.name: r for r in tables["document"].collect()}
    assert (docs["blank.md"].status, docs["blank.md"].problem) == ("failed", "no readable text")
    assert [r.name for r in tables["entity"].where("name NOT LIKE '%works'").orderBy("name").collect()] == ["apex metals", "nora quill", "osbert finch"]
    assert {r.category for r in tables["record"].where("kind = 'invoice'").collect()} == {"Bills"}
    assert [r.category for r in tables["record"].where("kind = 'diary'").collect()] == ["Everything else"]
    assert docs["a.md"].display_name == "2024-01-01 Invoice for metal plates — Apex Metals.md" and docs["e.md"].display_name == "2024-01-01 Invoice for metal plates — Apex Metals (2).md"
    assert docs["blank.md"].display_name == "blank.md" and docs["d.md"].display_name == "Diary of a walk — Osbert Finch.md"
    apex = tables["entity"].where("name = 'apex metals'").first().entity_id
    assert tables["link"].where(f"dst = 'entity:{apex}'").count() == 5 and tables["mention"].count() == 20 and tables["entity"].count() == 12
    # Nothing new and nothing that waits: only the reading is done.
    again = library.run(spark, folder, files.where("name LIKE 'c%'"), model)
    assert (again["run"], again["stage"], again["read"], again["present"]) == (2, "name", 0, 2)
    assert rows(spark, folder) == before and upkeep.current(spark, folder)[1] == version + 1


def test_a_stopped_run_goes_on(spark, files, whole, tmp_path, monkeypatch):
    def stops(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="stopped"):
        m.setattr(library, "consolidate", stops)
        library.run(spark, f"file://{tmp_path}", files, model)
    # The run is finished by the next one, whatever that is given.
    state = library.run(spark, f"file://{tmp_path}", files.limit(0), model)
    assert state["run"] == 2 and rows(spark, f"file://{tmp_path}") == whole[2]


def test_reading_and_understanding_in_parts(spark):
    tables = {n: spark.createDataFrame([], schema) for n, schema in library.SCHEMAS.items()}
    read = lambda rows: library.read(tables, spark.createDataFrame(rows, "name string, text string"))
    changed, counts = read([])
    assert counts == {"files": 0, "rejected": 0, "read": 0, "present": 0} and changed["document"].count() == 0
    tables |= read([("b", "person: Al Fo\ntitle: x"), ("a", "silent"), ("a2", "silent"), ("gap", " ")])[0]
    changed, counts = read([("b again", "silent"), ("0", "problem: too long\ntitle: y"), ("z", ""), (None, None)])
    tables |= changed
    assert counts == {"files": 4, "rejected": 2, "read": 1, "present": 1}
    assert [(r.id, r.name, r.status) for r in tables["document"].orderBy("id").collect()] == [(1, "a", "ok"), (2, "b", "ok"), (3, "gap", "failed"), (4, "0", "ok")]
    changed, counts = library.understand(tables, model)
    assert counts == {"understood": 1, "not_understood": 2} and [tuple(r) for r in changed["entity"].collect()] == [(1, "al fo", "person", [])]
    assert [(r.id, r.stage, r.problem) for r in changed["document"].orderBy("id").collect()] == [(1, "rendered", "no reply"), (2, "understood", None), (3, "rendered", "no readable text"), (4, "rendered", "too long")]
    # A link whose record is gone goes; others stay.
    gone = changed["link"].selectExpr("id + 1 AS id", "'record:99' AS src", "rel", "dst").union(changed["link"].selectExpr("id + 2 AS id", "'entity:1' AS src", "rel", "dst"))
    swept = library.sweep({"record": changed["record"], "link": changed["link"].select("id", "src", "rel", "dst").union(gone)})["link"]
    assert sorted(r.src for r in swept.collect()) == ["entity:1", "record:2"]
