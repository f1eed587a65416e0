"""Operators on tables that are empty, or have nulls, ties and repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from paperloom.operators import graph, linkage, retrieval


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_conflicts(spark):
    day = dt.date(2024, 1, 1)
    table = [(1, "rent", "$1,200.00", day, 1), (1, "rent", "1200.0 ", day, 2), (2, "rent", "900", day, 1), (2, "rent", "950", day, 2), (2, "rent", "950", day, 2), (3, "rent", None, day, 1), (3, "rent", "5", day, 2), (4, "rent", "1", None, 1), (4, "rent", "2", day, 1), (None, "rent", "1", day, 1)]
    df = spark.createDataFrame(table, "entity_id int, field string, value string, day date, record_id int")
    got = {r.entity_id: (r.oldest, r.newest) for r in linkage.conflicts(df).collect()}
    assert got[2] == ("900", "950") and 1 not in got and 3 not in got and None not in got
    assert linkage.conflicts(df.limit(0)).count() == 0


def test_salient(spark):
    df = spark.createDataFrame([(1, f"n{i:02}", 0.5, 1) for i in range(20)] + [(2, None, None, None), (2, "a", 0.5, 3), (2, "a", 0.5, 3)], "document_id int, name string, confidence double, mentions int")
    out = linkage.salient(df)
    assert [r.name for r in out.where("document_id = 1 AND admitted").orderBy("place").collect()] == [f"n{i:02}" for i in range(15)]
    assert [r.name for r in out.where("document_id = 2").orderBy("place").collect()] == ["a", "a", None]
    assert linkage.salient(df.limit(0)).count() == 0


def test_aliases_and_surnames(spark):
    df = spark.createDataFrame([(1, "A b", "a b", 2), (1, "a B", "a b", 1), (1, "a B", "a b", 1), (1, None, None, 0), (2, "x", "x", 5)], "entity_id int, spelling string, normalized string, seen int")
    got = {r.entity_id: r.aliases for r in linkage.aliases(df).collect()}
    assert got == {1: ["a B"], 2: ["x"]}
    names = spark.createDataFrame([("ann lee",), ("bo lee",), ("lee",), ("",), (None,)], "name string")
    assert {r.name: r.sharing for r in linkage.surname_frequency(names).collect()} == {"ann lee": 3, "bo lee": 3, "lee": 3}
    assert linkage.aliases(df.limit(0)).count() == 0 and linkage.surname_frequency(names.limit(0)).count() == 0


def test_layers_and_citations(spark):
    a, b = spark.createDataFrame([(1, -2.0), (2, -1.0)], "doc_id int, score double"), spark.createDataFrame([(2, -9.0), (3, -1.0), (4, -1.0)], "doc_id int, score double")
    assert [(r.doc_id, r.layer) for r in retrieval.layered([a, b]).collect()] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert [r.doc_id for r in retrieval.layered([a.limit(0), b], limit=2).collect()] == [2, 3]
    cited = spark.createDataFrame([(1, "see [d1:e2] and d1:e2, d9:e9"), (2, None), (3, "")], "answer_id int, text string")
    known = spark.createDataFrame([(1, "e2"), (1, "e2"), (None, None)], "document_id long, tag string")
    assert rows(retrieval.verified(cited, known).select("answer_id", "token", "invented")) == [(1, "d1:e2", False), (1, "d9:e9", True)]
    assert retrieval.verified(cited, known.limit(0)).where("invented").count() == 2 and retrieval.verified(cited.limit(0), known).count() == 0


def test_measures_without_positives(spark):
    df = spark.createDataFrame([(False, True), (False, False)], "predicted boolean, actual boolean")
    r = linkage.measures(df).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (0, 0, 1, None, 0.0)
    assert linkage.measures(df.limit(0)).first().precision is None


def test_graph_of_nothing(spark):
    links, records = spark.createDataFrame([], "record_id long, entity_id long"), spark.createDataFrame([], "record_id long")
    assert graph.reach(links).count() == 0 and graph.owner(links, records).count() == 0 and graph.ties(links, records).count() == 0
    assert graph.alike(spark.createDataFrame([], "id long, text string")).count() == 0
    texts = spark.createDataFrame([(1, "granite marble basalt"), (1, "granite marble"), (2, "granite marble basalt"), (None, "granite"), (3, None), (4, ""), (5, "other words entirely")], "id long, text string")
    assert [(r.a, r.b) for r in graph.alike(texts).collect()] == [(1, 2)]
    fields = spark.createDataFrame([(None, 1, "x"), ("", 2, "x"), ("a", 3, "y"), ("a", 4, "z")], "category string, record_id long, field string")
    assert graph.coherence(fields).first()[0] == 0.5 and graph.coherence(fields.limit(0)).first()[0] == 1.0


def test_names_that_are_odd(spark):
    names = spark.createDataFrame([("",), (None,), ("a b c",), ("a b d",), ("j r",), ("j smith",), ("john s",), ("a b c d e f g",), ("anna b c d e f g",), ("ann lee",), ("ann lee",), ("x" * 60,), ("x" * 59 + "y",), ("counterrevolutionary",), ("counterrevolutionari",), ("ounterrevolutionary",)], "name string")
    plain = [r.name for r in names.where("name <> ''").distinct().collect()]
    every = spark.createDataFrame([(a, b) for a in plain for b in plain if a < b], "a string, b string")
    found, whole = ({tuple(r) for r in linkage.matched(p).collect()} for p in (linkage.ladder_pairs(names), every))
    assert found == whole and ("j smith", "john s", "initials") in found
    assert linkage.ladder_pairs(names.limit(0)).count() == 0
    sided = names.where("name <> ''").withColumn("side", F.when(F.col("name").startswith("j"), 1).otherwise(2))
    assert linkage.ladder_pairs(sided, sides=True).where("side_a = side_b").count() == 0
