"""Texts are worked through once, however many names, tokens or items they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import gate
from paperloom.functions import text as T
from paperloom.operators import agenda, elements, replies


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_lower_cases_a_text_once(spark):
    text = "Sworn before Ann Bly, in California: the Tenant paid Acme Inc. for what was far below, and for nothing else at all; Zed Ltd."
    names = ["Ann Bly", "Tenant", "California", "Acme", "Zed", "nobody at all", " 12 ", "!!", "x", None]
    docs = spark.createDataFrame([(1, text, names), (2, None, ["Acme"]), (3, text, [])], "doc_id long, text string, names array<string>")
    out = gate.gated(docs, "doc_id")
    said = {(r["doc_id"], r["name"]): r["refused"] for r in out.collect()}
    role, seen = "named as the sworn before", "not in the document"
    assert said == {(1, n): w for n, w in zip(names, [role, "generic role", role, role, None, seen, "no letters", "too short", "too short", "too short"], strict=True)} | {(2, "Acme"): seen}
    above, below = plan_of(out).split("Generate")
    assert "coalesce(text" in below and "coalesce(text" not in above


def test_plain_code_is_one_token(spark):
    """However long: a token isn't a word or a character, to be put together again."""
    text = "Über die Felder, 3 for / 2 foreign_in # x // y\n" + "plain - words + and_other ; " * 20_000
    rows = spark.createDataFrame([(text, None), (text, "python"), ("//", "py"), ("# a", "js"), ("/", ""), ("a /* b", "")], "code string, language string")
    out = replies.highlighted(rows, language="language")
    got = [[(s.text, s.kind) for s in r.spans] for r in out.collect()]
    assert [len(x) for x in got[:2]] == [9, 9]
    assert got[0][:7] == [("Über die Felder, ", "plain"), ("3", "number"), (" ", "plain"), ("for", "keyword"), (" / ", "plain"), ("2", "number"), (" foreign_in # x ", "plain")]
    assert got[2:] == [[("//", "plain")], [("# a", "plain")], [("/", "plain")], [("a ", "plain"), ("/* b", "comment")]]
    assert "slice(" not in plan_of(out)


def test_items_are_split_once_and_where_bullets_are(spark):
    rows = spark.createDataFrame([("• one • \t\n • • two ·\nthree ",), (" •\n• a • bcd",), ("one • two • three •",), ("• one • two",), (None,), ("• a b •   • " + " " * 50_000 + "xyz",)], "text string")
    out = rows.where(T.has_bullet_items(F.col("text"))).select(T.bullet_items(F.col("text")).alias("items"))
    assert [r["items"] for r in out.collect()] == [["one", "two", "three"], ["bcd"], ["a b", "xyz"]]
    assert plan_of(out).count("split(") == 1
    assert spark.range(1).select(T.trimmed(F.lit(" \t\n\x0b\f\r x y \n"))).first()[0] == "x y"


def test_reading_order_shuffles_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, i, 0.05 if i % 2 else 0.6, i / 10, 0.3) for i in range(6)] + [(2, i, 0.1, None if i == 2 else 0.5, 0.9) for i in range(5)] + [(3, i, 0.1 * i, 0.5, 0.8) for i in range(4)]
        out = elements.reading_order(spark.createDataFrame(rows, "page_id long, position int, x double, y double, width double"))
        got = {p: [r["position"] for r in sorted(out.where(f"page_id = {p}").collect(), key=lambda r: r["place"])] for p in (1, 2, 3)}
        assert got == {1: [1, 3, 5, 0, 2, 4], 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3]}
        assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def counting(spark, df, read):
    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_findings_are_made_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = [(1, "b"), (1, "a"), (2, "c"), (2, None), (3, "d"), (4, "e"), (4, "a"), (4, "a")]
    top = agenda.flagged(counting(spark, spark.createDataFrame(rows, "document_id long, detail string"), read), limit=3).collect()
    assert [(r["document_id"], r["findings"], r["details"]) for r in top] == [(4, 3, ["a", "a", "e"]), (1, 2, ["a", "b"]), (2, 2, ["c"])]
    assert read.value == len(rows)
