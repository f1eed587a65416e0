"""Lenient replies, fenced blocks and tokens of code against plain loops, with nulls, empty and damaged texts."""

import json
import random
import re

from pyspark.sql import functions as F

from paperloom.operators import replies


def test_a_bad_member_costs_only_itself(spark):
    whole = {"title": "T", "kind": "k", "amount": 3, "notice_days": 30, "fields": [{"name": "a", "value": "1"}, {"name": "  ", "value": "2"}], "dates": [{"kind": "due", "date": "2024-01-01", "source": "e1"}], "problems": [{"kind": "x", "detail": "y"}]}
    cases = {
        json.dumps(whole): (False, "T", "k", 3.0, 30, 1, 1, 1),
        json.dumps(whole | {"title": 5}): (False, "", "k", 3.0, 30, 1, 1, 1),
        json.dumps(whole | {"kind": ["k"], "amount": "3", "notice_days": 30.5}): (False, "T", None, None, None, 1, 1, 1),
        json.dumps(whole | {"dates": [{"kind": "due"}], "problems": "none"}): (False, "T", "k", 3.0, 30, 1, 0, 0),
        json.dumps(whole | {"fields": [{"name": "a", "value": 1}], "notice_days": 4.0}): (False, "T", "k", 3.0, 4, 0, 1, 1),
        json.dumps(whole | {"dates": [{"kind": "due", "date": "x", "source": None}], "amount": True}): (False, "T", "k", None, 30, 1, 1, 1),
        json.dumps(whole)[:-5]: (True, "", None, None, None, 0, 0, 0),
        "[]": (True, "", None, None, None, 0, 0, 0), "": (True, "", None, None, None, 0, 0, 0), "null": (True, "", None, None, None, 0, 0, 0), "{}": (False, "", None, None, None, 0, 0, 0),
    }
    rows = [*cases, None, "{}"]
    out = replies.read(spark.createDataFrame([(r, "own") for r in rows], "reply string, title string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.malformed, r.title, r.kind, r.amount, r.notice_days, len(r.fields), len(r.dates), len(r.problems)) == cases.get(r.reply, (True, "", None, None, None, 0, 0, 0)), r.reply
    assert replies.read(spark.createDataFrame([], "reply string")).count() == 0


def test_json_columns_both_ways(spark):
    rows = [({"rent": ("900", "EUR", None), "öd": ("", None, "e3")}, ["A", "b\"c", ""], (0.25, 0.5, 1.0, 0.125)), ({}, [], (0.0, 0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "f map<string, struct<value: string, unit: string, source: string>>, a array<string>, b struct<x: double, y: double, width: double, height: double>")
    text = df.select(*(replies.encoded(F.col(c)).alias(c) for c in "fab"), F.col("f").alias("f0"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    back = text.select(replies.decoded_fields(F.col("f")).alias("f"), "f0", replies.decoded_aliases(F.col("a")).alias("a"), "a0", replies.decoded_box(F.col("b")).alias("b"), "b0").collect()
    assert len(back) == 2 and all(r.f == r.f0 and r.a == r.a0 and r.b == r.b0 for r in back)
    bad = spark.createDataFrame([(x,) for x in (None, "", "[1]", '["a", 1]', '{"a": 1}', '{"a": {"unit": "x"}}', '{"x": 1, "y": 2, "width": 3}', "{")], "t string")
    for r in bad.select("t", replies.decoded_fields(F.col("t")).alias("f"), replies.decoded_aliases(F.col("t")).alias("a"), replies.decoded_box(F.col("t")).alias("b")).collect():
        assert (r.f, r.a, r.b) == ({}, [], None)


def cut_by_hand(text):
    out, held, language, inside = [], [], None, False
    strip = lambda lines: "\n".join(lines).strip()

    def bare(lines):
        while lines and not lines[0].strip(" \t"):
            lines = lines[1:]
        while lines and not lines[-1].strip(" \t"):
            lines = lines[:-1]
        return "\n".join(lines)

    for line in text.split("\n"):
        if line.strip(" \t").startswith("```"):
            if inside:
                out.append(("code", language, bare(held), True))
            else:
                if strip(held):
                    out.append(("prose", None, strip(held), None))
                language = line.strip(" \t")[3:].strip(" \t").lower() or None
            held, inside = [], not inside
        else:
            held.append(line)
    if inside:
        out.append(("code", language, bare(held), False))
    elif strip(held):
        out.append(("prose", None, strip(held), None))
    return [(i, *x) for i, x in enumerate(out)]


def test_fenced_blocks(spark):
    rng = random.Random(1)
    lines = ["a", "  b ", "", " ", "```", "``` Swift ", "  ```py", "```` x", "text ``` no", "\t", "c # d"]
    texts = ["", None, "```", "```\n```", "\n\n", "a", *("\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(200)), "```\n" + "x y\n" * 50_000]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, text string, kind string")
    got = {}
    for r in replies.blocks(df).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.place, r.kind, r.language, r.text, r.closed))
    assert got == {i: b for i, t in enumerate(texts) if (b := cut_by_hand(t or ""))}


def test_code_in_colours(spark):
    codes = [
        ("let x = 1 // one\n", "swift", [("let", "keyword"), (" x = ", "plain"), ("1", "number"), (" ", "plain"), ("// one", "comment"), ("\n", "plain")]),
        ("def f(): # 'no'\n  return utf8", "python", [("def", "keyword"), (" f(): ", "plain"), ("# 'no'", "comment"), ("\n  ", "plain"), ("return", "keyword"), (" utf8", "plain")]),
        ("a /* b\nc */ \"d\\\"e\" 'open\nnext", None, [("a ", "plain"), ("/* b\nc */", "comment"), (" ", "plain"), ('"d\\"e"', "string"), (" ", "plain"), ("'open", "string"), ("\nnext", "plain")]),
        ("1.5_0x /* open", "sql", [("1.5_0", "number"), ("x ", "plain"), ("/* open", "comment")]), ("`\\", "js", [("`\\", "string")]), ("#", "json", [("#", "plain")]),
    ]
    rng = random.Random(2)
    mixed = ["".join(rng.choices(["let ", "x", "1", ".", "'", '"', "`", "\\", "\n", "//", "/*", "*/", "#", "é", "🙂", " "], k=rng.randint(1, 60))) for _ in range(200)]
    rows = [*((c, lang) for c, lang, _ in codes), *((m, rng.choice(["py", "swift", None])) for m in mixed), ("", None), (None, "py"), ("'" + "ab\\c" * 20_000, "js")]
    out = replies.highlighted(spark.createDataFrame(rows, "code string, language string"), language="language").collect()
    assert len(out) == len(rows)
    for r in out:
        spans = [(s.text, s.kind) for s in r.spans]
        assert "".join(t for t, _ in spans) == (r.code or "")
        assert all(t for t, _ in spans) and not any(a[1] == b[1] == "plain" for a, b in zip(spans, spans[1:], strict=False))
        assert all(not re.match(r"[\w]", t) or k != "plain" or not t.isdigit() for t, k in spans)
    assert {(c, lang): [(s.text, s.kind) for s in r.spans] for c, lang, _ in codes for r in out if (r.code, r.language) == (c, lang)} == {(c, lang): s for c, lang, s in codes}
