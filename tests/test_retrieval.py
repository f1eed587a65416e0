"""Stems and stemmed search against SQLite's full-text index with the Porter tokenizer."""

import random
import sqlite3

import pytest

from paperloom.functions.stems import stem
from paperloom.operators import retrieval

#: Words and stems of the published description of the algorithm.
PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "license": "licens", "licensed": "licens", "licensing": "licens", "at": "at", "": "",
}


def test_published_stems():
    assert {w: stem(w) for w in PUBLISHED} == PUBLISHED


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    return db


def test_stems_of_many_words(lite):
    rng = random.Random(1)
    ends = "ational izer bli alli entli eli ization ator alism iveness fulness aliti iviti biliti logi icate ative alize ical ful ness ance ence er able ible ant ement ment ent ion ism ate iti ous ive s es sses ies ed eed ing y ll e".split()
    words = sorted({"".join(rng.choices("abcdehilnorstyaeiou", k=rng.randint(1, 6))) + rng.choice(ends) + rng.choice(["", *ends]) for _ in range(5000)})
    lite.execute("CREATE VIRTUAL TABLE words USING fts5(text, tokenize = 'porter unicode61')")
    lite.executemany("INSERT INTO words(rowid, text) VALUES (?, ?)", list(enumerate(words)))
    lite.execute("CREATE VIRTUAL TABLE stems USING fts5vocab(words, 'instance')")
    assert {words[i]: term for term, i in lite.execute("SELECT term, doc FROM stems")} == {w: stem(w) for w in words}


def corpus():
    rng = random.Random(3)
    words = "license Licensed licensing licence work working worker worked agreements agreement résumé resume RÉSUMÉ tenant tenancies house houses housing the a of".split()
    out = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40))) + rng.choice(["", ".", " —", "\n"])) for i in range(1, 120)]
    return [*out, (500, ""), (501, "..."), (502, "licensing" * 3), (503, "license work " * 200)]


QUERIES = ["license", "licensing works", "Resumes tenant", "houses, agreement!", "nowhere", "work nowhere", "the a of"]


@pytest.mark.parametrize("keep", [False, True])
def test_search_as_sqlite_does(spark, lite, keep):
    rows = corpus()
    if not lite.execute("SELECT count(*) FROM t").fetchone()[0]:
        lite.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = retrieval.written(docs, "test") if keep else retrieval.index(docs)
    for q in QUERIES:
        want = lite.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid", (" ".join(f'"{w}"' for w in q.replace(",", "").replace("!", "").split()),)).fetchall()
        got = [(r.doc_id, r.score) for r in retrieval.search(index, q, limit=1000).collect()]
        assert {i for i, _ in got} == {i for i, _ in want}, q
        assert dict(got) == pytest.approx(dict(want), rel=1e-5, abs=2e-6), q
    some = retrieval.retrieve(index, "license nowhere", limit=1000).collect()
    assert {r.doc_id for r in some} == {i for i, _ in lite.execute("SELECT rowid, 0 FROM t WHERE t MATCH 'license'")} and {r.matched for r in some} == {1}


def test_odd_rows(spark):
    empty = retrieval.index(spark.createDataFrame([], "doc_id long, text string"))
    assert retrieval.search(empty, "a").count() == 0 and retrieval.retrieve(empty, "a").count() == 0
    docs = spark.createDataFrame([(1, None, "x"), (None, "license", "x"), (2, "license", "x")], "doc_id long, text string, term string")
    index = retrieval.index(docs)
    assert [r.doc_id for r in retrieval.search(index, "licensed").collect()] == [2]
    assert index.corpus.first().n == 2
    assert retrieval.search(index, " ,. ").count() == 0
