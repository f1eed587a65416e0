"""Work that grows with the input: what is shuffled, written and held by one task."""

import itertools
import math
import random
import re
from collections import Counter

from paperloom import session
from paperloom.operators import graph, retrieval, upkeep


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_alike_blocks_are_read_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_TEXTS", 16)
    rng = random.Random(4)
    texts = {k: " ".join(rng.choices([f"word{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(90)], k=rng.randint(0, 14))) for k in range(150)}
    counts = {k: Counter(w for w in t.split()) for k, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {k: {w: tf * math.log(150 / df[w]) for w, tf in c.items() if 1 < df[w] <= 75} for k, c in counts.items()}
    norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    cosines = {(a, b): sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) / (norm[a] * norm[b]) for a, b in itertools.combinations(sorted(texts), 2) if vectors[a] and vectors[b]}
    found = graph.alike(spark.createDataFrame(list(texts.items()), "id long, text string"))
    assert not re.search("CoGroup|Exchange", _plan(found))
    assert {(r.a, r.b): round(r.cosine, 9) for r in found.collect()} == {p: round(c, 9) for p, c in cosines.items() if c >= graph.ALIKE}


def test_postings_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(1, "b a, b! Ä a a"), (2, ""), (3, None), (4, "..."), (None, "a"), (5, "licensed work works")], "doc_id long, text string")
    index = retrieval.index(docs)
    assert "Exchange" not in _plan(index.postings)
    assert {(r.doc_id, r.length, r.token, r.tf) for r in index.postings.collect()} == {(1, 6, "a", 4), (1, 6, "b", 2), (5, 3, "licensed", 1), (5, 3, "work", 1), (5, 3, "works", 1)}
    assert tuple(index.corpus.first()) == (5, 1.8)
    within = spark.createDataFrame([(5,), (4,)], "doc_id long")
    whole, part = (retrieval.scored(index, ["a", "work"], w) for w in (None, within))
    assert [r.doc_id for r in part.collect()] == [5] and {r.doc_id for r in whole.collect()} == {1, 5}
    alone = retrieval.scored(retrieval.index(docs.join(within, "doc_id")), ["a", "work"])
    assert [tuple(r) for r in part.collect()] == [tuple(r) for r in alone.collect()]


def test_tasks_on_links_and_facts_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    links = session.dealt(spark.createDataFrame([(r, "names", r % 20 if k else 7) for r in range(60) for k in range(2)], "record_id long, rel string, entity_id long"), 120, "record_id").distinct()
    records = links.select("record_id").distinct()
    assert links.rdd.getNumPartitions() == 12
    # The only shuffle of the links is that which deals them; counts of entities follow.
    assert _plan(graph.reach(links)).split("Initial Plan")[0].count("REPARTITION_BY_NUM") and "hashpartitioning(entity_id" in _plan(graph.reach(links)) and "hashpartitioning(record_id#" not in re.sub(r"hashpartitioning\(record_id#\d+L, 12\), REPARTITION_BY_NUM", "", _plan(graph.reach(links)))
    assert {(r.entity_id, r.reach) for r in graph.reach(links).collect()} == {(e, 60 if e == 7 else 3) for e in range(20)}
    tied = graph.ties(links, records)
    assert {(r.a, r.b, r.weight) for r in tied.collect()} == {(a, b, 333) for a, b in itertools.combinations(range(60), 2) if a % 20 == b % 20 != 7}
    assert re.search(r"hashpartitioning\(a#\d+L, 6\), REPARTITION_BY_NUM", _plan(tied))
    rows = spark.createDataFrame([(i, i % 5, i % 3) for i in range(60)], "id long, entity_id long, key long")
    into = spark.createDataFrame([(1, 0), (2, 0)], "entity_id long, keeper_id long")
    kept = upkeep.repointed(rows, ["entity_id"], ["entity_id", "key"], into, count=60)
    assert re.search(r", 6\), REPARTITION_BY_NUM", _plan(kept))
    assert sorted(r.id for r in kept.collect()) == sorted({(0 if e in (1, 2) else e, k): min(i for i in range(60) if i % 3 == k and (i % 5 == e if e > 2 else i % 5 == 0)) for e in range(5) for k in range(3)}.values())


def test_rounds_of_a_sweep_are_few_where_decisions_are_apart(spark):
    # A chain of 40 records with rising ids, in strong pairs.
    ties = [(a, a + 1, 9 if a % 2 == 0 else 1, True) for a in range(39)]
    df = spark.createDataFrame([t for a, b, w, x in ties for t in ((a, b, w, x), (b, a, w, x))], "a long, b long, weight long, binds boolean")
    labels, rounds, sweeps = graph.swept(df)
    assert {r.record_id: r.label for r in labels.collect()} == {a: a | 1 for a in range(40)}
    assert rounds < 10 and sweeps == 2
