"""Whole tables, odd texts, and work that larger tables need."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from paperloom import catalog
from paperloom.operators import graph
from paperloom.streaming import reminders


def test_records_are_tied_by_all_their_links(spark, tmp_path):
    """A supplier or a nation in common is a tie as a customer or a part is; breadth counts all four."""
    tables = {
        "orders": ("o_orderkey long, o_custkey int, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double", [(k, k, None, "1", 1.0) for k in range(1, 9)]),
        "customer": ("c_custkey int, c_name string, c_nationkey int", [(k, f"c{k}", 5 if k in (3, 4) else k + 10) for k in range(1, 9)]),
        "lineitem": ("l_orderkey long, l_suppkey int, l_partkey int", [(1, 7, 1), (2, 7, 2), (3, 8, 3), (4, 9, 4), (5, 10, 5), (6, 10, 6), (6, 11, 7), (7, 12, 8), (8, 13, 8)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    ties = catalog.queries()["record_ties"](spark, str(tmp_path))
    assert {(r.a, r.b, r.weight) for r in ties.collect()} == {(1, 2, 500), (3, 4, 500), (7, 8, 500)}


def test_an_entity_of_many_records_is_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 4)
    links = spark.createDataFrame([(r, r % 5) for r in range(60)], "record_id long, entity_id long")
    tied = graph.ties(links, links.select("record_id"))
    assert sorted((r.a, r.b, r.weight) for r in tied.collect()) == [(a, b, 83) for a in range(60) for b in range(a + 1, 60) if a % 5 == b % 5]


def test_an_empty_text_is_measured(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "a ü"), (4, "\u00fc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in catalog.queries()["text_measures"](spark, str(tmp_path)).collect()}
    assert math.isnan(out[1]["readable"]) and (out[1]["anchored"], out[1]["tokens"], out[1]["plain_length"]) == (False, 0, 0)
    assert [out[k]["readable"] for k in (2, 3, 4)] == [None, 0.666667, 0.0]


def some_texts(n):
    rng = random.Random(7)
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)]
    return {k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(90)], k=rng.randint(0, 14))) for k in range(n)}


def test_common_terms_are_columns_of_matrices(spark, monkeypatch):
    """Whatever share of the terms is multiplied as matrices, and in however small pieces: the same pairs, each in one tile."""
    texts = spark.createDataFrame(list(some_texts(150).items()), "id long, text string")
    found = []
    for dense, columns, step, tile in ((1 / 256, 7, 100, 6), (2, 7, 1 << 17, 2), (0, 1024, 1 << 17, 6)):
        for name, value in dict(DENSE=dense, COLUMNS=columns, STEP=step, TILE=tile, BLOCK_TERMS=400, BLOCK_TEXTS=16).items():
            monkeypatch.setattr(graph, name, value)
        found.append(sorted((r.a, r.b, round(r.cosine, 9)) for r in graph.alike(texts).collect()))
    assert len(found[0]) == len({x[:2] for x in found[0]}) > 300 and all(len(x) == len(found[0]) for x in found) and found[0] == found[1] == found[2]


def test_ties_of_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_TEXTS", 16)
    texts = some_texts(60)
    rows = spark.createDataFrame([(k, t) for k, t in texts.items() if k % 7], "id long, text string")
    links = spark.createDataFrame([(k, k % 11) for k in texts] + [(k, 100 + j) for k in (1, 2, 12, 23) for j in range(5)] + [(None, 3), (5, None)], "record_id long, entity_id long")
    records = spark.createDataFrame([(k,) for k in texts], "id long")
    tied = graph.ties(links, records, rows)
    assert "Exchange" not in tied._jdf.queryExecution().executedPlan().toString()
    bare = {(r.a, r.b): r.weight for r in graph.ties(links, records).collect()}
    near = {(r.a, r.b): r.cosine for r in graph.alike(rows).collect()}
    of = lambda k: {k % 11} | ({100 + j for j in range(5)} if k in (1, 2, 12, 23) else set())
    expected = {p: (bare.get(p, 0) + math.floor(400 * round(near.get(p, 0), 6)), p in bare or round(near[p], 6) >= 0.3 or bool(of(p[0]) & of(p[1]))) for p in bare.keys() | near.keys()}
    assert {(r.a, r.b): (r.weight, r.binds) for r in tied.collect()} == expected and tied.count() == len(expected)


def test_put_off_tasks_share_states(spark, tmp_path, monkeypatch):
    """A state is that of many tasks, so a batch asks the store a few times, not once and more for each task."""
    monkeypatch.setattr(reminders, "BUCKETS", 3)
    rows = [(f"k{i}", f"2024-01-01 00:{i % 60:02}:00", "snooze", f"2024-01-0{2 + i % 4}") for i in range(200)] + [("k0", "2024-01-04 12:00:00", "done", None), ("é", "2024-01-01 01:00:00", "undo", None)]
    df = spark.createDataFrame(rows, "key string, at string, action string, until string").select("key", F.to_timestamp("at").alias("at"), "action", F.to_date("until").alias("until"))
    df.write.parquet(str(tmp_path / "in"))
    for name, value in reminders.STATE_STORE.items():
        spark.conf.set(name, value)
    q = reminders.returning(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    for name in reminders.STATE_STORE:
        spark.conf.unset(name)
    out = sorted((r.key, str(r.day)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == sorted((k, d) for k, _, a, d in rows if a == "snooze" and k != "k0" and d <= "2024-01-04")
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_communities_are_swept_without_shuffles(spark, monkeypatch):
    """Components need not be found, and a round reads the ties as they were dealt once."""
    rng = random.Random(5)
    ties = {tuple(sorted(rng.sample(range(3, 900, 7), 2))): (rng.randint(1, 3), rng.random() < 0.8) for _ in range(400)}
    df = spark.createDataFrame([(a, b, w, x) for (a, b), (w, x) in ties.items()], "a long, b long, weight long, binds boolean")
    found = []
    for most in (1 << 22, 30):
        monkeypatch.setattr(graph, "TASK_TIES", most)
        labels = graph.communities(df)
        assert "Exchange" not in labels._jdf.queryExecution().executedPlan().toString()
        found.append({r.record_id: r.label for r in labels.collect()})
    assert found[0] == found[1] and set(found[0]) == {k for p in ties for k in p} and len(set(found[0].values())) < len(found[0]) / 2
