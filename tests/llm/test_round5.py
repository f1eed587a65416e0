"""Rows that are ruled out before a join."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm._tables import perhaps


def test_rows_are_ruled_out_but_none_that_is_asked_for(spark):
    rows = spark.range(20_000).select(F.col("id").cast("int")).union(spark.sql("SELECT CAST(NULL AS INT)"))
    ids = spark.range(0, 40_000, 7).select((F.col("id") - 10_000).alias("node"))
    asked = F.coalesce((F.col("id") + 10_000) % 7 == 0, F.lit(False))
    out = perhaps(rows, "id", ids).groupBy(asked.alias("asked"), "perhaps").count().collect()
    n = {(r["asked"], r["perhaps"]): r["count"] for r in out}
    assert n[True, True] == 2857 and (True, False) not in n and n.get((False, True), 0) < 20 and sum(n.values()) == 20_001
    assert perhaps(rows, "id", ids.where("node < -20000")).where("perhaps").isEmpty()


def test_pipeline_distinct_keeps_rows_without_shuffling_them(spark):
    """Documents that surely stay reach the output without an exchange of their texts."""
    texts = [(i, " ".join(f"w{i * 50 + k}" for k in range(50)), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame([*texts, (20, texts[3][1], "en", "s", 1), (None, texts[3][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.distinct(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [*((False, i) for i in range(20)), (True, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
