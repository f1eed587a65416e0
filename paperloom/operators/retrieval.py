"""Full-text retrieval over a stemmed inverted index, answer material and verified citations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.functions.stems import stem
from paperloom.session import kept_table

K1, B = 1.2, 0.75
#: What parts words.
SPLIT = r"[^\p{L}\p{M}\p{N}]+"


class Index(NamedTuple):
    """postings (doc_id, length, token, tf), vocabulary (token, term: its stem), lengths (doc_id, length; documents without
    words, too)."""

    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame

    @property
    def corpus(self) -> DataFrame:
        """One row: n documents, and their mean length."""
        return _corpus(self.lengths)


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def tokens(text: Column) -> Column:
    """The words of a text in lower case without diacritic marks."""
    return F.filter(F.split(N.folded(text), SPLIT), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """The distinct stems of a query's words."""
    folded = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return sorted({stem(w) for w in re.split(r"[\W_]+", folded) if w})


def index(docs: DataFrame) -> Index:
    """The inverted index of texts (doc_id, text). Null texts count as empty ones, which are documents of length 0; rows with
    a null id have no place in it. Stems are worked out once for each distinct word, not for each occurrence."""
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.sort_array(words).alias("tokens")).withColumn("length", F.size("tokens"))
    # A text's words are counted where it is read: a word's run in the sorted words begins where the one before is another.
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: ~F.get("tokens", i - 1).eqNullSafe(F.get("tokens", i)))
    runs = rows.where("length > 0").withColumn("begins", begins)
    counted = F.transform("begins", lambda i, k: F.struct(F.get("tokens", i).alias("token"), (F.coalesce(F.get("begins", k + 1), F.col("length")) - i).cast("long").alias("tf")))
    postings = runs.select("doc_id", "length", F.inline(counted))
    return Index(postings, _vocabulary(postings), docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("length")))


def _vocabulary(postings: DataFrame) -> DataFrame:
    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(stem, batch.column(0).to_pylist()), pa.string())], names=["token", "term"])

    return postings.select("token").distinct().mapInArrow(stems, "token string, term string")


def written(docs: DataFrame, name: str) -> Index:
    """The index as tables in the shared folder, made where they aren't there yet. Postings are written by the tasks that read
    the texts, each in order of its words, without a shuffle; the vocabulary is in order of its stems, so that a query reads
    a few row groups of it."""
    made = index(docs)
    postings = kept_table(f"{name}-postings", lambda: made.postings.sortWithinPartitions("token"), docs.sparkSession)
    vocabulary = kept_table(f"{name}-vocabulary", lambda: _vocabulary(postings).repartitionByRange("term").sortWithinPartitions("term"), docs.sparkSession)
    return Index(postings, vocabulary, kept_table(f"{name}-lengths", lambda: made.lengths, docs.sparkSession))


def scored(index: Index, terms: list[str], within: DataFrame | None = None) -> DataFrame:
    """Documents with any word of the stems `terms`: how many of them match, and the BM25 score (smaller is better, as in
    SQLite). Postings of other words go where they are read: the words of a few stems are few, and are sent to all tasks. If
    `within` (doc_id) is given, its documents are the corpus."""
    words = index.vocabulary.where(F.col("term").isin(terms))
    hit, lengths = index.postings.join(F.broadcast(words), "token"), index.lengths
    if within is not None:
        hit, lengths = (df.join(within, "doc_id", "left_semi") for df in (hit, lengths))
    hit = hit.groupBy("doc_id", "length", "term").agg(F.sum("tf").alias("tf"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hit.join(F.broadcast(df), "term").join(F.broadcast(_corpus(lengths)))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), (-F.sum(part)).alias("score"))


def search(index: Index, query: str, limit: int = 20, within: DataFrame | None = None) -> DataFrame:
    """The best documents that hold a form of each word of the query; none for a query without words. Of those `within`
    (doc_id), if it is given."""
    terms = query_terms(query)
    found = scored(index, terms, within).where(F.col("matched") == len(terms))
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(limit)


def retrieve(index: Index, query: str, limit: int = 10) -> DataFrame:
    """The best documents that hold a form of each word of the query or, if there are none, of any."""
    terms = query_terms(query)
    found = scored(index, terms)
    best = found.agg(F.max((F.col("matched") == len(terms)).cast("int")).alias("all"))
    rows = found.join(F.broadcast(best)).where((F.col("all") == 0) | (F.col("matched") == len(terms)))
    return rows.select("doc_id", "matched", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(limit)


def layered(layers: list[DataFrame], limit: int = 20) -> DataFrame:
    """Hits (doc_id, score) of several layers, each document in the first layer that has it, layers in order."""
    union = None
    for i, layer in enumerate(layers):
        rows = layer.select("doc_id", "score", F.lit(i).alias("layer"))
        union = rows if union is None else union.union(rows)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("layer", "score"))
    return union.withColumn("place", place).where("place = 1").select("doc_id", "layer", "score").orderBy("layer", "score", "doc_id").limit(limit)


def verified(cited: DataFrame, consulted: DataFrame) -> DataFrame:
    """Citations (answer_id, text) against the elements (document_id, tag) that were consulted: distinct ones, in order of
    appearance, and whether each is invented."""
    tokens = cited.select("answer_id", F.posexplode(T.citations(F.col("text"))).alias("i", "token"))
    rows = tokens.groupBy("answer_id", "token").agg(F.min("i").alias("i"))
    rows = rows.select("answer_id", "i", "token", F.regexp_extract("token", r"d(\d+)", 1).cast("long").alias("document_id"), F.regexp_extract("token", r":(e\d+)", 1).alias("tag"))
    known = consulted.select("document_id", "tag", F.lit(True).alias("known")).distinct()
    out = rows.join(known, ["document_id", "tag"], "left").withColumn("invented", F.col("known").isNull())
    return out.select("answer_id", "token", "document_id", "tag", "invented")


def material(hits: DataFrame, records: DataFrame, texts: DataFrame, excerpts: int = 3, characters: int = 3000) -> DataFrame:
    """One text a hit (doc_id, rank), in order: its fields sorted by name, and an excerpt for the first ones."""
    fields = records.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "value"))), "\n").alias("fields"))
    rows = hits.join(fields, "doc_id", "left").join(texts, "doc_id")
    body = F.when(F.col("rank") <= excerpts, F.substring(T.owned_anchors(F.col("text"), F.col("doc_id")), 1, characters))
    head = F.concat(F.lit("[d"), F.col("doc_id").cast("string"), F.lit("]"))
    return rows.select("rank", "doc_id", F.concat_ws("\n", head, "fields", body).alias("material")).orderBy("rank")


def people(names: DataFrame, mentions: DataFrame, part: str) -> DataFrame:
    """Entities (entity_id, name) whose name, or a spelling that mentions (entity_id, surface) use, holds `part`."""
    like = lambda c: F.lower(c).contains(part.lower())
    by_mention = mentions.where(like(F.col("surface")) & F.col("entity_id").isNotNull()).select("entity_id")
    direct = names.where(like(F.col("name"))).withColumn("direct", F.lit(True))
    other = names.join(by_mention, "entity_id", "left_semi").join(direct.select("entity_id"), "entity_id", "left_anti").withColumn("direct", F.lit(False))
    return direct.union(other)


def likely_category(text: Column, categories: list[str], considered: int | None = None) -> Column:
    """The category whose name occurs most in a text or its first `considered` characters (ties alphabetical), or null."""
    head = F.lower(T.beginning(text, considered))
    counts = F.array(*(F.struct((-T.occurrences(head, F.lit(c.lower()))).alias("n"), F.lit(c).alias("c")) for c in sorted(categories)))
    best = F.array_min(counts)
    return F.when(best["n"] < 0, best["c"])
