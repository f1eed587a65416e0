"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of the weights of its words and their beginnings), and a
document is toxic unless every sentence is clean (noisy-or): 1 - prod(1 - p). Weights are trained from document labels
alone, and the same sentence probabilities then locate the sentences at fault.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._arrow import append, bytes_of, pieces, prefix_hash, span_hash, spans
from paperloom.llm._tables import stored

#: Labelled documents that a fit reads at most, taken in the order of a hash of their id.
SAMPLE_ROWS = 8_000
#: Bytes of text that they have together at most.
SAMPLE_BYTES = 64 << 20
#: log2 of the number of word buckets.
BITS = 18

#: Standard deviations by which a feature's toxic documents must differ from the expected number.
LEAST_Z = 4.5
#: Besides whole words, beginnings of so many bytes are features, for languages that compound and inflect.
STEMS = (4, 5)

#: What is no part of a word: everything but ASCII letters, ' and bytes of longer code points.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STOPS = np.zeros(256, bool)
STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence of each word and beginning; row, start and end byte of each sentence, starts within the row."""
    data, offsets = bytes_of(array)
    data = LOWER[data]
    stop = np.flatnonzero(STOPS[data]) + 1
    cuts = np.union1d(stop, offsets)
    starts, ends, _ = spans(data, np.append(cuts, len(data)) if not len(cuts) or cuts[-1] != len(data) else cuts, BREAKS)
    sentence = np.searchsorted(cuts, starts, "right") - 1
    used, sentence = np.unique(sentence, return_inverse=True)
    begin = cuts[used]
    row = np.searchsorted(offsets, begin, "right") - 1
    finish = cuts[np.minimum(used + 1, len(cuts) - 1)]
    sums, parts = prefix_hash(data), [(starts, ends, sentence)]
    for n in STEMS:
        long = ends - starts > n
        parts.append((starts[long], starts[long] + n, sentence[long]))
    bucket = np.concatenate([span_hash(sums, a, z) ^ np.uint64(i) for i, (a, z, _) in enumerate(parts)]) & np.uint64((1 << BITS) - 1)
    return bucket.astype(np.int64), np.concatenate([x for _, _, x in parts]), row, begin - offsets[row], finish - offsets[row]


def fit(labelled: DataFrame, text: str = "text", label: str = "label", steps: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> Model:
    """Trains on all rows of `labelled`, which the caller has bounded (see `sample`). Null texts are empty.

    Without rows of both labels the model scores every document 0.
    """
    rows = labelled.select(text, label).where(F.col(label).isNotNull()).toArrow()
    target = rows.column(label).to_numpy().astype(np.float64)
    if not len(target) or target.min() == target.max():
        return Model(np.zeros(1 << BITS, np.float32), -1e9)
    # A feature counts once a sentence; only those whose documents differ from chance in their labels are kept.
    batches = [piece for batch in rows.to_batches() for piece in pieces(batch, text)]
    begins = np.cumsum([0, *(piece.num_rows for piece in batches)])
    documents, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for begin, piece in zip(begins, batches, strict=False):
        bucket, sentence, row, _, _ = _words(piece.column(text))
        seen = np.unique(row[sentence] * (1 << BITS) + bucket)
        documents += np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
        toxic += np.bincount(seen & ((1 << BITS) - 1), target[begin + (seen >> BITS)], 1 << BITS)
    share = target.mean()
    keep = (np.abs(toxic - share * documents) > LEAST_Z * np.sqrt(share * (1 - share) * documents)) & (documents > 2)
    pairs, owner = [], []
    for begin, piece in zip(begins, batches, strict=False):
        bucket, sentence, row, _, _ = _words(piece.column(text))
        pairs.append(np.unique(sentence[keep[bucket]] * (1 << BITS) + bucket[keep[bucket]]) + (sum(map(len, owner)) << BITS))
        owner.append(row + begin)
    pair, row = np.concatenate(pairs), np.concatenate(owner)
    sentence, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    used, column = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), -5.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, w[column], len(row))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), len(target))
        whole = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        pull = np.where(target == 1, (1 - whole) / whole, -1.0)[row] * p
        slope = np.append(np.bincount(column, pull[sentence], len(used)), pull.sum()) / len(target)
        slope[:-1] -= ridge * w / max(1.0, len(target) / 1000)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, b = w + move[:-1], b + move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> DataFrame:
    """text and label of documents that `labels` marks and that are not held out, in the order of a hash of their id: at most
    `rows` of them, and of these as many as have `limit` bytes of text together. A document whose id repeats counts once, with
    its smallest text; one with several labels is toxic if one of them says so. Labels without an id or a mark are ignored.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = stored(texts, "labelled")
    # The running sum is over `rows` numbers at most.
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    fits = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("upto") <= limit)
    return texts.join(F.broadcast(fits.select("doc_id")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1), n_sentences, and of the worst sentence its probability and bytes [worst_start, worst_end).

    A text that is null, empty or without words scores 0 and has no worst sentence (null). Texts are scored whole.
    Columns of these names in `documents` are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scored(piece: pa.RecordBatch) -> list:
        weights, bias = shared.value
        bucket, sentence, row, begin, finish = _words(piece.column(text))
        once = np.unique(sentence * (1 << BITS) + bucket)
        sentence, bucket = once >> BITS, once & ((1 << BITS) - 1)
        z = bias + np.bincount(sentence, weights[bucket], len(row))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = -np.expm1(np.bincount(row, np.log1p(-p), piece.num_rows))
        count = np.bincount(row, minlength=piece.num_rows)
        order = np.lexsort((begin, -p, row))
        first = order[np.searchsorted(row[order], np.arange(piece.num_rows))] if len(row) else np.zeros(piece.num_rows, int)
        none = count == 0
        pick = lambda x: pa.array(x[first] if len(row) else np.zeros(piece.num_rows, x.dtype), mask=none)
        return [pa.array(np.clip(whole, 0, 1) + 0.0), pa.array(count.astype(np.int64)), pick(p), pick(begin.astype(np.int64)), pick(finish.astype(np.int64))]

    return append(documents, text, scored, "score double, n_sentences long, worst_probability double, worst_start long, worst_end long", keep)
