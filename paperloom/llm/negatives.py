"""Hard-negative mining by inner product: a norm-bucketed search.

An inner product is |a| |c| at most (Cauchy-Schwarz). Candidates are bucketed by norm, the longest first. For an anchor, a
bucket counts only if |a| times the bucket's largest norm reaches what the anchor still asks for: the lower limit of one of
its windows, or the score of the last of the k that it has found there, whichever is more. Positives are searched among
rows of the anchor's label. Negatives are searched in two waves: the bucket of longest candidates gives most windows their
k-th score, and only buckets that can better it get the anchor in the second. Inside a task candidates are sorted by norm
too, and the search of a block of anchors ends where no anchor asks for shorter ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._tables import drop, stored
from paperloom.llm.topk import LEAST, MOST, NONE, _matrix, _products

#: Candidates, and anchors, that meet in one task.
TASK_ROWS = 1 << 16
#: Buckets of norm: so many at least, more for more candidates than TASK_ROWS in each, and so many at most, which also bounds
#: the groups of anchors; beyond it buckets are split into parts.
LEAST_BUCKETS, MOST_BUCKETS = 8, 512
#: Rows of anchor and candidate matrices multiplied at once.
BLOCK = 1024
#: Room for rounding in bounds of norms.
SLACK = 1e-9

FOUND = "anchor_id long, slot int, id long, score long"


def usable(df: DataFrame, id: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """id, label, v (floor(scale * x) of every component) and norm.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Of rows with equal ids, the
    one with the least label, then vector, counts. A finite component that leaves 64 bits when scaled is an error.
    """
    x = lambda c: c.cast("double")
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(x(c)) < float("inf")))
    error = F.raise_error(F.lit("a scaled component leaves 64 bits")).cast("long")
    v = F.transform(F.col(vector), lambda c: F.when(F.abs(x(c)) * scale < float(2**63), F.floor(F.lit(scale) * x(c))).otherwise(error))
    rows = df.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + x(c) * x(c))))


def _kept(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller id, of `held` and of those of a block that fit. Places that are
    not filled have LEAST and NONE."""
    least = held[0][:, -1:]
    score = np.where(fits, score, LEAST)
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None])
    row, column = np.nonzero(fits & (score >= least))
    rows = np.concatenate([np.repeat(np.arange(len(score)), k), row])
    scores, found = np.concatenate([held[0].reshape(-1), score[row, column]]), np.concatenate([held[1].reshape(-1), ids[column]])
    order = np.lexsort((found, ~scores, rows))
    first = np.searchsorted(rows[order], np.arange(len(score)))
    take = order[first[:, None] + np.arange(k)]
    return scores[take], found[take]


def searched(anchors: pa.Table, rows: pa.Table, k: int, same: bool, width: int) -> pa.Table:
    """FOUND: for each slot of an anchor (id, label, v, norm, low and high, one item a slot) its k best rows (id, label, v,
    norm) of the same label, or of another, with a score from low to high."""
    out = {n: [np.zeros(0, np.int64)] for n in ("anchor_id", "slot", "id", "score")}
    if anchors.num_rows and rows.num_rows:
        rows = rows.take(np.argsort(-rows.column("norm").to_numpy(), kind="stable"))
        labels = pa.chunked_array([*anchors.column("label").chunks, *rows.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = labels[: anchors.num_rows], labels[anchors.num_rows :]
        v, ids, norms = _matrix(rows.column("v"), width), rows.column("id").to_numpy(), rows.column("norm").to_numpy()
        low_all, high_all = (_matrix(anchors.column(c), anchors.column(c).combine_chunks().value_lengths().to_numpy().max()) for c in ("low", "high"))
        for i in range(0, anchors.num_rows, BLOCK):
            part = anchors.slice(i, BLOCK)
            a, own, long = _matrix(part.column("v"), width), part.column("id").to_numpy(), part.column("norm").to_numpy()
            low, high, label = low_all[i : i + BLOCK], high_all[i : i + BLOCK], mine[i : i + BLOCK]
            best = np.full((*low.shape, k), LEAST), np.full((*low.shape, k), NONE)
            for j in range(0, len(ids), BLOCK):
                # What each slot asks for: its window's lower limit, or its running k-th score.
                limit = np.where(low <= high, np.maximum(low, best[0][:, :, -1]), MOST).min(1).astype(np.float64)
                asks = np.flatnonzero(long * norms[j] * (1 + SLACK) + 1 >= limit)
                if not len(asks):
                    break
                score = _products(a[asks], v[j : j + BLOCK])
                if ((score == LEAST) | (score == MOST)).any():
                    raise ValueError("a score leaves 64 bits")
                near = ((label[asks, None] == theirs[None, j : j + BLOCK]) == same) & (own[asks, None] != ids[None, j : j + BLOCK])
                for slot in range(low.shape[1]):
                    fits = near & (score >= low[asks, slot, None]) & (score <= high[asks, slot, None])
                    some = fits.any(1)
                    at = asks[some]
                    if len(at):
                        best[0][at, slot], best[1][at, slot] = _kept(score[some], fits[some], ids[j : j + BLOCK], k, (best[0][at, slot], best[1][at, slot]))
            row, slot, place = np.nonzero(best[1] != NONE)
            out["anchor_id"].append(own[row]), out["slot"].append(slot), out["id"].append(best[1][row, slot, place]), out["score"].append(best[0][row, slot, place])
    made = {n: np.concatenate(x) for n, x in out.items()}
    return pa.table(made | {"slot": made["slot"].astype(np.int32)})


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _tasks(n: Column) -> Column:
    return F.greatest(F.ceil(n / TASK_ROWS), F.lit(1))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each slot with their place."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def positives_of(anchors: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """FOUND with place: each anchor's k best other rows of its label. Labels of more than TASK_ROWS rows, or anchors, are
    dealt to several tasks."""
    sizes = rows.groupBy("label").agg(_tasks(F.count(F.lit(1))).alias("parts"))
    shares = anchors.groupBy("label").agg(_tasks(F.count(F.lit(1))).alias("shares"))
    plan = sizes.join(shares, "label")
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    whole = lambda n: F.array(F.lit(n).cast("long"))
    a = anchors.join(plan, "label").select("id", "label", "v", "norm", whole(LEAST + 1).alias("low"), whole(MOST - 1).alias("high"), F.col("label").alias("of"), hashed("shares").alias("share"), _upto(F.col("parts")).alias("part"))
    c = rows.join(plan, "label").select("id", "label", "v", "norm", F.col("label").alias("of"), _upto(F.col("shares")).alias("share"), hashed("parts").alias("part"))
    keys = ["of", "share", "part"]
    found = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(lambda x, y: searched(x, y, k, True, width), FOUND)
    return _best(found, k)


def edges(df: DataFrame, column: str, n: int, least: int, most: int) -> list[float]:
    """Limits that cut `column`, from the largest value down, into about as many ranges as n rows fill tasks."""
    ranges = min(most, max(least, -(-n // TASK_ROWS)))
    if ranges < 2:
        return []
    cuts = df.approxQuantile(column, [1 - i / ranges for i in range(1, ranges)], 1 / (8 * ranges))
    return sorted({float(c) for c in cuts if np.isfinite(c)}, reverse=True)


def _range_of(column: Column, cuts: list[float]) -> Column:
    """The number of limits that are above the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > column)).cast("long") if cuts else F.lit(0).cast("long")


def wave(asks: DataFrame, rows: DataFrame, k: int, width: int, buckets: np.ndarray, norms: dict[int, tuple[float, int]]) -> DataFrame:
    """FOUND for the windows of `asks` among rows of other labels in the buckets given. `norms`: largest norm and number of
    rows of each bucket."""
    spark = rows.sparkSession
    # An anchor needs norms from `least` on: its lowest limit by its own norm.
    limit = F.array_min(F.transform(F.filter(F.arrays_zip("low", "high"), lambda w: w["low"] <= w["high"]), lambda w: w["low"])).cast("double")
    asks = asks.withColumn("least", (limit - 1) / (1 + SLACK) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1e-300))).where("least IS NOT NULL")
    many = asks.count()
    cuts = edges(asks, "least", many, 1, MOST_BUCKETS)
    asks = asks.withColumn("group", _range_of(F.col("least"), cuts))
    told = {r["group"]: (r["least"], max(1, -(-r["n"] // TASK_ROWS))) for r in asks.groupBy("group").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
    pairs = [(g, s, int(b), p) for g, (least, shares) in told.items() for b in buckets if norms[b][0] >= least for s in range(shares) for p in range(max(1, -(-norms[b][1] // TASK_ROWS)))]
    if not pairs:
        return spark.createDataFrame([], FOUND)
    plan = spark.createDataFrame(pairs, "group long, share long, bucket long, part long")
    shares = F.get(F.array(*(F.lit(told.get(g, (0, 1))[1]) for g in range(len(cuts) + 1))), F.col("group").cast("int"))
    parts = F.get(F.array(*(F.lit(max(1, -(-norms.get(b, (0, 0))[1] // TASK_ROWS))) for b in range(max(norms) + 1))), F.col("bucket").cast("int"))
    a = asks.withColumn("share", F.pmod(F.xxhash64("id"), shares)).join(F.broadcast(plan), ["group", "share"])
    c = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(F.broadcast(plan), ["bucket", "part"])
    keys = ["group", "share", "bucket", "part"]
    a, c = a.select(*keys, "id", "label", "v", "norm", "low", "high"), c.select(*keys, "id", "label", "v", "norm")
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(lambda x, y: searched(x, y, k, False, width), FOUND)


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its `positives` best other rows of its label. For each of them, the `negatives` best rows of
    other labels with a score from `low` to `high` percent of the positive's are returned. Higher scores come first, ties by
    the smaller id. Both sides are as `usable` gives them; missing components of shorter vectors count as 0. Fewer rows give
    fewer results; a window that has no score, such as that of a negative score, none. A score that leaves 64 bits is an
    error. Without anchors or rows there are no results.
    """
    spark = rows.sparkSession
    rows, anchors = stored(rows, "rows"), stored(anchors, "anchors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, anchors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    found = positives_of(anchors, rows, positives, width)
    share = lambda p, percent, up: F.expr(f"{percent} * ({p} div 100)") + F.ceil(F.expr(f"{percent} * ({p} % 100)") / 100) if up else F.expr(f"{percent} * ({p} div 100)") + F.floor(F.expr(f"{percent} * ({p} % 100)") / 100)
    item = F.struct("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share("score", low, True).alias("low"), share("score", high, False).alias("high"))
    asked = found.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("windows"))
    asks = stored(anchors.join(asked, "id").select("id", "label", "v", "norm", "windows", F.col("windows.low").alias("low"), F.col("windows.high").alias("high")), "asks")
    cuts = edges(rows, "norm", n, LEAST_BUCKETS, MOST_BUCKETS)
    rows_in = rows.withColumn("bucket", _range_of(F.col("norm"), cuts))
    norms = {r["bucket"]: (r["most"], r["n"]) for r in rows_in.groupBy("bucket").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    order = np.array(sorted(norms), dtype=np.int64)
    first = stored(wave(asks, rows_in, negatives, width, order[:1], norms), "first")
    kth = _best(first, negatives).where(F.col("place") == negatives).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    raised = F.transform(F.col("low"), lambda x, i: F.greatest(x, F.try_element_at(F.col("kth"), i)))
    narrowed = asks.join(kth, "id", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised)).drop("kth")
    rest = stored(wave(narrowed, rows_in, negatives, width, order[1:], norms), "rest")
    best = _best(first.union(rest), negatives)
    window = F.element_at("windows", F.col("slot") + 1)
    done = best.join(asks.select(F.col("id").alias("anchor_id"), "windows"), "anchor_id").select("anchor_id", window["positive_id"].alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), window["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"))
    done = stored(done, "negatives")
    drop(rows, anchors, asks, first, rest)
    return done
