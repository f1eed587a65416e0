"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors and queries belong to the cell of their nearest pivot. Each cell's summary is the largest distance to its pivot, r
for queries and R for vectors. Every query is first solved in its own cell, which gives a floor that its k best scores
reach. A query of the cell of pivot p and a vector of that of pivot s have an inner product of p.s + r |s| + R |p| + r R
at most, so a cell's vectors are replicated only to tasks with a query cell whose floor this reaches, and scored, in
whole numbers, only against such cells. Summaries are a few numbers a cell; query cells that need the same data share a
task, so data that bounds rule out nowhere travel once for TASK_ROWS queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._tables import stored

#: Cells at most; pivots are taken from this many times as many vectors.
CELLS = 64
POOL = 8
#: Tasks that share the vectors of a group of query cells: so many at least, and more for more vectors than TASK_ROWS in each.
PARTS = 8
#: Vectors, and queries, that meet in one task. Cells of more queries are split, and each share gets the vectors.
TASK_ROWS = 1 << 16
#: Rows of query and vector matrices multiplied at once.
BLOCK = 1024
#: No vector's id.
NONE = (1 << 63) - 1
SLACK = 1e-9
#: Scores that stand for all that leave 64 bits.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(df: DataFrame, id: str, vector: str, scale: int = 256) -> DataFrame:
    """id and v: floor(scale * x) of every component. Vectors that are null or hold null or non-finite components
    take no part; nor do rows with a null id. A finite component that leaves 64 bits when scaled is an error."""
    fits = lambda c: F.abs(c.cast("double")) * scale < float(2**63)
    error = F.raise_error(F.lit("a scaled component leaves 64 bits")).cast("long")
    x = F.transform(F.col(vector), lambda c: F.when(fits(c), F.floor(F.lit(scale) * c.cast("double"))).otherwise(error))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(id).cast("long").alias("id"), x.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """The vectors as rows; what shorter ones lack is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if np.all(sizes == width):
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products: by floating point where all sums are exact, else in 64 bits, which wrap around on the
    way without harm. Sums that leave 64 bits are LEAST or MOST."""
    x, y = a.astype(np.float64), b.astype(np.float64).T
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0
    if most < 2**53:
        return (x @ y).astype(np.int64)
    out = a @ b.T
    if most >= 2**62:
        error = a.shape[1] * 2.0**-50 * np.sqrt((x**2).sum(1))[:, None] * np.sqrt((y**2).sum(0))
        for i, j in np.argwhere(np.abs(x @ y) + error >= 2**62):
            out[i, j] = min(max(sum(p * q for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True)), LEAST), MOST)
    return out


def _best(score: np.ndarray, id: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties to the smaller id, of `held` and of a block of scores whose
    columns are `id`. Places that are not filled have LEAST and NONE."""
    least = held[0][:, -1:]
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None])
    row, column = np.nonzero(score >= least)
    rows = np.concatenate([np.repeat(np.arange(len(score)), k), row])
    scores, ids = np.concatenate([held[0].reshape(-1), score[row, column]]), np.concatenate([held[1].reshape(-1), id[column]])
    order = np.lexsort((ids, ~scores, rows))
    first = np.searchsorted(rows[order], np.arange(len(score)))
    take = order[first[:, None] + np.arange(k)]
    return scores[take], ids[take]


def _solved(query: pa.Table, data: pa.Table, needs: np.ndarray, k: int, width: int) -> pa.Table:
    """query_id, vec_id, score: each query's k + 1 best of `data`, cell by cell. needs[i, j]: queries of cell i need cell j."""
    out = {n: [np.zeros(0, np.int64)] for n in ("query_id", "vec_id", "score")}
    if query.num_rows and data.num_rows:
        data = data.take(np.argsort(data.column("cell").to_numpy(), kind="stable"))
        ids = data.column("ids").combine_chunks()
        v, cell, bounds = _matrix(data.column("v"), width), data.column("cell").to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        flat = ids.flatten().to_numpy()
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for i in range(0, query.num_rows, BLOCK):
            q = query.slice(i, BLOCK)
            a, mine = _matrix(q.column("v"), width), q.column("cell").to_numpy()
            best = np.full((len(a), k + 1), LEAST), np.full((len(a), k + 1), NONE)
            for lo, hi in zip(edges, np.append(edges[1:], len(cell)), strict=True):
                asks = np.flatnonzero(needs[mine, cell[lo]])
                for j in range(lo, hi if len(asks) else lo, BLOCK):
                    e = min(j + BLOCK, hi)
                    score = np.repeat(_products(a[asks], v[j:e]), np.diff(bounds[j : e + 1]), axis=1)
                    best[0][asks], best[1][asks] = _best(score, flat[bounds[j] : bounds[e]], k + 1, (best[0][asks], best[1][asks]))
            owners = q.column("ids").combine_chunks()
            row = np.repeat(np.arange(len(a)), owners.value_lengths().to_numpy())
            own = np.repeat(owners.flatten().to_numpy(), k + 1)
            score, id = best[0][row].reshape(-1), best[1][row].reshape(-1)
            keep = (id != own) & (id != NONE)
            out["query_id"].append(own[keep]), out["vec_id"].append(id[keep]), out["score"].append(score[keep])
    return pa.table({n: np.concatenate(x) for n, x in out.items()})


def needed(pivots: np.ndarray, reach: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """[i, j]: whether a query of cell i can have a score of its floor with a vector of cell j, which is
    p.s + r |s| + R |p| + r R at most (pivots p and s, radii r and R of the cells' queries and vectors)."""
    norm = np.sqrt((pivots**2).sum(1))
    r, big = np.maximum(reach, 0)[:, None], np.maximum(radius, 0)[None, :]
    most = pivots @ pivots.T + r * norm[None, :] + big * norm[:, None] + r * big
    most += SLACK * (1 + (norm[:, None] + r) * (norm[None, :] + big))
    return most >= floor[:, None]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both sides have id and v (array<long>); missing components of shorter vectors count as 0. A query's own row, the one
    with its id, is no candidate. Fewer than k candidates give fewer rows. Equal vectors are one candidate with its k + 1
    smallest ids, which is all that can be ranked; repeated rows (id and vector) count once. A score that leaves 64 bits is
    an error. Without vectors or queries there are no rows.
    """
    spark, result = vectors.sparkSession, "query_id long, vec_id long, score long"
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Equal vectors: their k + 1 smallest ids, by levels of partial lists, so that no task holds all ids of one vector.
    vectors = stored(_least_ids(vectors, k + 1), "vectors")
    queries = stored(queries.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.sort_array(F.collect_set("id")).alias("ids")), "asked")
    width = max(df.agg(F.coalesce(F.max(F.size("v")), F.lit(-1))).first()[0] for df in (vectors, queries))
    pool = vectors.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(cells * POOL).select("v").toArrow()
    if not pool.num_rows or width < 0:
        return nothing
    pool = _matrix(pool.column("v"), width).astype(np.float64)
    # Farthest-first pivots.
    chosen, far = [0], np.full(len(pool), np.inf)
    while len(chosen) < min(cells, len(pool)):
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    pivots = pool[chosen]
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches):
        for batch in batches:
            v, p = _matrix(batch.column("v"), width).astype(np.float64), shared.value
            square = np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1) - 2 * v @ p.T, 0)
            cell = square.argmin(1)
            near = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(cell.astype(np.int32)), pa.array(near)], names=["v", "ids", "cell", "near"])

    place = "v array<long>, ids array<long>, cell int, near double"
    vectors, queries = (stored(df.select("v", "ids").mapInArrow(placed, place), n) for df, n in ((vectors, "data"), (queries, "queries")))

    def summary(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Radius (-1: empty) and rows of each cell."""
        radius, rows = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
        for r in df.groupBy("cell").agg(F.max("near").alias("r"), F.count(F.lit(1)).alias("n")).collect():
            radius[r["cell"]], rows[r["cell"]] = r["r"], r["n"]
        return radius, rows

    (reach, asked), (radius, many) = summary(queries), summary(vectors)
    if not asked.sum():
        return nothing

    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    of_cell = lambda values: F.get(F.array(*(F.lit(int(x)).cast("long") for x in values)), F.col("cell"))

    def joined(q: DataFrame, d: DataFrame, needs: np.ndarray) -> DataFrame:
        """Both sides have v, ids, cell and the keys group, share, part."""
        keys, told = ["group", "share", "part"], spark.sparkContext.broadcast(needs)
        return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(lambda a, b: _solved(a, b, told.value, k, width), result)

    # First each query in its own cell, whose (k + 1)-th best score is a floor. A cell has parts of TASK_ROWS vectors and
    # shares of TASK_ROWS queries.
    parts, shares = np.maximum(-(-many // TASK_ROWS), 1), np.maximum(-(-asked // TASK_ROWS), 1)
    own = F.col("cell").cast("long").alias("group")
    q = queries.select("v", "ids", "cell", own, F.pmod(F.xxhash64("v", "ids"), of_cell(shares)).alias("share"), upto(of_cell(parts)).alias("part"))
    d = vectors.where(of_cell(asked) > 0).select("v", "ids", "cell", own, F.pmod(F.xxhash64("v"), of_cell(parts)).alias("part"), upto(of_cell(shares)).alias("share"))
    first = stored(joined(q, d, np.eye(len(pivots), dtype=bool)), "own")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("n", F.row_number().over(order)).where(f"n = {k}").select("query_id", F.col("score").alias("floor"))
    of = queries.select("cell", F.explode("ids").alias("query_id")).join(floors, "query_id", "left")
    floor = np.full(len(pivots), -np.inf)
    for r in of.groupBy("cell").agg(F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("floor")).collect():
        floor[r["cell"]] = r["floor"]

    needs = needed(pivots, reach, radius, floor)
    needs[asked == 0], needs[:, many == 0] = False, False
    np.fill_diagonal(needs, False)

    # Cells of queries that need much the same data share a task, up to TASK_ROWS queries; a larger cell is split.
    group, held, last, left = np.zeros(len(pivots), np.int64), 0, 0, [int(i) for i in np.flatnonzero(asked)]
    at = left[0]
    while left:
        if held and held + asked[at] > TASK_ROWS:
            last, held = last + 1, 0
        group[at], held = last, held + int(asked[at])
        left.remove(at)
        at = min(left, key=lambda i: (int((needs[i] ^ needs[at]).sum()), i)) if left else at
    shares = np.array([max(1, -(-int(asked[(group == g) & (asked > 0)].sum()) // TASK_ROWS)) for g in range(last + 1)])
    parts = max(PARTS, math.ceil(int(many.sum()) / TASK_ROWS))
    wanted = spark.createDataFrame([(j, int(g), s) for j in range(len(pivots)) for g in np.unique(group[needs[:, j]]) for s in range(shares[g])], "cell int, group long, share long")
    q = queries.withColumn("group", of_cell(group)).select("v", "ids", "cell", "group", F.pmod(F.xxhash64("v", "ids"), of_cell(shares[group])).alias("share"), upto(F.lit(parts).cast("long")).alias("part"))
    d = vectors.join(F.broadcast(wanted), "cell").select("v", "ids", "cell", "group", "share", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("long").alias("part"))
    best = first.union(joined(q, d, needs)) if needs.any() else first
    error = F.raise_error(F.lit("a score leaves 64 bits")).cast("long")
    score = F.when(F.col("score").isin(LEAST, MOST), error).otherwise(F.col("score")).alias("score")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", score)


def _least_ids(vectors: DataFrame, k: int) -> DataFrame:
    """v and its k smallest distinct ids."""
    for parts in (4096, 64, 1):
        part = F.pmod(F.xxhash64(F.col("id") if "id" in vectors.columns else F.element_at("ids", 1)), F.lit(parts)).alias("part")
        ids = F.collect_set("id") if "id" in vectors.columns else F.array_distinct(F.flatten(F.collect_list("ids")))
        vectors = vectors.groupBy("v", part).agg(F.slice(F.sort_array(ids), 1, k).alias("ids")).select("v", "ids")
    return vectors
