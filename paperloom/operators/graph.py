"""The graph of records and entities: degrees, hubs, ties between records, and their communities."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import checkpointed, dealt, dropped, new_table

HUB_SHARE, HUB_SHARE_LARGE, LARGE, HUB_RECORDS, HUB_REACH = 0.6, 0.35, 20, 5, 3
BREADTH = 5
OWNER_RECORDS, OWNER_SHARE, OWNER_MARGIN = 8, 0.30, 1.25
ALIKE, STRONG, TEXT_WEIGHT = 0.14, 0.30, 400
HOLDING = "Everything else"
#: Texts, and terms of texts, that make a block: half of each, or twice as many of one and few of the other.
BLOCK_TEXTS, BLOCK_TERMS = 2048, 1 << 20
#: A task takes the pairs of so many blocks with as many others at most.
TILE = 6
#: Share of the pairs of texts of two blocks that have a term in common, from which it is a column of matrices; columns that
#: are multiplied at once.
DENSE, COLUMNS = 1 / 256, 1024
#: Records of an entity that are paired with as many in one go.
CHUNK = 1 << 12
#: Ties, in both directions, that a task sweeps.
TASK_TIES = 1 << 22
#: Products that one vectorized pass holds.
STEP = 1 << 17


def reach(links: DataFrame) -> DataFrame:
    """entity_id and the number of records that name it."""
    # Of links dealt by records, a task makes its own distinct.
    return links.select("record_id", "entity_id").distinct().groupBy("entity_id").agg(F.count("record_id").alias("reach"))


def health(links: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """One row on the whole graph: sizes, entities of one record, and hubs."""
    n_records = records.agg(F.count(F.lit(1)).alias("records"))
    r = entities.join(reach(links), "entity_id", "left").join(F.broadcast(n_records))
    row = r.agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum((F.col("reach") == 1).cast("int")).alias("singletons"),
        F.sum(((F.col("reach") > 1) & (F.col("reach") / F.col("records") >= 0.4)).cast("int")).alias("hubs"),
    )
    pairs = links.select("record_id", "entity_id").where("record_id IS NOT NULL AND entity_id IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    return row.join(n_records).join(links.agg(F.count(F.lit(1)).alias("links"))).join(pairs).select("records", "entities", "links", F.round(F.col("pairs") / F.col("records"), 6).alias("per_record"), "singletons", F.round(F.col("singletons") / F.col("entities"), 6).alias("singleton_share"), "hubs")


def owner(links: DataFrame, records: DataFrame) -> DataFrame:
    """The entity whose library this is, if one stands out."""
    top = reach(links).orderBy(F.desc("reach"), "entity_id").limit(2).withColumn("place", F.row_number().over(Window.orderBy(F.desc("reach"), "entity_id")))
    ends = top.agg(F.max(F.when(F.col("place") == 1, F.col("entity_id"))).alias("entity_id"), F.max("reach").alias("first"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("reach"))), F.lit(0)).alias("second"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    clear = (F.col("total") >= OWNER_RECORDS) & (F.col("first") / F.col("total") >= OWNER_SHARE) & (F.col("first") >= F.col("second") * OWNER_MARGIN)
    return ends.join(total).where(clear).select("entity_id", F.col("first").alias("reach"))


def binding(links: DataFrame, records: DataFrame) -> DataFrame:
    """Entities that may tie records: in more than one, and neither hubs nor the owner."""
    total = records.agg(F.count(F.lit(1)).alias("total"))
    r = reach(links).where("reach > 1").join(F.broadcast(total))
    limit = F.when(F.col("total") >= LARGE, HUB_SHARE_LARGE).otherwise(HUB_SHARE)
    hub = (F.col("total") >= HUB_RECORDS) & (F.col("reach") >= HUB_REACH) & (F.col("reach") / F.col("total") > limit)
    return r.where(~hub).join(owner(links, records).select("entity_id"), "entity_id", "left_anti").select("entity_id", "reach")


def ties(links: DataFrame, records: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Pairs of records a < b that share entities, with the weight of all that they share; and, given the records' texts
    (id, text), pairs of alike ones, whose cosine adds to the weight as TEXT_WEIGHT parts. `binds` says whether a pair is a
    reason to be together on its own: it shares an entity, or its texts are very alike (STRONG).

    Records of more than BREADTH entities bind nothing by entities, and neither do hubs: what the join multiplies is
    bounded by the reach of the rest. The records of an entity are dealt to chunks of about CHUNK, and pairs of chunks to
    tasks, so no task makes all pairs of an entity.
    """
    pairs = links.select("record_id", "entity_id").distinct()
    binds = checkpointed(binding(links, records))
    if texts is not None:
        return _tied_texts(pairs, binds, texts)
    broad = pairs.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= BREADTH).select("record_id")
    rows = checkpointed(pairs.join(broad, "record_id").join(binds, "entity_id"))
    sizes = checkpointed(rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}")))
    held, most = sizes.agg(F.coalesce(F.sum(F.expr("n * chunks")), F.lit(0)), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()
    # Dealt by entities in as many partitions as there are links, and ties in as many as there can be.
    rows = rows.join(sizes, "entity_id").withColumn("chunk", F.pmod(F.xxhash64("record_id"), "chunks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    a = rows.select("entity_id", F.col("chunk").alias("x"), every.alias("y"), F.col("record_id").alias("a"), F.greatest(F.lit(1), F.expr("1000 div reach")).alias("weight"))
    b = rows.select("entity_id", every.alias("x"), F.col("chunk").alias("y"), F.col("record_id").alias("b"))
    deal = lambda df: dealt(df, max(held, most // 16), "entity_id", "x", "y")
    tied = deal(a).join(deal(b), ["entity_id", "x", "y"]).where("a < b").select("a", "b", "weight", F.lit(True).alias("binds"))
    return dealt(tied, most, "a").groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("binds").alias("binds"))


def _tied_texts(pairs: DataFrame, binds: DataFrame, texts: DataFrame) -> DataFrame:
    """`ties` of records with texts: one search of pairs of blocks finds what two records share and how alike they are, so no
    tie is shuffled."""
    spark = texts.sparkSession
    numbered = checkpointed(binds.withColumn("number", F.monotonically_increasing_id()))
    breadth = pairs.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    # Broad records share entities too, though these give no weight.
    weight = F.when(F.col("n") <= BREADTH, F.greatest(F.lit(1), F.expr("1000 div reach"))).otherwise(0).cast("double")
    shared = pairs.join(numbered, "entity_id").join(breadth, "record_id").groupBy(F.col("record_id").alias("id"))
    shared = shared.agg(F.array_sort(F.collect_list(F.struct("number", weight.alias("w")))).alias("e")).select("id", F.col("e.number").alias("entities"), F.col("e.w").alias("es"))
    found = _found(spark, _vectors(texts).join(shared, "id", "full"), texts.schema["id"].dataType.simpleString(), ALIKE)
    cosine = F.round("cosine", 6)
    near = F.when(F.col("cosine").isNotNull(), F.floor(cosine * TEXT_WEIGHT)).otherwise(0)
    binding = F.col("weight").isNotNull() & (F.col("weight") > 0) | F.coalesce((near > 0) & (F.col("shares") | (cosine >= STRONG)), F.lit(False))
    rows = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("weight") + near).alias("weight"), binding.alias("binds"))
    return rows.where("weight > 0")


def alike(texts: DataFrame, least: float = ALIKE, considered: int | None = None) -> DataFrame:
    """Pairs a < b of texts (id, text) with the cosine of their weighted terms, where it reaches `least`. All words of a text
    count, or those of its first `considered` characters. Null and empty texts, and ids that are null, have no pairs; rows
    with equal ids are one text.

    Terms of one text or of more than half of them count for nothing. Vectors are dealt to blocks, a file each; tasks take
    pairs of blocks and read the files, so what is shuffled and written grows with the texts, and only what is read and
    worked out with the pairs of blocks. How a pair of blocks is searched says `_pairs`; no pair of texts is lost.
    """
    found = _found(texts.sparkSession, _vectors(texts, considered), texts.schema["id"].dataType.simpleString(), least)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def _vectors(texts: DataFrame, considered: int | None = None) -> DataFrame:
    """id, keys and ws: the terms of a text and their parts of its direction, commonest last."""
    counts = texts.where(F.col("id").isNotNull()).select("id", F.explode(T.terms(F.col("text"), considered)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = checkpointed(counts)
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).where("df > 1 AND df / n <= 0.5")
    weighted = counts.join(df, "term").withColumn("w", F.col("tf") * F.log(F.col("n") / F.col("df")))
    # Terms of a text in order of df, then of the term: the same order in all texts.
    item = F.struct("df", F.xxhash64("term").alias("key"), "w")
    vectors = weighted.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vectors.select("id", F.col("t.key").alias("keys"), F.transform("t", lambda x: x["w"] / F.col("norm")).alias("ws"))


def _found(spark: SparkSession, vectors: DataFrame, id: str, least: float) -> DataFrame:
    """What `_pairs` finds in all pairs of blocks of `vectors` (id, keys, ws and, if they share entities, entities, es).

    Texts with the same commonest term are dealt to blocks in a row, so texts of one language or kind mostly meet, and blocks
    of others have little in common."""
    lead = F.coalesce(F.element_at("keys", -1) if "entities" not in vectors.columns else F.when(F.size("keys") > 0, F.element_at("keys", -1)), F.lit(0))
    cost = F.greatest(F.size("keys"), F.lit(0)).cast("long") + BLOCK_TERMS // BLOCK_TEXTS
    vectors = checkpointed(vectors.withColumns({"lead": lead, "cost": cost}))
    leads = vectors.groupBy("lead").agg(F.sum("cost").alias("all"))
    leads = checkpointed(leads.withColumn("before", F.sum("all").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))))
    total = leads.agg(F.sum("all")).first()[0] or 0
    blocks = max(1, -(-total // (2 * BLOCK_TERMS)))
    # A block is a file of the shared folder, which the tasks that need it read: what is shuffled is each vector once.
    path = new_table(spark)
    place = F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("id"), F.col("all"))
    dealt_out = vectors.join(F.broadcast(leads), "lead").withColumn("block", F.floor(place * blocks / F.lit(total)).cast("long")).drop("lead", "cost", "all", "before")
    dealt_out.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    dropped(vectors, leads)
    # Tiles of the pairs of blocks, as large as leaves some for each core.
    side = next((n for n in range(TILE, 1, -1) if -(-blocks // n) * (-(-blocks // n) + 1) // 2 >= 3 * spark.sparkContext.defaultParallelism), 1)
    across = -(-blocks // side)
    tiles = across * (across + 1) // 2
    ties = ", weight long, shares boolean" if "entities" in vectors.columns else ""
    return spark.range(0, tiles, 1, tiles).mapInArrow(lambda batches: _tiles(batches, path, side, blocks, least), f"x {id}, y {id}, cosine double{ties}")


class _Lists:
    """Rows of terms and values, both ways: `word` and `value` of each row's terms, from `start` of the row on, and `row_of`
    and `value_of` of each word's rows, from `begin` of the word on. `words` are the terms, in order."""

    def __init__(self, keys: pa.ListArray, values: pa.ListArray):
        sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
        self.start = np.append(0, np.cumsum(sizes))
        self.words, self.word = np.unique(keys.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.value, row = values.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(self.word, kind="stable")
        self.row_of, self.value_of = row[order], self.value[order]
        self.count = np.bincount(self.word, minlength=len(self.words))
        self.begin = np.cumsum(self.count) - self.count

    @functools.cached_property
    def tables(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """The rows of each word, and their values, as rows of tables of about as long lists, filled up with zeros; a word's
        table and place there."""
        sizes = [1, 2, 3]
        while sizes[-1] < self.count.max(initial=1):
            sizes += [k * sizes[-1] // 12 for k in (16, 20, 24)] if sizes[-1] % 12 == 0 else [sizes[-1] + 1]
        kind, slot, tables = np.searchsorted(sizes, self.count), np.zeros(len(self.count), int), []
        for k, size in enumerate(sizes):
            words = np.flatnonzero(kind == k)
            slot[words] = np.arange(len(words))
            at, there = self.begin[words][:, None] + np.arange(size), np.arange(size) < self.count[words][:, None]
            at = np.minimum(at, max(len(self.row_of) - 1, 0))
            tables.append((np.where(there, self.row_of[at], 0), np.where(there, self.value_of[at], 0.0)) if len(words) else (np.zeros((0, size), int), np.zeros((0, size))))
        return tables, kind, slot

    def common(self, other: _Lists) -> tuple[np.ndarray, np.ndarray]:
        """Numbers here and there of the words that both have."""
        if not len(self.words) or not len(other.words):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(other.words, self.words), len(other.words) - 1)
        here = np.flatnonzero(other.words[at] == self.words)
        return here, at[here]

    def columns(self, words: np.ndarray) -> np.ndarray:
        """A matrix of all rows with a column for each of the words."""
        n = self.count[words]
        entry = _ranges(self.begin[words], n)
        out = np.zeros((len(self.start) - 1, len(words)))
        out[self.row_of[entry], np.repeat(np.arange(len(words)), n)] = self.value_of[entry]
        return out


_SCRATCH: dict[str, np.ndarray] = {}


def _scratch(name: str, size: int, kind: type = np.float64) -> np.ndarray:
    """An array of this process that is used again and again: getting pages for large ones takes longer than filling them."""
    if name not in _SCRATCH or len(_SCRATCH[name]) < size:
        _SCRATCH[name] = np.empty(size + size // 4, kind)
    return _SCRATCH[name][:size]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, n[0] of them, then those of the next."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def _met(x: _Lists, y: _Lists, here: np.ndarray, there: np.ndarray, width: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For some rows of x at a time, first and last: the cells (row - first) * width + row of y where the words here and there
    meet, and the values of both, in pieces of about STEP."""
    number = np.full(len(x.words) + 1, -1)
    number[here] = there
    number = number[x.word]
    entry = np.flatnonzero(number >= 0)
    number = number[entry]
    n, begin, value = y.count[number], y.begin[number], x.value[entry]
    start = np.searchsorted(entry, x.start)
    row = np.repeat(np.arange(len(x.start) - 1), np.diff(start))
    done = np.append(0, np.cumsum(n))
    most, first = max(1, STEP // max(width, 1)), 0
    while first < len(x.start) - 1:
        last = int(np.searchsorted(done[start], done[start[first]] + STEP, "right")) - 1
        last = min(max(last, first + 1), first + most, len(x.start) - 1)
        pieces, lo = [], start[first]
        while lo < start[last]:
            hi = min(max(lo + 1, int(np.searchsorted(done, done[lo] + STEP, "right")) - 1), start[last])
            m = n[lo:hi]
            at = _ranges(begin[lo:hi], m)
            pieces.append((np.repeat((row[lo:hi] - first) * width, m) + y.row_of[at], np.repeat(value[lo:hi], m), y.value_of[at]))
            lo = hi
        yield first, last, pieces
        first = last


class _Block:
    """Texts in order of their ids, with their terms and, where records share entities, these."""

    def __init__(self, t: pa.Table):
        t = t.take(pc.sort_indices(t.column("id"))).combine_chunks()
        column = lambda name: pa.concat_arrays(t.column(name).chunks) if t.column(name).num_chunks else pa.array([], t.schema.field(name).type)
        self.ids, self.terms = column("id"), _Lists(column("keys"), column("ws"))
        self.entities = _Lists(column("entities"), column("es")) if "entities" in t.column_names else None


def _tiles(batches: Iterator[pa.RecordBatch], path: str, side: int, blocks: int, least: float) -> Iterator[pa.RecordBatch]:
    """What `_pairs` finds in the tiles with the numbers in `batches`: (0, 0), (0, 1), (1, 1), (0, 2) and so on, each the pairs
    of `side` blocks with as many."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)

    def block(number: int) -> _Block | None:
        folder = fs.FileSelector(f"{root}/block={number}", allow_not_found=True)
        files = [f.path for f in store.get_file_info(folder) if f.is_file and f.base_name.startswith("part-")]
        return _Block(pa.concat_tables(pq.ParquetFile(store.open_input_file(f)).read() for f in files)) if files else None

    for batch in batches:
        for tile in batch.column(0).to_pylist():
            j = (math.isqrt(8 * tile + 1) - 1) // 2
            i = tile - j * (j + 1) // 2
            held = {k: block(k) for k in range(j * side, min(j * side + side, blocks))}
            for k in range(i * side, min(i * side + side, blocks)):
                x = held[k] if k in held else block(k)
                for number, y in held.items():
                    if x and y and k <= number:
                        for found in _pairs(x, y, least):
                            yield from found.to_batches(1 << 16)


def _pairs(x: _Block, y: _Block, least: float) -> Iterator[pa.Table]:
    """Pairs x, y of texts of two blocks with a cosine of `least` and more or an entity in common; of a block with itself, each
    pair once.

    Terms that many of the pairs have in common (DENSE) are columns of two matrices, whose product has their part of all
    cosines. Of the others, each text meets the list of the texts that have the term. Both parts make the whole cosine.
    """
    width = len(y.ids)
    here, there = x.terms.common(y.terms)
    dense = x.terms.count[here] * y.terms.count[there] > DENSE * len(x.ids) * width
    product = None
    for k in range(0, int(dense.sum()), COLUMNS):
        a, b = x.terms.columns(here[dense][k : k + COLUMNS]), y.terms.columns(there[dense][k : k + COLUMNS])
        part = np.matmul(a, b.T, _scratch("product" if product is None else "more", len(x.ids) * width).reshape(-1, width))
        product = part if product is None else np.add(product, part, product)
    some = product is not None or len(here) > 0
    shared = _met(x.entities, y.entities, *x.entities.common(y.entities), width) if x.entities else None
    near = _near(x, y, here[~dense], there[~dense], product, least) if some else iter(())
    if not shared:
        for cells, cosine in near:
            i, j = np.divmod(cells, width)
            yield pa.table({"x": x.ids.take(pa.array(i)), "y": y.ids.take(pa.array(j)), "cosine": cosine})
        return
    # What is shared comes in pieces of its own: cells of both are numbered through.
    of_near = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(list(zip(*near, strict=True)) or [[], []], (int, float), strict=True)]
    for first, last, pieces in shared:
        cell = np.concatenate([c for c, _, _ in pieces]) if pieces else np.zeros(0, int)
        both = np.concatenate([np.where(b > 0, a, 0.0) for _, a, b in pieces]) if pieces else np.zeros(0)
        cell += first * width
        if x is y:
            i, j = np.divmod(cell, width)
            cell, both = cell[i < j], both[i < j]
        met, number = np.unique(cell, return_inverse=True)
        lo, hi = np.searchsorted(of_near[0], [first * width, last * width])
        cells = np.union1d(met, of_near[0][lo:hi])
        weight, shares, cosine, without = np.zeros(len(cells), np.int64), np.zeros(len(cells), bool), np.zeros(len(cells)), np.ones(len(cells), bool)
        at = np.searchsorted(cells, met)
        weight[at], shares[at] = np.bincount(number, both, len(met)), True
        at = np.searchsorted(cells, of_near[0][lo:hi])
        cosine[at], without[at] = of_near[1][lo:hi], False
        keep = (weight > 0) | ~without
        i, j = np.divmod(cells[keep], width)
        yield pa.table({"x": x.ids.take(pa.array(i)), "y": y.ids.take(pa.array(j)), "cosine": pa.array(cosine[keep], mask=without[keep]), "weight": weight[keep], "shares": shares[keep]})


def _near(x: _Block, y: _Block, here: np.ndarray, there: np.ndarray, product: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (row of x * texts of y + row of y), in order, and cosines of `least` and more: what the words here and there add to
    `product`. A word's list of y is a row of a table with lists of about its length, so that lists are taken whole."""
    width, terms = len(y.ids), x.terms
    tables, kind, slot = y.terms.tables
    number = np.full(len(terms.words), -1)
    number[here] = there
    number = number[terms.word]
    entry = np.flatnonzero(number >= 0)
    number, value = number[entry], terms.value[entry]
    kinds, slots = kind[number], slot[number]
    n = np.array([t[0].shape[1] for t in tables] or [1])[kinds] if len(entry) else np.zeros(0, int)
    start, done = np.searchsorted(entry, terms.start), np.append(0, np.cumsum(n))
    row = np.repeat(np.arange(len(x.ids)), np.diff(start)) * width
    first = 0
    while first < len(x.ids):
        last = int(np.searchsorted(done[start], done[start[first]] + STEP, "right")) - 1
        last = min(max(last, first + 1), first + max(1, STEP // width), len(x.ids))
        lo, hi = start[first], start[last]
        cell, part, filled = _scratch("cell", int(done[hi] - done[lo]), np.int64), _scratch("part", int(done[hi] - done[lo])), 0
        order = np.argsort(kinds[lo:hi], kind="stable") + lo
        ends = np.searchsorted(kinds[order], np.arange(len(tables) + 1))
        for (rows, values), k, m in zip(tables, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if k < m:
                of, until = order[k:m], filled + (m - k) * rows.shape[1]
                met, weight = cell[filled:until].reshape(m - k, -1), part[filled:until].reshape(m - k, -1)
                rows.take(slots[of], 0, met, "clip")
                values.take(slots[of], 0, weight, "clip")
                met += (row[of] - first * width)[:, None]
                weight *= value[of][:, None]
                filled = until
        if product is None:
            cosine = _scratch("cosine", (last - first) * width)
            cosine[:] = 0
        else:
            cosine = product[first:last].reshape(-1)
        np.add.at(cosine, cell, part)
        cells = np.flatnonzero(cosine >= least)
        if x is y:
            i, j = np.divmod(cells, width)
            cells = cells[first + i < j]
        if len(cells):
            yield cells + first * width, cosine[cells]
        first = last


def communities(ties: DataFrame, sweeps: int = 20) -> DataFrame:
    """record_id and label: in order of ids, each record takes the label of most weight among its neighbours, ties to the
    smallest, if a neighbour with that label is bound to it, sweep after sweep until nothing changes. `ties` are pairs a, b
    with weight and binds (see `ties`), each pair once; rows with a null in them and those that tie a record to itself count
    for nothing. A label is the id of a record; records without ties are not listed.

    Ties are dealt to tasks by their first record, and swept in rounds by all of them (`swept`).
    """
    ties = ties.where("a <> b AND weight IS NOT NULL AND binds IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"), "weight", "binds")
    ties = checkpointed(ties)
    return swept(ties.union(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "binds")), sweeps)[0]


def swept(both: DataFrame, sweeps: int = 20) -> tuple[DataFrame, int, int]:
    """Labels (record_id, label) as `communities` gives them, the number of rounds of all sweeps, and that of sweeps; `both`
    has each tie in both directions.

    A record needs the labels that smaller neighbours have got in this sweep, and those that larger ones had before. So in a
    sweep all records are decided by the labels at hand, then those again of which a smaller neighbour's label has become
    another, until none does: labels that agree with each other so are those of the sweep in order of ids, since the
    smallest record's is right, and so is each whose smaller neighbours' are. A sweep begins with the records of which a
    larger neighbour's label changed in the one before; the others would decide as they did. Rounds of a sweep are as many as
    the longest chain of ties with rising ids at most, and few where decisions don't hang on each other.

    Records are numbered in order of their ids, and ties are written by these numbers once, a file of about TASK_TIES for a
    task. What a round reads besides is a table of labels by number, 13 bytes a record; no round shuffles anything.
    """
    spark = both.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // TASK_TIES))
    ids = checkpointed(both.select("a").distinct().repartitionByRange(parts, "a").sortWithinPartitions("a"))
    n, id_files = ids.count(), _files(ids)
    kind = both.schema["weight"].dataType.simpleString()
    ties = both.select("a", "b", "weight", "binds").repartition(parts, "a").mapInArrow(lambda batches: _numbered(batches, id_files), f"a int, b int, weight {kind}, binds boolean")
    tie_files = _files(checkpointed(ties)) if n else []
    tasks = max(len(tie_files), 1)
    state, rounds, done = None, 0, 0
    for done in range(1, sweeps + 1):
        begins = True
        while True:
            rounds += 1
            files = _files(state) if state is not None else []
            run = functools.partial(_round, tie_files=tie_files, state_files=files, n=n, begins=begins)
            new = checkpointed(spark.range(0, tasks, 1, tasks).mapInArrow(run, "a int, before int, label int, moved boolean"))
            if state is not None:
                dropped(state)
            state, begins = new, False
            if state.where("moved").isEmpty():
                break
        if state.where("label <> before").isEmpty():
            break
    labels = state.select("a", "label").mapInArrow(lambda batches: _named(batches, id_files), "record_id long, label long")
    return labels, rounds, done


def _files(table: DataFrame) -> list[str]:
    """Files of a stored table, in the order of the partitions that wrote them."""
    return sorted(table.inputFiles(), key=lambda f: f.rpartition("/")[2])


def _column(files: list[str], *names: str) -> list[np.ndarray]:
    """Columns of files, whole."""
    from pyarrow import fs

    tables = []
    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        tables.append(pq.ParquetFile(store.open_input_file(path)).read(list(names)))
    return [np.concatenate([t.column(c).to_numpy() for t in tables]) if tables else np.zeros(0, np.int64) for c in names]


def _numbered(batches: Iterator[pa.RecordBatch], id_files: list[str]) -> Iterator[pa.RecordBatch]:
    """A partition of ties by the numbers of their records, in order."""
    held = list(batches)
    if held:
        t = pa.Table.from_batches(held)
        (ids,) = _column(id_files, "a")
        a, b = (np.searchsorted(ids, t.column(c).to_numpy()).astype(np.int32) for c in ("a", "b"))
        order = np.lexsort((b, a))
        weight, binds = (t.column(c).combine_chunks().take(pa.array(order)) for c in ("weight", "binds"))
        yield from pa.table({"a": a[order], "b": b[order], "weight": weight, "binds": binds}).to_batches(1 << 16)


def _named(batches: Iterator[pa.RecordBatch], id_files: list[str]) -> Iterator[pa.RecordBatch]:
    """Numbers of records and labels as ids."""
    ids = None
    for batch in batches:
        ids = _column(id_files, "a")[0] if ids is None else ids
        yield pa.RecordBatch.from_pydict({"record_id": ids[batch.column(0).to_numpy()], "label": ids[batch.column(1).to_numpy()]})


def _round(batches: Iterator[pa.RecordBatch], tie_files: list[str], state_files: list[str], n: int, begins: bool) -> Iterator[pa.RecordBatch]:
    """A round of `swept` for the records of the files with the numbers in `batches`: a, the label before the sweep, that at
    hand, and whether this round changed it. `begins`: whether the sweep does."""
    before = np.arange(n, dtype=np.int32)
    label, moved = before, np.ones(n, bool)
    if state_files:
        a, b, c, m = _column(state_files, "a", "before", "label", "moved")
        before, label = np.empty(n, np.int32), np.empty(n, np.int32)
        before[a], label[a], moved[a] = b, c, m
        if begins:
            moved, before = before != label, label
    for batch in batches:
        for file in batch.column(0).to_pylist():
            if file >= len(tie_files):
                continue
            a, b, weight, binds = _column(tie_files[file : file + 1], "a", "b", "weight", "binds")
            own, start = np.unique(a, return_index=True)
            hear = moved[b] & ((b > a) if begins else (b < a)) if state_files else np.ones(len(a), bool)
            asked = np.logical_or.reduceat(hear, start)
            rows = np.repeat(asked, np.diff(np.append(start, len(a))))
            new = label[own]
            if asked.any():
                a, b, weight, binds = a[rows], b[rows], weight[rows], binds[rows]
                vote = np.where(b < a, label[b], before[b])
                order = np.argsort(a.astype(np.int64) * n + vote, kind="stable")
                a, vote = a[order], vote[order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (vote[1:] != vote[:-1])))
                a, vote, weight, binds = a[first], vote[first], np.add.reduceat(weight[order], first), np.logical_or.reduceat(binds[order], first)
                # Of a record's votes the first with most weight: they are in order of labels.
                of = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                most = np.repeat(np.maximum.reduceat(weight, of), np.diff(np.append(of, len(a))))
                best = np.minimum.reduceat(np.where(weight == most, np.arange(len(a)), len(a)), of)
                new[asked] = np.where(binds[best], vote[best], before[a[best]])
            yield from pa.table({"a": own, "before": before[own], "label": new, "moved": new != label[own]}).to_batches(1 << 16)


def voted(groups: DataFrame, least: int = 3) -> DataFrame:
    """Names for groups of records (group_id, value: the category guessed for a record or null, kind: what it is or null).

    Groups of fewer than `least` are held back. A name is the most frequent guess (ties alphabetical), or else the plural of
    the most frequent kind; in groups of three and more it needs two votes. A group whose name a larger one has (ties by
    group_id) is named by its most frequent kind instead, if it has one.
    """
    said = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    guess = F.when(said(F.col("value")) != HOLDING, said(F.col("value")))

    def most(value: Column, name: str) -> DataFrame:
        votes = groups.select("group_id", value.alias("v")).where("v IS NOT NULL").groupBy("group_id", "v").agg(F.count(F.lit(1)).alias("n"))
        return votes.groupBy("group_id").agg(F.min_by(F.struct("v", "n"), F.struct(-F.col("n"), "v")).alias(name))

    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    rows = size.join(most(guess, "guess"), "group_id", "left").join(most(said(F.col("kind")), "kind"), "group_id", "left")
    plural = T.plural(F.col("kind.v"))
    shelf = F.concat(F.upper(F.substring(plural, 1, 1)), F.substring(plural, F.lit(2), F.length(plural)))
    wins = lambda c: (F.col("size") < 3) | (F.col(f"{c}.n") >= 2)
    name = F.when(F.col("size") < least, HOLDING).when(F.col("guess").isNotNull() & wins("guess"), F.col("guess.v")).when(F.col("kind").isNotNull() & wins("kind"), shelf).otherwise(HOLDING)
    rows = rows.select("group_id", "size", name.alias("first"), shelf.alias("other"), name.alias("category"))
    rows = checkpointed(rows)
    order = F.struct((-F.col("size")).alias("n"), "group_id")
    while True:
        # A name is taken by the first group that has it now; settled from the largest group on.
        owner = rows.where(F.col("size") >= least).groupBy(F.col("category").alias("first")).agg(F.min(order).alias("owner"))
        taken = F.coalesce(F.col("owner") < order, F.lit(False)) & F.col("other").isNotNull() & (F.col("size") >= least)
        new = rows.join(owner, "first", "left").withColumn("new", F.when(taken, F.col("other")).otherwise(F.col("first")))
        new = checkpointed(new.select("group_id", "size", "first", "other", F.col("category").alias("before"), F.col("new").alias("category")))
        rows = new.drop("before")
        if new.where("before <> category").isEmpty():
            return rows.select("group_id", "size", "category")


def vocabulary(fields: DataFrame, top: int = 14) -> DataFrame:
    """The `top` field names of each category by use."""
    uses = fields.groupBy("category", "field").agg(F.count(F.lit(1)).alias("uses"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("uses"), "field"))
    return uses.withColumn("place", place).where(F.col("place") <= top)


def recent_vocabulary(fields: DataFrame, records: int = 80, top: int = 14) -> DataFrame:
    """Field names in use where no category is known: the `top` ones of the latest `records` by id."""
    latest = fields.select("record_id").distinct().orderBy(F.desc("record_id")).limit(records)
    uses = fields.join(F.broadcast(latest), "record_id").groupBy("field").agg(F.count(F.lit(1)).alias("uses"))
    return uses.orderBy(F.desc("uses"), "field").limit(top)


def divergent(fields: DataFrame) -> DataFrame:
    """Records (category, record_id, field) of which a third of the names aren't settled, in categories of three records
    at least. A name is settled if more than half of its category's records have it."""
    rows = fields.where(F.col("category") != HOLDING).select("category", "record_id", "field").distinct()
    size = rows.groupBy("category").agg(F.count_distinct("record_id").alias("records")).where("records >= 3")
    settled = rows.groupBy("category", "field").agg(F.count(F.lit(1)).alias("uses")).join(size, "category").withColumn("odd", (F.col("uses") <= F.col("records") / 2).cast("int"))
    share = rows.join(settled, ["category", "field"]).groupBy("category", "record_id").agg(F.round(F.avg("odd"), 6).alias("odd_share"))
    return share.where("odd_share >= 0.34")


def coherence(fields: DataFrame) -> DataFrame:
    """Of all uses of field names, the share of each category's most used one; 1 without uses. Records without a category
    (null or empty) count for nothing."""
    uses = fields.where("category <> ''").groupBy("category", "field").agg(F.count(F.lit(1)).alias("uses"))
    best = uses.groupBy("category").agg(F.max("uses").alias("most"), F.sum("uses").alias("all"))
    return best.agg(F.coalesce(F.round(F.sum("most") / F.sum("all"), 6), F.lit(1.0)).alias("coherence"))


def settled(fields: DataFrame, reread: Callable[[DataFrame], DataFrame], limit: int = 3) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """Reads divergent records again until none is left, coherence doesn't rise, or `limit` passes are done.

    `reread` takes records (category, record_id) and returns their fields (category, record_id, field) as they are read now;
    a record that it doesn't return keeps what it had. Returns the fields, and of each pass how many records were read
    again and the coherence before and after.
    """
    passes, fields = [], checkpointed(fields.select("category", "record_id", "field"))
    for _ in range(limit):
        before = coherence(fields).first()[0]
        bad = checkpointed(divergent(fields).select("category", "record_id").distinct())
        if bad.isEmpty():
            break
        read = checkpointed(reread(bad).select("category", "record_id", "field"))
        again = read.select("record_id").distinct()
        fields = checkpointed(fields.join(again, "record_id", "left_anti").unionByName(read))
        after = coherence(fields).first()[0]
        passes.append((again.count(), before, after))
        if after <= before:
            break
    return fields, passes
