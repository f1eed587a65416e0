"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and a remainder. The remainders' length histogram (bins of 16 tokens, so its size
is fixed) is the demand of a cutting-stock problem: a linear program over patterns of bins that fit a sequence, whose
columns are priced by a knapsack dynamic program. Rounded down, patterns are assigned to documents by their rank within
a bin; what rounding leaves is packed first-fit. One document in eight, chosen by a hash, is cut freely instead: their
token stream fills the gaps that patterns leave, and what is left of it makes further full sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._arrow import append, text_of
from paperloom.llm._tables import stored
from paperloom.llm.bpe import vocabulary

CAPACITY = 2048
#: Tokens of a bin of the length histogram.
BIN = 16
#: One document in so many is cut freely.
FREE = 8
#: Parts in which running totals are made.
PARTS = 1024
#: Tokens of a block in which gaps and free documents meet.
BLOCK = 1 << 16


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest dual value that fits: an unbounded knapsack, by dynamic programming over capacities."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            value = best[c - sizes[fit]] + duals[fit]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], last[c] = value[k], fit[k]
    pattern, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def relaxed(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Patterns, how often each is used, and the duals, of the linear program that covers `need` with fewest sequences.

    Revised simplex with column generation; the first basis has one pattern for each size.
    """
    columns = [np.eye(len(sizes), dtype=int)[i] * (capacity // s) for i, s in enumerate(sizes)]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes]))
    amount = inverse @ need
    for _ in range(40 * len(sizes) + 200):
        duals = inverse.sum(0)  # every pattern costs one sequence
        value, column = price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - move * ratio[out]
        amount[out] = ratio[out]
        inverse[out] /= move[out]
        for i in np.flatnonzero(np.abs(move) > 1e-12):
            if i != out:
                inverse[i] -= move[i] * inverse[out]
        columns[out] = column
    return columns, amount, inverse.sum(0)


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern {size: copies}, times) that cover the demand {size: items}, near the fewest."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    columns, amount, _ = relaxed(sizes, need, capacity)
    left, made = need.astype(int), []
    for used, x in zip(columns, amount, strict=True):
        times = int(np.floor(x + 1e-9))
        times = min([times, *(left[i] // used[i] for i in np.flatnonzero(used))]) if used.any() else 0
        if times > 0:
            left = left - times * used
            made.append(({int(sizes[i]): int(used[i]) for i in np.flatnonzero(used)}, times))
    # First fit, longest first, of what rounding left.
    bins: list[list] = []
    for i in range(len(sizes))[::-1]:
        for _ in range(left[i]):
            place = next((b for b in bins if b[0] + sizes[i] <= capacity), None)
            if place is None:
                bins.append(place := [0, {}])
            place[0] += int(sizes[i])
            place[1][int(sizes[i])] = place[1].get(int(sizes[i]), 0) + 1
    return made + [(b[1], 1) for b in bins]


def running(df: DataFrame, id: str, values: dict[str, Column]) -> DataFrame:
    """Adds <name>: the sum of a value over all rows before, in one order of the unique `id`s. No task sees all rows."""
    part = F.pmod(F.xxhash64(id), F.lit(PARTS))
    df = df.withColumn("__part", part).withColumns({f"__v_{n}": v for n, v in values.items()})
    sums = df.groupBy("__part").agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumnRenamed("__part", "__p").select("__p", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values))
    within = Window.partitionBy("__part").orderBy(id).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)) for n in values})
    df = df.join(F.broadcast(sums), F.col("__part") == F.col("__p")).withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in values})
    return df.drop("__part", "__p", *(f"__{k}_{n}" for n in values for k in "vb"))


def tokenized(documents: DataFrame, path: str, id: str, text: str, end: int, capacity: int) -> DataFrame:
    """rid (unique), id, n (tokens with `end`), crcs of full pieces and remainder; ids where free, else null."""

    def encoded(piece: pa.RecordBatch) -> list:
        bpe, last = vocabulary(path), end.to_bytes(4, "little")
        n, crcs, kept = [], [], []
        for free, value in zip(piece.column("free").to_pylist(), text_of(piece.column("text")).to_pylist(), strict=True):
            ids = bpe.encode(value) + last
            n.append(len(ids) // 4)
            crcs.append([] if free else [zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
            kept.append(ids if free else None)
        return [pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.binary())]

    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("free", F.pmod(F.xxhash64("id", "rid"), F.lit(FREE)) == 0)
    return append(rows, "text", encoded, "n long, crcs array<long>, ids binary", ["id", "rid", "free"])


def pack(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: id, start and length (tokens of its document), ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids are those of its whole text followed by `end`; null texts are empty and so have one token. Rows
    that repeat an id, or whose id is null, are documents of their own. The last sequences are powers of two long, so
    that only gaps for which there is no free text are padded. Other columns are ignored; an empty table has no pieces.
    """
    spark = documents.sparkSession
    rows = stored(tokenized(documents, path, id, text, end, capacity), "tokens")
    whole, free = rows.where("NOT free"), rows.where("free")
    full, rest = F.expr(f"n div {capacity}"), F.col("n") % capacity
    unit = max(1, min(BIN, capacity // 8))
    bin = F.ceil(rest / unit).cast("int")

    demand = {r["bin"]: r["items"] for r in whole.where(rest > 0).groupBy(bin.alias("bin")).agg(F.count(F.lit(1)).alias("items")).collect()}
    made = patterns(demand, capacity // unit)
    slots, taken, sequences = [], {}, 0
    for pattern, times in made:
        place = 0
        for size in sorted(pattern, reverse=True):
            begin = taken.get(size, 0)
            taken[size] = begin + times * pattern[size]
            slots.append((size, begin, taken[size], pattern[size], sequences, place))
            place += pattern[size]
        sequences += times
    slots = spark.createDataFrame(slots, "s_bin int, lo long, hi long, copies long, base long, place long")

    # Remainders: rank within the bin, then slot, then offset behind the slots before.
    items = whole.where(rest > 0).select("id", "rid", "n", rest.alias("length"), bin.alias("bin"), (F.col("n") - rest).alias("start"), F.element_at("crcs", -1).alias("crc"))
    part = F.pmod(F.xxhash64("rid"), F.lit(PARTS // 16))
    items = items.withColumn("part", part)
    counts = items.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select(F.col("bin").alias("c_bin"), F.col("part").alias("c_part"), F.coalesce(F.sum("k").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "part").orderBy("rid")) - 1)
    items = items.join(F.broadcast(before), (F.col("bin") == F.col("c_bin")) & (F.col("part") == F.col("c_part"))).withColumn("rank", F.col("rank") + F.col("before"))
    items = items.join(F.broadcast(slots), (F.col("bin") == F.col("s_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    items = items.withColumns({"sequence_id": F.col("base") + F.floor(at / F.col("copies")), "slot": F.col("place") + at % F.col("copies")})
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    items = items.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    items = stored(items.select("id", "start", "length", "crc", "n", "sequence_id", F.coalesce("offset", F.lit(0)).alias("offset")), "items")

    # Full pieces, each a sequence of its own.
    long = running(whole.where(full > 0), "rid", {"first": full})
    long = long.select("id", "n", "first", F.posexplode(F.slice("crcs", F.lit(1), full.cast("int"))).alias("k", "crc"))
    n_full = whole.agg(F.coalesce(F.sum(full), F.lit(0))).first()[0]
    long = long.select("id", (F.col("k") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "crc", "n", (F.col("first") + F.col("k") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Free documents: one stream, first into the gaps, then into sequences of its own.
    gaps = items.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(f"used < {capacity}")
    gaps = running(gaps, "sequence_id", {"lo": capacity - F.col("used")}).withColumn("hi", F.col("lo") + capacity - F.col("used"))
    gap = gaps.agg(F.max("hi")).first()[0] or 0
    total = free.agg(F.sum("n")).first()[0] or 0
    stream = running(free.select("id", "rid", "n"), "rid", {"from": F.col("n")}).withColumn("to", F.col("from") + F.col("n"))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK), F.floor((hi - 1) / BLOCK))).alias("block")
    left = stream.where(F.col("from") < gap).select("rid", "from", "to", blocks(F.col("from"), F.col("to")))
    right = gaps.where(F.col("lo") < total).select("sequence_id", "used", "lo", "hi", blocks(F.col("lo"), F.col("hi")))
    begin, finish = F.greatest("from", "lo"), F.least("to", "hi")
    filled = left.join(right, "block").where((begin < finish) & (F.floor(begin / BLOCK) == F.col("block")))
    filled = filled.select("rid", (begin - F.col("from")).alias("start"), (finish - begin).alias("length"), "sequence_id", (F.col("used") + begin - F.col("lo")).alias("offset"))
    base, tail = sequences + n_full, max(0, total - gap) % capacity
    tail_at, ends = max(total - tail, 0), []
    for bit in reversed(range(capacity.bit_length())):
        if tail >> bit & 1:
            ends.append((ends[-1] if ends else tail_at) + (1 << bit))
    own = stream.where(F.col("to") > gap).withColumn("from_own", F.greatest("from", F.lit(gap)))
    cuts = F.sequence(F.floor((F.col("from_own") - gap) / capacity), F.floor((F.col("to") - 1 - gap) / capacity))
    own = own.withColumn("k", F.explode(cuts)).withColumns({"lo": F.col("k") * capacity + gap, "hi": F.least((F.col("k") + 1) * capacity + gap, F.lit(total))})
    # The last sequence, if not full, is cut at powers of two.
    tails = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(a).cast("long").alias("a"), F.lit(z).cast("long").alias("z")) for i, (a, z) in enumerate(zip([tail_at, *ends], ends, strict=False)))) if ends else None
    same = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("lo").cast("long").alias("a"), F.col("hi").cast("long").alias("z")))
    own = own.withColumn("part", F.explode(F.when(F.col("lo") >= tail_at, tails).otherwise(same) if ends else same))
    begin, finish = F.greatest("from_own", "part.a"), F.least("to", "part.z")
    own = own.where(begin < finish).select("rid", (begin - F.col("from")).alias("start"), (finish - begin).alias("length"), (F.col("k") + F.col("part.i") + base).alias("sequence_id"), (begin - F.col("part.a")).alias("offset"))
    cuts = filled.union(own).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))

    def summed(batches):
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = [
                    (id, c["start"], c["length"], zlib.crc32(memoryview(ids)[4 * c["start"] : 4 * (c["start"] + c["length"])]), n, c["sequence_id"], c["offset"])
                    for id, n, ids, cut in zip(*(piece.column(x).to_pylist() for x in ("id", "n", "ids", "cuts")), strict=True)
                    for c in cut
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=["id", "start", "length", "crc", "n", "sequence_id", "offset"])

    free = free.join(cuts, "rid").select("id", "n", "ids", "cuts").mapInArrow(summed, "id long, start long, length long, crc long, n long, sequence_id long, offset long")
    return items.unionByName(long).unionByName(free).select(F.col("id").alias(id), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
