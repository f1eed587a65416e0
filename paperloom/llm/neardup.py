"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so half the
hash evaluations of plain MinHash suffice. Bands of the signature bring candidates together; each candidate pair is
confirmed on the full shingle sets; the links' connected components are the groups.

Equal sets are one node from the start. In each bucket all nodes are first held against the smallest one (in one bucket
of four, another one), which joins most of a group by a row for each member. Buckets whose nodes are then still in
different components are searched whole, in blocks, for pairs of different components: signatures rule out pairs far
below the threshold (five standard deviations); only nodes with a partner left bring their sets to a second search of
the block, where the sets decide and only links leave the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._arrow import append, bytes_of, mixed, pieces, prefix_hash, span_hash, spans, whole_groups
from paperloom.llm._tables import drop, perhaps, stored
from paperloom.llm.components import components

PERMUTATIONS = 60
#: Signature values in a band. 24 bands of 5 miss a pair of similarity 0.8 once in 14,000 times, one of 0.85 in 500,000.
BAND = 5
#: Nodes in a block of a bucket that is searched whole.
BLOCK = 1024
#: Shingle hashes in such a block.
BLOCK_HASHES = 400_000
#: Standard deviations below the threshold at which a signature rules out a pair.
SIGMAS = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_random = np.random.default_rng(20_240_229)
FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (A-Z lower-cased) and the row of each; fewer words than `words` are one shingle."""
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, ends, row = spans(data, offsets)
    word = span_hash(prefix_hash(data), starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    hashes, rows = [], []
    for n in range(1, words + 1):
        of = np.flatnonzero(count >= words) if n == words else np.flatnonzero(count == n)
        if n == words:
            begin = np.flatnonzero(np.arange(len(word)) - first[row] <= count[row] - words)
        else:
            begin = first[of]
        value = word[begin]
        for k in range(1, n):
            value = mixed(value * STEP + word[begin + k])
        hashes.append(value + np.uint64(n))
        rows.append(row[begin])
    return np.concatenate(hashes), np.concatenate(rows)


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under every permutation."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(values), 8192):
        moved = values[i : i + 8192, None] * FACTORS + SHIFTS
        np.minimum(low, moved.min(0), out=low)
        np.maximum(high, moved.max(0), out=high)
    return np.concatenate([low, high])


def _signed(documents: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """id, n (set size), key (digest of the set), bands (array of longs), brief (a byte for each signature value)."""
    n_bands = 2 * PERMUTATIONS // BAND
    # Neighbours in a band come from different permutations: minimum and maximum of one aren't independent.
    order = np.arange(2 * PERMUTATIONS).reshape(BAND, n_bands).T

    def signed(piece: pa.RecordBatch) -> list:
        hashes, rows = shingles(piece.column(text), words)
        # np.unique works on each document's own run.
        order_rows = np.argsort(rows, kind="stable") if len(rows) and np.any(np.diff(rows) < 0) else slice(None)
        hashes, rows = hashes[order_rows], rows[order_rows]
        edges = np.searchsorted(rows, np.arange(piece.num_rows + 1))
        size, key, bands, brief = [], [], [], []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            values = np.unique(hashes[a:z])
            size.append(len(values))
            if not len(values):
                key.append(None), bands.append(None), brief.append(None)
                continue
            key.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            mark = mixed(signature(values))
            brief.append(mark.astype(np.uint8).tobytes())
            band = mark[order[:, 0]]
            for k in range(1, BAND):
                band = mixed(band * STEP + mark[order[:, k]])
            bands.append((band + np.arange(n_bands, dtype=np.uint64)).view(np.int64))
        return [pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())]

    return append(documents.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", signed, "n long, key binary, bands array<long>, brief binary", ["id"])


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node and its distinct shingle hashes, sorted, as packed 64-bit numbers."""

    def packed(piece: pa.RecordBatch) -> list:
        hashes, rows = shingles(piece.column("text"), words)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        edges = np.searchsorted(rows, np.arange(piece.num_rows + 1))
        return [pa.array([np.unique(hashes[a:z]).tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.binary())]

    return append(texts, "text", packed, "hashes binary", ["id"]).withColumnRenamed("id", "node")


def _least(percent: int) -> float:
    """The share of equal signature values below which a pair is ruled out."""
    share = percent / 100
    return share - SIGMAS * (share * (1 - share) / (2 * PERMUTATIONS)) ** 0.5


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agreeing(pairs: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, centre, n) whose signatures don't rule them out."""
    least = _least(percent)

    def near(batches):
        for batch in batches:
            for part in pieces(batch, "x"):
                yield part.filter(pa.array((_marks(part.column("x")) == _marks(part.column("y"))).mean(1) >= least)).select(["node", "centre", "n"])

    both = pairs.join(briefs.select("node", F.col("brief").alias("x")), "node").join(briefs.select(F.col("node").alias("centre"), F.col("brief").alias("y")), "centre")
    return both.select("node", "centre", "n", "x", "y").mapInArrow(near, "node long, centre long, n long").distinct()


def _shared(one: np.ndarray, other: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    return int(np.count_nonzero(one[at] == other))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, centre, n) whose full sets have 100 * intersection >= percent * union, as links (a, b).

    A centre's set travels once for each part of its members, a part having BLOCK_HASHES of them or so.
    """
    parts = pairs.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_HASHES).alias("parts"))
    pairs = pairs.join(parts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    members = pairs.join(sets, "node").select("centre", "part", F.lit(1).alias("place"), "node", "hashes")
    centres = pairs.select("centre", "part").distinct().join(sets.withColumnRenamed("node", "centre"), "centre")
    rows = members.union(centres.select("centre", "part", F.lit(0).alias("place"), F.col("centre").alias("node"), "hashes"))

    def tested(batches):
        """Rows come sorted: a part's centre, then its members."""
        known, mine = None, []
        for batch in batches:
            a, b = [], []
            for centre, part, place, node, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(packed, np.uint64)
                if place == 0:
                    mine = [*mine, own] if known == (centre, part) else [own]
                    known = (centre, part)
                    continue
                for other in mine:
                    both = _shared(other, own)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        a.append(node), b.append(centre)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "place").mapInArrow(tested, "a long, b long")


def _blocks(places: DataFrame) -> DataFrame:
    """Places (bucket, node, n, component, brief) in the blocks i <= j of their buckets that hold pairs of different
    components; `own` is the node's side. What a bucket's largest component has isn't held against itself, so blocks grow
    with the product of the other nodes and all nodes."""
    of = places.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    top = of.groupBy("bucket").agg(F.max_by(F.struct("k", "n", "component"), F.struct("k", "component")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    need = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_HASHES))
    few, many = need(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")), need(F.col("top.k"), F.col("top.n"))
    top = top.select("bucket", F.col("top.component").alias("largest"), few.alias("few"), many.alias("many"), (need(F.col("k"), F.col("n")) == 1).alias("single"))
    rows = places.join(top, "bucket")
    mark, inside = F.xxhash64("node"), F.col("component") == F.col("largest")
    own = F.when(F.col("single"), 0).when(inside, F.col("few") + F.pmod(mark, "many")).otherwise(F.pmod(mark, "few"))
    last = F.when(F.col("single"), 0).when(inside, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    rows = rows.select("bucket", "node", "n", "component", "brief", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other"))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component", "brief")


def _searched(rows: DataFrame, percent: int, schema: str, full: bool) -> DataFrame:
    """Blocks, searched for pairs of different components: by size and by signature; with `full` on the sets too.

    Without `full` the rows that have a partner come back; with it pairs of components (a, b), each once at most: what has
    been joined counts as one component from there on.
    """
    least = _least(percent)

    def within(table: pa.Table):
        node, n, component, own = (table.column(c).to_numpy().copy() for c in ("node", "n", "component", "own"))
        mark = _marks(table.column("brief"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()] if full else None
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        known, found, keep = component.copy(), [], np.zeros(len(node), bool)
        for x in left:
            y = right[(component[right] != component[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[node[y] > node[x]] if i == j else y
            y = y[(mark[y] == mark[x]).mean(1) >= least] if len(y) else y
            if not full:
                keep[y] = True
                keep[x] |= len(y) > 0
                continue
            for k in y:
                if component[k] != component[x]:
                    both = _shared(sets[x], sets[k])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[k]) - both):
                        found.append((known[x], known[k]))
                        component[component == component[k]] = component[x]
        if not full:
            return table.filter(pa.array(keep))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    def search(batches):
        for table in whole_groups(batches, ["bucket", "i", "j"]):
            yield from within(table).to_batches()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(search, schema)


def _mixed(places: DataFrame, joined: DataFrame) -> DataFrame:
    """Places (bucket, node, n) with the node's component, in buckets that hold more than one."""
    placed = places.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    return stored(placed.join(several, "bucket"), "mixed")


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id (long), n_shingles (set size), component_id (smallest id reachable), kept (id = component_id), a row a document.

    Words are runs of other than white space with A-Z lower-cased. Null texts, and texts without words, have an empty
    set and are linked with nothing. Rows that repeat an id count as one document, and each is returned. Rows with a null
    id take no part: their component_id is null and they are kept. Other columns are ignored.
    """
    signed = stored(_signed(documents, id, text, words), "signed")
    part = signed.where("n > 0 AND id IS NOT NULL")
    nodes = part.groupBy("key").agg(F.min("id").alias("node"))
    reps = part.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    members = reps.select(F.explode("bands").alias("bucket"), F.col("id").alias("node"), "n")
    order = F.when(F.pmod(F.xxhash64("bucket"), F.lit(4)) == 0, F.xxhash64("bucket", "node")).otherwise(F.col("node"))
    centre = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centre = centre.select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    fits = F.expr(f"100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)")
    grouped = stored(members.join(centre, "bucket").select("bucket", "node", "n", "centre", "centre_n"), "buckets")
    texts = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # Sets of the nodes that meet others, worked out once.
    met = grouped.select(F.col("node").alias("id")).distinct()
    sets = stored(_sets(perhaps(texts, "id", met).where("perhaps").join(met, "id", "left_semi").select("id", "text"), words), "sets")
    briefs = reps.select(F.col("id").alias("node"), "brief")
    # Against the smallest node of each bucket and, in one bucket of four, another one, so that a node meets several.
    pairs = grouped.where("node <> centre").where(fits).select("node", "centre", "n").distinct()
    star = stored(_agreeing(pairs, briefs, percent), "star")
    links = stored(_confirmed(star, sets, percent), "links")

    joined = components(links)
    mixed = _mixed(grouped.select("bucket", "node", "n"), joined)
    block = "bucket long, i int, j int, own int, node long, n long, component long, brief binary"
    close = _searched(_blocks(mixed.join(briefs, "node")), percent, block, full=False)
    more = stored(_searched(close.join(sets, "node"), percent, "a long, b long", full=True).distinct(), "links")

    # Components of components, then of nodes; equal sets are one node, so a document's component is that of its node.
    above = components(more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    of = joined.select("node", F.col("component").alias("part"))
    part = F.coalesce("part", "node").alias("part")
    labels = nodes.join(of, "node", "left").select("key", part).join(above, "part", "left").select("key", F.coalesce("whole", "part").alias("component_id"))
    drop(grouped, sets, star, links, mixed, more)
    out = signed.select("id", "n", "key").join(labels, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
