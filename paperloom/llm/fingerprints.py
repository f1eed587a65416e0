"""Document fingerprints as threshold-scaled sketches, with SQL functions only.

A fingerprint keeps every hash of a text's distinct five-word shingles that is below a fixed share of the hash range.
Sketches of unlike sizes stay comparable, and the sketch of a union is the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One shingle hash in so many is kept.
SCALED = 8
#: Rows of a range of ids within which the next document is found, and ranges at most: a bound of what the driver is sent.
RANGE_ROWS, MOST_RANGES = 2_000, 20_000


def sketch(text: Column, words: int = WORDS, scaled: int = SCALED) -> Column:
    """Sorted distinct shingle hashes below 1/`scaled` of the 64-bit range, an array of longs.

    Words are runs of other than white space. A text with fewer words has its whole word sequence as one shingle. If no
    hash is below the threshold the smallest is kept, so that any text with words has a sketch; without words it is empty.
    """
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
        return F.when(n >= words, full).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    # A one-element transform names an intermediate value, which is then computed once.
    return F.get(F.transform(F.array(tokens), lambda w: F.get(F.transform(F.array(hashes(w)), lambda h: _below(h, scaled)), F.lit(0))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; 1 for two empty ones."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(shared / (total - shared))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column, scaled: int = SCALED) -> Column:
    """The sketch of the union, from an array of sketches.

    A hash above the threshold, which stands for a text that has none below, goes where any other is below; the smallest
    of such hashes stays where none is, as it would in a sketch of the whole.
    """
    all = F.array_sort(F.array_distinct(F.flatten(sketches)))
    return F.get(F.transform(F.array(all), lambda h: _below(h, scaled)), F.lit(0))


def _below(h: Column, scaled: int) -> Column:
    """The hashes below the threshold, sorted and distinct, or the smallest if none is."""
    low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(-(1 << 63) + (1 << 64) // scaled))))
    return F.when((F.size(low) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(low)


def rendered(sketch: Column) -> Column:
    """The sketch as one string: its hashes in hexadecimal, ascending as signed numbers."""
    return F.array_join(F.transform(sketch, F.hex), ",")


def with_next(df: DataFrame, order: str, text: str, derived: dict[str, Column]) -> DataFrame:
    """`order` (a whole number), `text` and `derived` of each row, and the latter two as next_<name> of the row that follows
    in ascending `order` (null first, ties by text); the first row follows the last. Other columns are ignored, whatever
    their names; an empty table has no rows.

    Rows are dealt to ranges of ids, each sorted on its own. Bounds are ids that occur, so the row that begins a range is
    known by its id and goes to the range before it too: one scan of the ids, one of the texts, one shuffle.
    """
    df = df.select(F.col(order).cast("long").alias("__id"), F.col(text).alias("__text"))
    rows, known, least = df.agg(F.count(F.lit(1)), F.count("__id"), F.min("__id")).first()
    ranges = min(MOST_RANGES, max(1, -(-known // RANGE_ROWS)))
    share = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx("__id", share, max(10_000, 10 * ranges)).alias("b")).first()["b"])) if share else []
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    id = F.col("__id")
    # How many bounds are not above the id, by binary search.
    steps = [F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]
    below = lambda n, step: F.coalesce(F.get(table, n + step - 1) <= id, F.lit(False))
    place = F.aggregate(F.array(*steps), F.lit(0), lambda n, step: n + F.when(below(n, step), step).otherwise(0)) if bounds else F.lit(0)
    df = df.withColumn("__place", place)
    begins = F.coalesce(F.get(table, F.col("__place") - 1) == id, F.lit(False)) if bounds else F.lit(False)
    first = id.isNull() if known < rows else id == F.lit(least)
    goes = lambda part, late, own: F.array(F.struct(part.cast("int").alias("part"), F.lit(late).alias("late"), F.lit(own).alias("own")))
    none = F.slice(goes(F.lit(0), 0, True), 1, 0)
    to = F.concat(goes(F.col("__place"), 0, True), F.when(begins, goes(F.col("__place") - 1, 0, False)).otherwise(none), F.when(first, goes(F.lit(len(bounds)), 1, False)).otherwise(none))
    made = {n: c for n, c in derived.items()}
    named = df.select("__id", F.col("__text").alias(text), to.alias("__to")).withColumns(made)
    dealt = named.select("*", F.explode("__to").alias("__goes")).select("__id", text, *made, "__goes.*")
    window = Window.partitionBy("part").orderBy("late", F.col("__id").asc_nulls_first(), text)
    following = dealt.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in (text, *made)))
    return following.where("own").select(F.col("__id").alias(order), text, *made, *(f"next_{c}" for c in (text, *made)))
