"""Record linkage: candidate pairs by blocking, matching, merging and its measures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.session import checkpointed, dropped


#: Initials of a name up to which each set of them is a key.
MASKED = 5


def _across() -> Column:
    """Whether one name of a pair is on the first side (bit 1 of `side`) and the other on the second (bit 2)."""
    x, y = F.col("side_a"), F.col("side_b")
    return (x.bitwiseAND(1) * y.bitwiseAND(2) + x.bitwiseAND(2) * y.bitwiseAND(1)) > 0


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], sides: bool, fits: Column) -> DataFrame:
    """Pairs a < b of names (name, key) that have a key in common, one from `left` and one from `right`, and that `fits`
    (a condition on p, from `left`, and q). Keys are hashes: names that meet by chance are put right by `fits`."""
    own = ["side"] * sides
    side = lambda df, n: df.select(F.col("name").alias(n), "key", *keys, *(F.col(c).alias(f"side_{n}") for c in own))
    pairs = side(left, "p").join(side(right, "q"), ["key", *keys]).where((F.col("p") != F.col("q")) & fits)
    first = F.col("p") < F.col("q")
    turned = (F.when(first, F.col(f"side_{x}")).otherwise(F.col(f"side_{y}")).alias(n) for x, y, n in (("p", "q", "side_a"), ("q", "p", "side_b")) if sides)
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *keys, *turned)
    return (pairs.where(_across()) if sides else pairs).distinct()


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def name_pairs(names: DataFrame, kind: str | None = None, sides: bool = False, nicknames: Column | None = None) -> DataFrame:
    """Pairs a < b of distinct normalized names (column name) that meet on a rung of the ladder before the last: all words
    of one in the other in order, initials, or one edit in one word.

    With `sides` (column side) only pairs across the sides are made, with side_a and side_b. With `nicknames` words also
    meet as the full names that they are short for. Each rung has keys of its own, so that few other pairs meet on them:

    - words: the rarest word of the shorter name, which the longer one has among its words;
    - initials: an abbreviated name meets names of its initials that have one of its full words at the same place, or
      initials at all places where it has full words;
    - an edit: all words but one with the place of that one, and the word itself or without one of its letters, of which two
      words that are one edit apart have one in common.
    """
    keys, own = [kind] if kind else [], ["side"] * sides
    w, p, q = N.words(F.col("name")), F.col("p"), F.col("q")
    rows = names.where("name <> ''").select("name", *keys, *own).distinct().withColumn("w", w)
    every = lambda x: F.array(x) if nicknames is None else F.array_distinct(F.concat(F.array(x), F.coalesce(F.try_element_at(nicknames, x), F.array().cast("array<string>"))))

    # Words. A word is as frequent as all that it stands for.
    word = rows.select("name", "w", *keys, *own, F.explode(F.array_distinct("w")).alias("word"))
    word = word.withColumn("stands", F.explode(every(F.col("word"))))
    df = word.groupBy("stands", *keys).agg(F.count(F.lit(1)).alias("df"))
    cost = word.join(df, ["stands", *keys]).groupBy("name", *keys, *own, "word").agg(F.sum("df").alias("cost"), F.collect_set("stands").alias("all"))
    rarest = cost.groupBy("name", *keys, *own).agg(F.min_by("all", F.struct("cost", "word")).alias("all")).select("name", *keys, *own, F.explode("all").alias("stands"))
    has = word.select("name", *keys, *own, _key("stands").alias("key"))
    shorter = (F.size(N.words(p)) < F.size(N.words(q))) & N.is_subsequence(p, q, nicknames)
    same_size = F.lit(False) if nicknames is None else (F.size(N.words(p)) == F.size(N.words(q))) & N.is_subsequence(p, q, nicknames)
    found = _meeting(rarest.select("name", *keys, *own, _key("stands").alias("key")), has, keys, sides, shorter | same_size)

    # Initials.
    letters = F.array_join(F.transform("w", lambda x: F.substring(x, F.lit(1), F.lit(1))), "")
    many = rows.where("size(w) >= 2").withColumn("letters", letters).withColumn("short", F.filter(F.transform("w", lambda x, i: F.when(F.length(x) == 1, i)), lambda i: i.isNotNull()))
    where = lambda: F.array_join(F.transform("w", lambda x: F.when(F.length(x) == 1, "1").otherwise("0")), "")
    sign = F.col("letters") if nicknames is None else F.size("w").cast("string")
    full = F.flatten(F.filter(F.transform("w", lambda x, i: F.when(F.length(x) > 1, F.transform(every(x), lambda y: _key(F.lit("at"), sign, i, y)))), lambda k: k.isNotNull()))
    # Places of full words, as bits: a name of no more than MASKED initials has a key for each set of its initials.
    bits = lambda wanted: F.aggregate(F.transform("w", lambda x, i: F.when((F.length(x) == 1) == wanted, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), i).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    own_mask = _key(F.lit("mask"), F.col("letters"), bits(False))
    sets = F.aggregate("short", F.array(F.lit(0).cast("long")), lambda out, i: F.concat(out, F.transform(out, lambda m: m + F.pow(F.lit(2), i).cast("long"))))
    met = F.when(F.size("short") <= MASKED, F.transform(sets, lambda m: _key(F.lit("mask"), F.col("letters"), m))).otherwise(F.array(_key(F.lit("any"), F.col("letters"))))
    rest = ["name", *keys, *own]
    abbreviated = many.where("size(short) > 0").select(*rest, F.explode(F.array_distinct(F.concat(full, F.array(own_mask, _key(F.lit("any"), F.col("letters")))))).alias("key"))
    others = many.select(*rest, F.explode(F.array_distinct(F.concat(full, met))).alias("key"))
    found = found.union(_meeting(abbreviated, others, keys, sides, N.initials_match(p, q, nicknames)))

    # One edit.
    edits = F.flatten(F.transform("w", lambda x, i: F.transform(F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda j: F.concat(F.substring(x, F.lit(1), j - 1), F.substring(x, j + 1, F.length(x))))), lambda v: _key(F.lit("edit"), i, F.array_join(F.slice(F.col("w"), F.lit(1), i), " "), F.array_join(F.slice(F.col("w"), i + 2, F.size("w")), " "), v))))
    edited = many.select(*rest, F.explode(F.array_distinct(edits)).alias("key"))
    return found.union(_meeting(edited, edited, keys, sides, (p < q) & N.is_typo(p, q))).distinct()


def _combinations(items: Column, k: int) -> Column:
    """All choices of k items of an array, in order."""
    if k == 1:
        return F.transform(items, lambda x: F.array(x))
    return F.flatten(F.transform(items, lambda x, i: F.transform(_combinations(F.slice(items, i + 2, F.size(items)), k - 1), lambda c: F.concat(F.array(x), c))))


def _sharing(names: DataFrame, keys: list[str], tokens: Column, share: float, together: int, sides: bool = False) -> DataFrame:
    """Pairs a < b of names (x and y: their tokens) that can have `share` of the tokens of each in common, at least
    `together` in number; with no loss.

    Two such names have `together` tokens in common among the rarest of each, all but `share` of its own and `together`
    more; a pair is made at the first of these only.
    """
    own = ["side"] * sides
    t = names.select("name", *keys, *own).distinct().withColumn("token", F.explode(tokens))
    t = t.join(t.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    sets = t.groupBy("name", *keys, *own).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda s: s["token"]).alias("tokens"))
    n = F.size("tokens")
    head = F.slice("tokens", F.lit(1), (n - F.ceil(n * share - 1e-9) + together).cast("int"))
    rows = sets.withColumn("head", head).withColumn("key", F.explode(_combinations(F.col("head"), together)))
    side = lambda name, t, head: rows.select(F.col("name").alias(name), F.col("tokens").alias(t), F.col("head").alias(head), "key", *keys, *(F.col(c).alias(f"side_{name}") for c in own))
    first = F.slice(F.array_intersect("p", "q"), 1, together) == F.col("key")
    pairs = side("a", "x", "p").join(side("b", "y", "q"), ["key", *keys]).where((F.col("a") < F.col("b")) & first)
    return (pairs.where(_across()) if sides else pairs).select("a", "b", "x", "y", *keys, *(f"side_{n}" for n in ("a", "b") if sides))


def alike_pairs(names: DataFrame, least: float, kind: str | None = None) -> DataFrame:
    """All pairs a < b of distinct names with a Dice coefficient of their trigrams of `least` and more."""
    keys = [kind] if kind else []
    pairs = _sharing(names, keys, T.trigrams(F.col("name")), least / (2 - least), 1)
    x, y = F.size("x"), F.size("y")
    return pairs.where(2.0 * F.size(F.array_intersect("x", "y")) / (x + y) >= least).select("a", "b", *keys)


def _bags(rows: DataFrame, keys: list[str], both: float, prefix: int) -> DataFrame:
    """Pairs a < b of words (name) with m letters in common, m / |a| + m / |b| >= `both`, and `prefix` equal letters at the
    beginning; none is lost.

    Lengths say how many letters two words must share, m, so t <= m of them are among the rarest |a| - m + t of each: a word
    has a key for each length of the other and each choice of t, which is 4, or less for long words, so that keys grow with
    the square of the length at most.
    """
    letters = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)))
    # Each letter with how often it came before, so that sets count as bags.
    bag = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c)).cast("string")))
    t = rows.select("name", *keys, F.explode(bag).alias("token"))
    t = t.join(t.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    sets = t.groupBy("name", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda s: s["token"]).alias("bag"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = [], []
            for i, (name, letters) in enumerate(zip(batch.column("name").to_pylist(), batch.column("bag").to_pylist(), strict=True)):
                size = len(letters)
                for other in range(max(1, math.ceil(size * (both - 1) - 1e-9)), math.floor(size / (both - 1) + 1e-9) + 1):
                    m = math.ceil(both * size * other / (size + other) - 1e-9)
                    if m <= min(size, other):
                        t = min(m, 4 if max(size, other) <= 12 else 2 if max(size, other) <= 24 else 1)
                        mark = f"{name[:prefix]}|{min(size, other)},{max(size, other)}|"
                        made = [mark + " ".join(sorted(c)) for c in itertools.combinations(letters[: size - m + t], t)]
                        row += [i] * len(made)
                        key += made
                if len(row) >= 1 << 16:
                    yield batch.take(pa.array(row)).append_column("key", pa.array(key, pa.string()))
                    row, key = [], []
            yield batch.take(pa.array(row, pa.int64())).append_column("key", pa.array(key, pa.string()))

    keyed = sets.select("name", "bag", *keys).mapInArrow(keyed, sets.select("name", "bag", *keys).schema.add("key", "string"))
    side = lambda n, x: keyed.select(F.col("name").alias(n), F.col("bag").alias(x), "key", *keys)
    pairs = side("a", "x").join(side("b", "y"), ["key", *keys]).where("a < b")
    enough = F.size(F.array_intersect("x", "y")) * (1 / F.size("x") + 1 / F.size("y")) >= both - 1e-9
    return pairs.where(enough).select("a", "b", *keys).distinct()


def near_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """word and near: pairs of distinct words (column word) with a Jaro-Winkler likeness of DISTINGUISHING, both ways round.

    With p letters of prefix their Jaro likeness j has DISTINGUISHING <= j + p (1 - j) / 10, and m common letters have
    m / |a| + m / |b| >= 3 j - 1. With three letters of prefix and more such words share a key by these; with two or fewer
    they must have most letters in common (`_bags`), the more the less of a prefix they share.
    """
    rows = words.select(F.col("word").alias("name"), *keys).distinct()
    least = lambda p: 3 * (N.DISTINGUISHING - p / 10) / (1 - p / 10) - 1
    start = rows.where("length(name) >= 3").select("name", *keys, _key(F.substring("name", 1, 3)).alias("key"))
    p, q = F.col("p"), F.col("q")
    # The shorter of two words has m letters in common at most.
    room = 1 + F.least(F.length(p), F.length(q)) / F.greatest(F.length(p), F.length(q)) >= least(4) - 1e-9
    found = _meeting(start, start, keys, False, (p < q) & room).union(_bags(rows, keys, least(2), 2)).union(_bags(rows, keys, least(1), 0)).distinct()
    close = checkpointed(found.where(N.similarity(F.col("a"), F.col("b")) >= N.DISTINGUISHING))
    turned = lambda x, y: close.select(F.col(x).alias("word"), F.col(y).alias("near"), *keys)
    return turned("a", "b").union(turned("b", "a"))


def similar_pairs(names: DataFrame, kind: str | None = None, sides: bool = False) -> DataFrame:
    """Pairs a < b of distinct names that can be alike by SIMILAR and, in what they don't share, by DISTINGUISHING.

    Such names have equally many words of two letters and more, and each is a word of the other name or near one
    (`near_words`, worked out on distinct words). So the two rarest words of one name, or words near them, are two words of
    the other: a name has a key for each such pair of its two rarest, and one for each two of its own words.
    """
    keys, own = [kind] if kind else [], ["side"] * sides
    rows = names.where("name <> ''").select("name", *keys, *own).distinct().withColumn("w", F.filter(N.words(F.col("name")), lambda x: F.length(x) > 1))
    word = rows.select("name", *keys, *own, F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    df = word.groupBy("word", *keys).agg(F.count(F.lit(1)).alias("df"))
    near = near_words(df.select("word", *keys), keys).union(df.select("word", F.col("word").alias("near"), *keys))
    cost = near.join(df.withColumnRenamed("word", "near"), ["near", *keys]).groupBy("word", *keys).agg(F.sum("df").alias("cost"), F.array_sort(F.collect_set("near")).alias("all"))
    priced = word.join(cost, ["word", *keys]).groupBy("name", *keys, *own, "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "i", "all"))), 1, 2).alias("two"))
    both = lambda x, y: _key(F.lit("two"), F.col("n"), F.least(x, y), F.greatest(x, y))
    first, second = F.get("two", F.lit(0))["all"], F.get("two", F.lit(1))["all"]
    asks = F.when(F.col("n") == 1, F.transform(first, lambda x: _key(F.lit("one"), x))).otherwise(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: both(x, y)))))
    rest = ["name", *keys, *own]
    has = rows.withColumn("n", F.size("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice(F.col("w"), i + 2, F.size("w")), lambda y: both(x, y))))
    has = has.where("n > 0").select(*rest, F.explode(F.array_distinct(F.when(F.col("n") == 1, F.transform("w", lambda x: _key(F.lit("one"), x))).otherwise(pairs))).alias("key"))
    # Names of single letters only: what is left of two that are alike is nothing, so they share most letters.
    single = rows.where("size(w) = 0").select(*rest, F.explode(F.array_distinct(N.words(F.col("name")))).alias("word")).select(*rest, _key(F.lit("letter"), "word").alias("key"))
    p, q = F.col("p"), F.col("q")
    shorter, longer = F.least(F.length(p), F.length(q)), F.greatest(F.length(p), F.length(q))
    # m <= the shorter length; with four letters of prefix the least sum of shares.
    room = 1 + shorter / longer >= 3 * (N.SIMILAR - 0.4) / 0.6 - 1 - 1e-9
    found = _meeting(priced.select(*rest, F.explode(F.array_distinct(asks)).alias("key")), has, keys, sides, room)
    return found.union(_meeting(single, single, keys, sides, room & (p < q))).distinct()


def ladder_pairs(names: DataFrame, kind: str | None = None, sides: bool = False, nicknames: Column | None = None) -> DataFrame:
    """Pairs a < b of distinct names that can meet on a rung of the ladder: those of `name_pairs`, and for the last rung
    those of `similar_pairs`."""
    found = name_pairs(names, kind, sides, nicknames)
    return found.union(similar_pairs(names, kind, sides).select(*found.columns)).distinct()


def merge_pairs(names: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs a < b of distinct names that `same_thing` can find to be one: those of `name_pairs`, and all alike by MERGE."""
    return name_pairs(names, kind).union(alike_pairs(names, N.MERGE, kind)).distinct()


def matched(pairs: DataFrame, nicknames: Column | None = None) -> DataFrame:
    """match: the match_kind of each pair that has one; likeness is worked out only for pairs that no cheaper rung takes."""
    cheap = N.match_kind(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), nicknames)
    barred = N.generations_differ(F.col("a"), F.col("b")) | N.numbers_contradict(F.col("a"), F.col("b")) | ((F.size(N.words(F.col("a"))) == 1) != (F.size(N.words(F.col("b"))) == 1))
    columns = pairs.columns
    # Written once: filters on the rung would work it out again for each test.
    pairs = checkpointed(pairs.withColumn("match", cheap).withColumn("barred", F.coalesce(barred, F.lit(False))))
    near = (N.similarity(F.col("a"), F.col("b")) >= N.SIMILAR) & (N.distinguishing_similarity(F.col("a"), F.col("b")) >= N.DISTINGUISHING)
    rest = pairs.where("match IS NULL AND NOT barred").withColumn("match", F.when(near, "similar"))
    return pairs.where("match IS NOT NULL").select(*columns, "match").union(rest.where("match IS NOT NULL").select(*columns, "match"))


def same_thing(pairs: DataFrame) -> DataFrame:
    """Why two names of one kind are one thing: a short form, or alike by trigrams."""
    longer = F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b"))
    shorter = F.when(F.length("a") >= F.length("b"), F.col("b")).otherwise(F.col("a"))
    score = T.trigram_dice(longer, shorter)
    why = F.when(N.short_form(longer, shorter), "short form").when(score >= N.MERGE, "alike")
    return pairs.select(longer.alias("longer"), shorter.alias("shorter"), why.alias("why"), *(c for c in pairs.columns if c not in ("a", "b"))).where("why IS NOT NULL")


def merged(names: DataFrame, same: DataFrame, kind: str | None = None) -> DataFrame:
    """Each name with its `keeper`: names in order of length (longest first, ties alphabetical) absorb all later ones that
    are the same thing (longer, shorter) and that no name before has absorbed; a name that was absorbed absorbs nothing.
    With `kind`, names of each kind by themselves. Repeated names are one; null names keep none and have none.

    Decided in rounds, each a join: a name is absorbed once the first of its neighbours before it that may still absorb is
    a keeper, and keeps its place once none is left. Rounds are as many as the longest chain of such decisions.
    """
    keys = [kind] if kind else []
    order = lambda c: F.struct((-F.length(c)).alias("n"), c.alias("name"))
    x, y = F.col("longer"), F.col("shorter")
    edges = same.select(F.least(order(x), order(y)).alias("before"), F.greatest(order(x), order(y)).alias("after"), *keys)
    edges = checkpointed(edges.select(F.col("before.name").alias("before"), F.col("after.name").alias("after"), *keys).distinct())
    state = checkpointed(names.where("name IS NOT NULL").select("name", *keys, F.lit(None).cast("string").alias("keeper")).distinct())
    while state.where("keeper IS NULL").limit(1).count():
        known = state.select(F.col("name").alias("before"), F.col("keeper").alias("of"), *keys)
        # Neighbours that were absorbed no longer count.
        rest = edges.join(known, ["before", *keys]).where("of IS NULL OR of = before")
        first = rest.groupBy(F.col("after").alias("name"), *keys).agg(F.min_by(F.struct("before", "of"), order(F.col("before"))).alias("first"))
        new = F.when(F.col("first").isNull(), F.col("name")).otherwise(F.col("first.of"))
        after = checkpointed(state.join(first, ["name", *keys], "left").select("name", *keys, F.coalesce("keeper", new).alias("keeper")))
        dropped(state)
        state = after
    return state


def salient(proposed: DataFrame, most: int = 15) -> DataFrame:
    """Proposed entities (document_id, name, confidence, mentions) with their place in the document; `most` are admitted."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("confidence"), F.desc("mentions"), "name"))
    return proposed.withColumn("place", place).withColumn("admitted", F.col("place") <= most)


def compatible(mentions: DataFrame, entities: DataFrame, nicknames: Column | None = None) -> DataFrame:
    """(name, kind, entity_id, match, decides): names of mentions and the entities of their kind that they could mean.

    `decides` says whether the likeness may decide alone if it is the only one: all words in order unless middle initials
    disagree; initials against a name that is spelled out; the weaker likenesses only among POPULATION names of the kind
    and where RARE of them at most have the mention's last word. One word of a longer name never decides, and counts for
    persons only.
    """
    side = lambda df, n: df.select("name", "kind", F.lit(n).alias("side"))
    names = side(mentions, 1).union(side(entities, 2)).where("name <> ''").groupBy("name", "kind").agg(F.bit_or("side").alias("side"))
    pairs = matched(ladder_pairs(names, "kind", sides=True, nicknames=nicknames), nicknames)
    turned = lambda x, y: pairs.where(F.col(f"side_{x}").bitwiseAND(1).cast("boolean") & F.col(f"side_{y}").bitwiseAND(2).cast("boolean")).select(F.col(x).alias("name"), F.col(y).alias("full"), "kind", "match")
    fits = turned("a", "b").union(turned("b", "a")).where("match <> 'surname' OR kind = 'person'")
    last = F.try_element_at(N.words(F.col("name")), F.lit(-1))
    population = entities.groupBy("kind").agg(F.count(F.lit(1)).alias("population"))
    sharing = entities.where("name <> ''").groupBy("kind", last.alias("surname")).agg(F.count(F.lit(1)).alias("sharing"))
    rows = fits.join(entities.select("entity_id", F.col("name").alias("full"), "kind"), ["full", "kind"]).join(population, "kind")
    rows = rows.withColumn("surname", last).join(sharing, ["kind", "surname"], "left")
    weak = (F.col("population") >= N.POPULATION) & (F.coalesce("sharing", F.lit(0)) <= N.RARE)
    match = F.col("match")
    decides = F.when(match == "subsequence", ~N.initials_disagree(F.col("name"), F.col("full"))).when(match == "initials", ~N.is_abbreviated(F.col("full"))).otherwise((match != "surname") & weak)
    return rows.select("name", "kind", "entity_id", "match", decides.alias("decides"))


def resolved(mentions: DataFrame, entities: DataFrame, identifiers: tuple[DataFrame, DataFrame] | None = None, context: DataFrame | None = None, nicknames: Column | None = None) -> DataFrame:
    """Each mention (mention_id, document_id, name, kind) with the entity (entity_id, name, kind) that it means, and how it
    was told: exact, identifier, context or unambiguous; null where it can't be.

    In order: the entity of the same name, whatever its kind; the only entity of the kind that owns an identifier of the
    document (`identifiers`: owned ones as (entity_id, identifier), seen ones as (document_id, identifier)); the only
    compatible one that is known to appear with others that the document names (`context`: entity_id, other_id); the only
    compatible one that decides. What a first pass finds is what a document names in a second one. Null and empty names are
    not resolved; equal names of several entities mean the one with the smallest id.
    """
    named = mentions.where("name <> ''")
    exact = named.join(entities.groupBy("name").agg(F.min("entity_id").alias("entity_id")), "name").select("mention_id", "document_id", "entity_id", F.lit("exact").alias("resolved_by"))
    rest = checkpointed(named.join(exact.select("mention_id"), "mention_id", "left_anti").select("mention_id", "document_id", "name", "kind"))
    only = lambda df, keys: df.groupBy(*keys).agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last")).where("entity_id = last").drop("last")
    how = lambda df, word: df.select("mention_id", "document_id", "entity_id", F.lit(word).alias("resolved_by"))
    found = exact
    if identifiers is not None:
        owned, seen = identifiers
        of = seen.distinct().join(owned.distinct(), "identifier").join(entities.select("entity_id", "kind"), "entity_id").select("document_id", "kind", "entity_id")
        found = found.union(how(rest.join(only(of, ["document_id", "kind"]), ["document_id", "kind"]), "identifier"))
    found = checkpointed(found)
    rest = rest.join(found.select("mention_id"), "mention_id", "left_anti")
    fits = checkpointed(rest.join(compatible(rest, entities, nicknames), ["name", "kind"]))
    alone = how(only(fits.where("decides"), ["mention_id", "document_id"]), "unambiguous")
    first = found.union(alone)
    if context is not None:
        # Pass two: what pass one left open, against what it found in the same document.
        beside = first.select("document_id", F.col("entity_id").alias("other_id")).distinct()
        open = fits.join(first.select("mention_id"), "mention_id", "left_anti")
        known = open.join(context.select("entity_id", "other_id").distinct(), "entity_id").join(beside, ["document_id", "other_id"], "left_semi")
        first = first.union(how(only(known, ["mention_id", "document_id"]), "context"))
    return mentions.select("mention_id").join(first.select("mention_id", "entity_id", "resolved_by"), "mention_id", "left")


def surname_frequency(names: DataFrame) -> DataFrame:
    """Each name with the number of names that end with its last word."""
    last = names.withColumn("surname", F.try_element_at(N.words(F.col("name")), F.lit(-1)))
    return last.join(last.groupBy("surname").agg(F.count(F.lit(1)).alias("sharing")), "surname").select("name", "surname", "sharing")


def aliases(spellings: DataFrame) -> DataFrame:
    """entity_id and its spellings, one for each normalized form: that seen first."""
    first = spellings.groupBy("entity_id", "normalized").agg(F.min_by("spelling", F.struct("seen", "spelling")).alias("spelling"))
    return first.groupBy("entity_id").agg(F.array_sort(F.collect_list("spelling")).alias("aliases"))


def conflicts(fields: DataFrame) -> DataFrame:
    """Fields (entity_id, field, value, day, record_id) with different values, and those of the oldest and newest record."""
    value = T.comparable(F.col("value"))
    by = fields.withColumn("canonical", value).groupBy("entity_id", "field")
    order = F.struct("day", "record_id")
    ends = by.agg(F.count_distinct("canonical").alias("values"), F.min_by("value", order).alias("oldest"), F.max_by("value", order).alias("newest"), F.min_by("record_id", order).alias("oldest_record"), F.max_by("record_id", order).alias("newest_record"))
    return ends.where((F.col("values") > 1) & (T.comparable(F.col("oldest")) != T.comparable(F.col("newest"))))


def measures(judged: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicted against actual (booleans)."""
    n = lambda c: F.sum(c.cast("int"))
    p, a = F.col("predicted"), F.col("actual")
    t = judged.agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return t.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / (precision + recall), 6).alias("f1"))
