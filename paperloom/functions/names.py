"""Name functions: normal forms, and how two names may be the same."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms at the end of a name, in the order in which they are tried.
COMPANY_ENDINGS = (" inc", " inc.", " llc", " l.l.c.", " ltd", " ltd.", " co", " co.", " corp", " corp.", " corporation", " company", " gmbh", " plc")
#: Legal forms that follow a comma.
LEGAL_FORMS = "inc llc l.l.c ltd co corp corporation company gmbh plc sa nv bv ag pty llp lp pc pllc".split()
#: Forms of address.
TITLES = """
mr mrs ms miss mstr master dr prof professor
rev reverend fr sir dame lady lord hon honourable
capt captain col colonel major gen general lt sgt
mlle mme don dona jonkheer countess
""".split()
#: Beginnings that too many names share.
COMMON_BEGINNINGS = "the a an and for new old one two st dr mr ms mrs san los las north south east west".split()
#: Generation marks.
GENERATIONS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx jr sr junior senior 2nd 3rd 4th 5th".split()
SIMILAR, DISTINGUISHING, MERGE = 0.92, 0.82, 0.90
#: A weak likeness decides only among so many names of the kind at least, and where so many at most share the last word.
POPULATION, RARE = 12, 3


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.regexp_replace(F.translate(F.lower(text), *_plain_letters()), r"\p{M}", "")


def normalized(name: Column) -> Column:
    text = folded(name)
    for ending in COMPANY_ENDINGS:
        text = F.regexp_replace(text, re.escape(ending) + r"\z", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\s+|\s+$", "")


def person_form(name: Column) -> Column:
    """Given names before the surname, without titles and without what stands in brackets."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = strip(F.regexp_replace(name, r"(?s)\(.*$", ""))
    parts = F.split(text, ",")
    head, tail = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    turned = (F.size(parts) == 2) & ~head.rlike(r"[\s\d]") & (tail != "") & ~F.regexp_replace(F.lower(tail), r"^[. ]+|[. ]+$", "").isin(LEGAL_FORMS)
    text = F.when(turned, F.concat_ws(" ", tail, head)).otherwise(text)
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "")
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (bare(w) != "") & ~bare(w).isin(TITLES)), " ")


def words(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w != "")


def digit_runs(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))


def numbers_contradict(a: Column, b: Column) -> Column:
    """Whether the digit runs of two names differ at a place that both have."""
    x, y = digit_runs(a), digit_runs(b)
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, F.lit(1), n) != F.slice(y, F.lit(1), n)


def generation(name: Column) -> Column:
    w = words(name)
    last = F.element_at(w, -1)
    return F.when((F.size(w) >= 2) & last.isin(GENERATIONS), last)


def generations_differ(a: Column, b: Column) -> Column:
    return F.coalesce(generation(a) != generation(b), F.lit(False))


def middle_initials(name: Column) -> Column:
    w = words(name)
    middle = F.when(F.size(w) > 2, F.slice(w, F.lit(2), F.size(w) - 2)).otherwise(F.array().cast("array<string>"))
    return F.filter(middle, lambda x: F.length(x) == 1)


def initials_disagree(a: Column, b: Column) -> Column:
    x, y = middle_initials(a), middle_initials(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def equivalent(x: Column, y: Column, nicknames: Column | None) -> Column:
    """Whether two words are equal or one is a short form of the other, by a map from short forms to arrays of full names."""
    if nicknames is None:
        return x == y
    stands = lambda short, full: F.coalesce(F.array_contains(F.try_element_at(nicknames, short), full), F.lit(False))
    return (x == y) | stands(x, y) | stands(y, x)


def is_subsequence(shorter: Column, longer: Column, nicknames: Column | None = None) -> Column:
    """Whether all words of the shorter name, or what they are short for, occur in the longer one, in order."""
    s = words(shorter)
    found = F.aggregate(words(longer), F.lit(0), lambda i, w: i + F.when(F.coalesce(equivalent(F.get(s, i), w, nicknames), F.lit(False)), 1).otherwise(0))
    return found == F.size(s)


def initials_match(a: Column, b: Column, nicknames: Column | None = None) -> Column:
    """Equal word counts of two at least; each pair is equivalent or one is the other's initial; one initial at least."""
    pairs = F.arrays_zip(words(a).alias("x"), words(b).alias("y"))
    same = lambda p: equivalent(p["x"], p["y"], nicknames)
    initial = lambda p: ~same(p) & (((F.length(p["x"]) == 1) & p["y"].startswith(p["x"])) | ((F.length(p["y"]) == 1) & p["x"].startswith(p["y"])))
    fits = F.forall(pairs, lambda p: same(p) | initial(p)) & F.exists(pairs, initial)
    return F.when((F.size(words(a)) == F.size(words(b))) & (F.size(words(a)) >= 2), fits).otherwise(F.lit(False))


def is_abbreviated(name: Column) -> Column:
    return F.exists(words(name), lambda w: F.length(w) == 1)


def is_typo(a: Column, b: Column) -> Column:
    """One word of at least two differs, by one edit, and the longer spelling has four letters at least."""
    pairs = F.filter(F.arrays_zip(words(a).alias("x"), words(b).alias("y")), lambda p: p["x"] != p["y"])
    one = F.get(pairs, F.lit(0))
    near = (F.size(pairs) == 1) & (F.greatest(F.length(one["x"]), F.length(one["y"])) >= 4) & (F.levenshtein(one["x"], one["y"], 1) == 1)
    return F.when((F.size(words(a)) == F.size(words(b))) & (F.size(words(a)) >= 2), near).otherwise(F.lit(False))


def short_form(longer: Column, shorter: Column) -> Column:
    """Whether the shorter name is the beginning of the longer one in whole words and distinctive."""
    x, y = words(longer), words(shorter)
    begins = F.slice(x, F.lit(1), F.size(y)) == y
    return (F.size(y) < F.size(x)) & (F.size(y) >= 1) & (F.length(shorter) >= 3) & ~shorter.isin(COMMON_BEGINNINGS) & begins


def jaro_winkler(a: str, b: str) -> float:
    """With the prefix bonus at every similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def distinguishing(a: str, b: str) -> float:
    """Likeness of what two names don't share: the least of a greedy best pairing of their other words."""
    x, y = a.split(), b.split()
    for w in list(x):
        if w in y:
            x.remove(w), y.remove(w)
    x, y = [w for w in x if len(w) > 1], [w for w in y if len(w) > 1]
    if not x and not y:
        return 1.0
    if len(x) != len(y):
        return 0.0
    worst = 1.0
    while x:
        score, i, j = max((jaro_winkler(p, q), -i, -j) for i, p in enumerate(x) for j, q in enumerate(y))
        worst = min(worst, score)
        x.pop(-i), y.pop(-j)
    return worst


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler likeness, for the pairs that no cheaper test has settled."""

    @F.pandas_udf("double")
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return scores(a, b)


def distinguishing_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distinguishing(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return scores(a, b)


def match_kind(a: Column, b: Column, similar: Column, distinct: Column, nicknames: Column | None = None) -> Column:
    """The first rung of the ladder on which two normalized names meet, or null.

    `similar` and `distinct` are the likenesses of the two functions above; `nicknames` is a map from short forms to arrays
    of the names that they stand for, which the caller brings.
    """
    longer = F.when(F.size(words(a)) >= F.size(words(b)), a).otherwise(b)
    shorter = F.when(F.size(words(a)) >= F.size(words(b)), b).otherwise(a)
    lone = (F.size(words(shorter)) == 1) & (F.size(words(longer)) > 1)
    return (
        F.when((a == "") | (b == ""), F.when(a == b, "subsequence"))
        .when(a == b, "subsequence")
        .when(generations_differ(a, b) | numbers_contradict(a, b), F.lit(None))
        .when(lone, F.when((F.length(shorter) >= 3) & F.array_contains(words(longer), shorter), "surname"))
        .when(is_subsequence(shorter, longer), "subsequence")
        .when(initials_match(a, b, nicknames), "initials")
        .when(F.lit(False) if nicknames is None else is_subsequence(shorter, longer, nicknames), "nickname")
        .when(is_typo(a, b), "typo")
        .when((similar >= SIMILAR) & (distinct >= DISTINGUISHING), "similar")
    )
