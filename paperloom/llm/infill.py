"""Fill-in-middle transformation by lookaround splitting.

A unit grammar cuts a text into pieces that cover it. Each grammar here is translated to the places between two characters
where a unit ends: a zero-width regular expression of the class before the place and the class behind it. Spark's `split`
by it keeps every piece. Only SQL functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"[\s\S]"
#: Unit: its grammar, matched from left to right, and the pairs of neighbouring classes between which units end.
UNITS = {
    "lines": (r"[^\n]*\n|[^\n]+", ((r"\n", ANY),)),
    "words": (r"[^ \t\n]*[ \t\n]+|[^ \t\n]+", ((r"[ \t\n]", r"[^ \t\n]"),)),
    "runs": (r"[ \t\n]+|[^ \t\n]+", ((r"[ \t\n]", r"[^ \t\n]"), (r"[^ \t\n]", r"[ \t\n]"))),
    "sentences": (r"[^.!?]*[.!?]+|[^.!?]+", ((r"[.!?]", r"[^.!?]"),)),
}
#: What stands before the prefix, the suffix and the middle. Fixed values.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundary(unit: str) -> str:
    """The zero-width expression of the places where a unit ends and another begins."""
    return "|".join(f"(?<={before})(?={behind})" for before, behind in UNITS[unit][1])


def units(text: Column, unit: str = "lines") -> Column:
    """The pieces of a text, which put together give it again; none for the empty text, which `split` would call one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of the hash of seed and key, as whole numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, output: str = "output") -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and `output`.

    Two cuts, drawn from the hash of seed and key, part the units into prefix, middle and suffix. `rate` percent of the texts
    are transformed, `spm` percent of these with the suffix first; a text that is empty or has one of MARKS stays as it is.
    A null text counts as empty and a null key as the empty string. Repeated rows are transformed alike. Equal names are
    replaced; all other columns stay.
    """
    hidden = f"cut_{uuid.uuid4().hex}"
    added = ("n", "form", "prefix_chars", "middle_chars", output)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {a.lower() for a in added}]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select("*", F.struct(t.alias("text"), units(t, unit).alias("units"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("draw")).alias(hidden))
    u, h, whole = F.col(hidden)["units"], lambda i: F.col(hidden)["draw"][i], F.col(hidden)["text"]
    n = F.size(u).cast("long")
    first, second = F.least(h(0) % (n + 1), h(1) % (n + 1)), F.greatest(h(0) % (n + 1), h(1) % (n + 1))
    part = lambda lo, hi: F.array_join(F.slice(u, (lo + 1).cast("int"), (hi - lo).cast("int")), "")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(whole, F.lit(m))
    plain = (whole == "") | marked | (h(2) % 100 >= rate)
    form = F.when(plain, PLAIN).when(h(3) % 100 < spm, SPM).otherwise(PSM)
    parts = F.struct(form.alias("form"), part(F.lit(0), first).alias("p"), part(first, second).alias("m"), part(second, n).alias("s"))
    cut = f"parts_{hidden}"
    df = df.select(*df.columns, parts.alias(cut))
    p, m, s, form = (F.col(cut)[x] for x in ("p", "m", "s", "form"))
    mp, ms, mm = map(F.lit, MARKS)
    out = F.when(form == PLAIN, whole).when(form == PSM, F.concat(mp, p, ms, s, mm, m)).otherwise(F.concat(ms, s, mp, p, mm, m))
    chars = lambda c: F.when(form != PLAIN, F.length(c).cast("long"))
    return df.select(*kept, n.alias("n"), form.alias("form"), chars(p).alias("prefix_chars"), chars(m).alias("middle_chars"), out.alias(output))


def restored(output: Column, form: Column) -> Column:
    """The text that `transform` had. A transformed one has each mark once, since its text has none and no mark can arise
    where a piece and a mark meet."""
    pieces = F.split(output, "|".join(MARKS), -1)
    psm, spm = F.concat(pieces[1], pieces[3], pieces[2]), F.concat(pieces[2], pieces[3], pieces[1])
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
