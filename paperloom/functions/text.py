"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "●•▪◦‣·"

#: The ligatures that fonts draw as one glyph, and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}

#: Question and function words that no document is searched for.
QUESTION_WORDS = """
what whats when where who whos whom which why how
is are was were be been am do does did can
could should would will shall have has had
the a an of to in on at for from by with
and or but if then than that this these those
it its my me i you your our we they them
there here about any all some much many most
get got tell show find know need want please
""".split()

#: Words that occur in documents of every kind.
STOP_WORDS = """
this that these those with from have has had been
will shall would should must may any all such each
which there their them then than when what were was
your yours you our ours into upon under over also
other more most some only same both here does made
make page date dated please thank regards sincerely
email phone address name number total amount document
""".split()

#: Fixed value: what makes an element worth an anchor (dates, amounts, measured or grouped numbers, years).
FACT = r"\d{4}-\d{2}-\d{2}|[$€£]\s?[\d,]+|\b\d[\d,]*\.?\d*\s*(%|USD|EUR|GBP)\b|\b\d{1,3}(,\d{3})+\b|\b(19|20)\d{2}\b"


def trimmed(text: Column) -> Column:
    """Without white space, line breaks included, at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def without_ligatures(text: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return text


def has_bullet_items(text: Column) -> Column:
    """Whether a text starts with a bullet and holds two more at least. Cheap, for a filter before `bullet_items`."""
    bullets = F.length(text) - F.length(F.translate(text, BULLETS, ""))
    return trimmed(text).rlike(rf"\A[{BULLETS}]") & (bullets >= 3)


def bullet_items(text: Column) -> Column:
    """Items of a text that starts with a bullet and holds two more at least; else null."""
    # White space at both sides goes with its bullet, from where it begins or the bullet before ended.
    parts = F.split(trimmed(text), rf"(?:(?<!\s)|\G)\s*+[{BULLETS}]\s*+")
    return F.when(has_bullet_items(text), F.filter(parts, lambda p: F.length(p) > 2))


def anchor(cited: Column) -> Column:
    """A cited anchor in its plain form e<digits>, or null."""
    around = r"[ \t\n\[\](),.;:'\"“”]+"
    return F.nullif(F.regexp_extract(F.lower(F.regexp_replace(cited, f"^{around}|{around}$", "")), r"^e\d+\z", 0), F.lit(""))


def without_anchors(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, r"\[e\d+\]", ""))


def has_fact(text: Column) -> Column:
    return text.rlike(FACT)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3.7))


def comparable(value: Column) -> Column:
    """A value without the punctuation that varies: numbers as numbers, else lower-cased text."""
    bare = F.regexp_replace(F.lower(value), r"[\s,$£€]", "")
    number = bare.try_cast("double")
    return F.coalesce(F.round(number, 6).cast("string"), bare)


def html_text(html: Column) -> Column:
    """Text of an HTML page: line breaks where blocks end, entities decoded, blank lines dropped."""
    text = F.regexp_replace(html, r"(?i)</p>|<br\s*/?>|</div>|</tr>|</h[1-6]>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(letter))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_quotes(text: Column) -> Column:
    """Drops quoted reply lines; a text of which more than 60 percent of the lines are quoted becomes null."""
    lines = F.split(text, "\n")
    quoted = F.filter(lines, lambda x: F.ltrim(x).startswith(">"))
    rest = F.filter(lines, lambda x: ~F.ltrim(x).startswith(">"))
    return F.when(F.size(quoted) / F.size(lines) <= 0.6, F.array_join(rest, "\n"))


def content_words(question: Column) -> Column:
    words = F.transform(F.split(question, r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(QUESTION_WORDS))


def beginning(text: Column, considered: int | None) -> Column:
    """The first `considered` characters of a text, or all of it."""
    return text if considered is None else F.substring(text, 1, considered)


def terms(text: Column, considered: int | None = None) -> Column:
    """Words of 4 to 23 letters without digits that aren't stop words, of a text or its first `considered` characters."""
    words = F.transform(F.split(beginning(text, considered), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) > 3) & (F.length(w) < 24) & ~w.rlike(r"\d") & ~w.isin(STOP_WORDS))


def trigrams(text: Column) -> Column:
    """The distinct character trigrams of a padded text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(F.concat(F.lit("  "), text, F.lit(" ")), i, F.lit(3))))


def trigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct character trigrams of two padded texts."""
    x, y = trigrams(a), trigrams(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def occurrences(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def identifiers(text: Column) -> Column:
    """E-mail addresses and phone numbers of ten digits at least, as a sorted set."""
    mails = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), lambda m: F.concat(F.lit("email:"), F.lower(m)))
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"\+?\d[\d\t\n\f\r\p{Z}().-]{8,}\d"), F.lit(0)), lambda p: F.regexp_replace(p, r"\D", ""))
    phones = F.transform(F.filter(runs, lambda p: F.length(p) >= 10), lambda p: F.concat(F.lit("phone:"), F.right(p, F.lit(10))))
    return F.array_sort(F.array_distinct(F.concat(mails, phones)))


def snippet(text: Column, word: Column, before: int = 30, after: int = 90) -> Column:
    at = F.instr(F.lower(text), F.lower(word))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(before + after)))


def citations(text: Column) -> Column:
    """All d<document>:e<anchor> tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"d\d+:e\d+"), F.lit(0))


def cited(cite: Column) -> tuple[Column, Column]:
    """Document id and anchor of a citation d<document>:<anchor>, with or without brackets; null where there is none."""
    parts = F.split(F.regexp_replace(cite, r"^[ \[\]()]+|[ \[\]()]+$", ""), ":", 2)
    reference = F.lower(F.regexp_replace(F.get(parts, F.lit(0)), r"^\s+|\s+$", ""))
    id = F.when(F.size(parts) == 2, F.regexp_extract(reference, r"^d?(\d{1,18})$", 1))
    return F.nullif(id, F.lit("")).cast("long"), F.when(F.size(parts) == 2, F.nullif(F.get(parts, F.lit(1)), F.lit("")))


def owned_anchors(text: Column, document_id: Column) -> Column:
    """A text whose anchors [e<n>] carry their document too: [d<document>:e<n>]."""
    return F.regexp_replace(text, F.lit(r"\[(e\d+)\]"), F.concat(F.lit("[d"), document_id.cast("string"), F.lit(":$1]")))


def plural(word: Column) -> Column:
    w = F.lower(word)
    ies = F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("ies"))
    return F.when(w.rlike("[^aeiou]y$"), ies).when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))


def readable(text: Column, considered: int | None = None) -> Column:
    """Share of letters, digits, punctuation and blanks in a text or its first `considered` characters; not a number for an empty one."""
    head = beginning(text, considered)
    kept = F.length(F.regexp_replace(head, r"[^A-Za-z0-9\s.,;:!?'\"()-]", ""))
    # An empty text has no share: not a number, as in the SQL; a division by zero is an error.
    return F.when(F.length(head) == 0, F.lit(float("nan"))).otherwise(F.try_divide(kept, F.length(head)))
