"""Replies of a model service: lenient reading of their JSON, JSON columns both ways, fenced blocks, and tokens of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

# The members of a reply, and those of the things that it lists; texts that must be there, and that may be.
TEXTS = ("kind", "summary", "category", "happened_on", "currency")
LISTS = {
    "fields": (("name", "value"), ("unit", "source")),
    "dates": (("kind", "date"), ("source",)),
    "entities": (("name",), ("kind", "relation", "source")),
    "assertions": (("subject", "predicate", "object"), ("since", "until", "source")),
    "problems": (("kind", "detail"), ("source",)),
}

# Languages whose comments begin with #, and the keywords of languages by their names.
HASH_COMMENTS = ("python", "py", "bash", "sh", "zsh", "shell", "ruby", "rb", "yaml", "yml", "toml", "r", "perl", "makefile")
KEYWORDS = {
    ("python", "py"): (
        "def", "class", "if", "elif", "else", "for", "while", "return", "import", "from", "as", "with", "try", "except", "finally", "raise", "lambda", "pass",
        "break", "continue", "in", "not", "and", "or", "is", "None", "True", "False", "self", "yield", "async", "await", "global", "assert", "del", "print",
    ),
    ("swift",): (
        "func", "let", "var", "if", "else", "guard", "return", "struct", "class", "enum", "protocol", "extension", "import", "for", "in", "while", "switch",
        "case", "default", "try", "catch", "throw", "throws", "async", "await", "public", "private", "internal", "static", "self", "nil", "true", "false",
        "init", "some", "any", "where", "typealias", "defer",
    ),
    ("javascript", "js", "typescript", "ts", "jsx", "tsx"): (
        "function", "const", "let", "var", "if", "else", "for", "while", "return", "class", "extends", "import", "from", "export", "default", "new", "this",
        "null", "undefined", "true", "false", "async", "await", "try", "catch", "finally", "throw", "typeof", "instanceof", "interface", "type", "enum",
        "public", "private", "of", "in",
    ),
    ("bash", "sh", "zsh", "shell"): ("if", "then", "else", "elif", "fi", "for", "in", "do", "done", "while", "case", "esac", "function", "echo", "export", "local", "return", "source"),
    ("sql",): (
        "select", "from", "where", "join", "left", "inner", "outer", "on", "group", "by", "order", "limit", "insert", "into", "values", "update", "set",
        "delete", "create", "table", "index", "and", "or", "not", "null", "as",
    ),
    ("json",): ("true", "false", "null"),
}
#: Keywords of code in no language or another one.
ANY_KEYWORDS = (
    "func", "function", "def", "class", "let", "const", "var", "if", "else", "elif", "for", "while", "return", "import", "from", "struct", "enum",
    "public", "private", "static", "try", "catch", "throw", "async", "await", "true", "false", "null", "nil", "None", "True", "False", "self", "this",
    "new", "in", "not", "and", "or",
)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_is(v, "BIGINT") | _is(v, "DOUBLE") | _is(v, "DECIMAL"), F.try_variant_get(v, "$", "double"))


def _listed(v: Column, must: tuple[str, ...], may: tuple[str, ...]) -> Column:
    """The things of a list, as structs; none of them if one has not all texts that it must, or another type where a text
    may be."""
    items = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    there = lambda x, n: _is(_member(x, n), "STRING")
    fine = lambda x: _all(_is(x, "OBJECT"), *(there(x, n) for n in must), *(there(x, n) | _member(x, n).isNull() | _is(_member(x, n), "VOID") for n in may))
    made = F.transform(items, lambda x: F.struct(*(_text(_member(x, n)).alias(n) for n in (*must, *may))))
    kind = f"array<struct<{', '.join(f'{n}: string' for n in (*must, *may))}>>"
    return F.when(F.forall(items, fine), made).otherwise(F.array().cast(kind))


def _all(first: Column, *rest: Column) -> Column:
    for c in rest:
        first = first & c
    return first


def read(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds malformed (the reply is no JSON object; null replies, too), title (empty if it is no text), the TEXTS, amount,
    notice_days (whole numbers only) and the LISTS. A member of another type than it should have is null, a list with a bad
    thing in it is empty; neither costs the others. Fields without a name go. Equal names are replaced."""
    hidden = "__reply"
    df = df.withColumn(hidden, F.try_parse_json(reply))
    v = F.col(hidden)
    v = F.when(_is(v, "OBJECT"), v)
    number = _number(_member(v, "notice_days"))
    columns = {"malformed": v.isNull(), "title": F.coalesce(_text(_member(v, "title")), F.lit(""))}
    columns |= {n: _text(_member(v, n)) for n in TEXTS}
    columns |= {"amount": _number(_member(v, "amount")), "notice_days": F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.cast("long"))}
    columns |= {n: _listed(_member(v, n), *parts) for n, parts in LISTS.items()}
    columns["fields"] = F.filter(columns["fields"], lambda x: T.trimmed(x["name"]) != "")
    return df.withColumns(columns).drop(hidden)


def encoded(value: Column) -> Column:
    """A map, struct or array as JSON text; null members are left out."""
    return F.to_json(value)


def decoded_aliases(json: Column) -> Column:
    """The texts of a JSON array; none if it is none, or has something else in it."""
    v = F.try_parse_json(json)
    items = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    return F.when(F.forall(items, lambda x: _is(x, "STRING")), F.transform(items, _text)).otherwise(F.array().cast("array<string>"))


def decoded_box(json: Column) -> Column:
    """A box (x, y, width, height) of a JSON object; null if one of the numbers isn't there."""
    v = F.try_parse_json(json)
    parts = [_number(_member(v, n)).alias(n) for n in ("x", "y", "width", "height")]
    return F.when(_all(*(_number(_member(v, n)).isNotNull() for n in ("x", "y", "width", "height"))), F.struct(*parts))


def decoded_fields(json: Column) -> Column:
    """Fields (name to value, unit and source) of a JSON object; none if one of them has no value, or another type where a
    text may be."""
    v = F.try_parse_json(json)
    entries = F.map_entries(F.when(_is(v, "OBJECT"), F.try_variant_get(v, "$", "map<string, variant>")))
    fine = lambda e: _all(_is(e["value"], "OBJECT"), _is(_member(e["value"], "value"), "STRING"), *(_member(e["value"], n).isNull() | _is(_member(e["value"], n), "VOID") | _is(_member(e["value"], n), "STRING") for n in ("unit", "source")))
    made = F.transform(entries, lambda e: F.struct(e["key"], F.struct(*(_text(_member(e["value"], n)).alias(n) for n in ("value", "unit", "source")))))
    return F.when(F.forall(entries, fine), F.map_from_entries(made)).otherwise(F.create_map().cast("map<string, struct<value: string, unit: string, source: string>>"))


#: A line that begins with a fence, white space aside.
FENCE = r"(?md)^[\p{Zs}\t]*```[^\n]*$"


def blocks(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, place (from 0), kind (prose or code), language, text and closed: a text cut at its fence lines, which open and
    close code by turns. Prose is trimmed, and left out where nothing is left; code loses blank lines at both ends and is
    kept even if empty. The last fence may be unclosed. Null and empty texts have no blocks. No row leaves its task."""
    t = F.coalesce(F.col(text), F.lit(""))
    pieces, fences = F.split(t, FENCE, -1), F.regexp_extract_all(t, F.lit(FENCE), F.lit(0))
    tag = lambda line: F.nullif(F.lower(F.regexp_replace(F.regexp_replace(line, r"^[\p{Zs}\t]*```", ""), r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")), F.lit(""))
    # The line breaks around a fence line are the fence's.
    body = lambda x: F.when(F.regexp_replace(x, r"[\p{Zs}\t\n]", "") == "", "").otherwise(F.regexp_replace(F.regexp_replace(x, r"\A(?:[\p{Zs}\t]*\n)+", ""), r"(?:\n[\p{Zs}\t]*)+\z", ""))
    code = lambda i: i % 2 == 1
    made = F.transform(pieces, lambda x, i: F.struct(F.when(code(i), "code").otherwise("prose").alias("kind"), F.when(code(i), tag(F.get(fences, i - 1))).alias("language"), F.when(code(i), body(x)).otherwise(T.trimmed(x)).alias("text"), F.when(code(i), i < F.size(pieces) - 1).alias("closed")))
    kept = F.filter(made, lambda b: (b["kind"] == "code") | (b["text"] != ""))
    return df.select(id, F.posexplode(kept).alias("place", "b")).select(id, "place", "b.kind", "b.language", "b.text", "b.closed")


#: Numbers, words and strings of all languages; a string that isn't closed ends with its line.
_WORD, _NUMBER = r"[\p{L}_][\p{L}\p{N}_]*+", r"\p{N}[\p{N}._]*"
_STRING = "|".join(rf"{q}[^{q}\\\n]*+(?:\\(?:[\s\S]|\z)[^{q}\\\n]*+)*+{q}?" for q in ('"', "'", "`"))
#: Comments by their language, and what is none: a lookahead before what is plain.
_HASH, _SLASH = (r"#[^\n]*", "(?!#)"), (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", r"(?!/[/*])")


def _spans(code: Column, comment: tuple[str, str], keywords: tuple[str, ...]) -> Column:
    """Texts of the spans: comments, strings, numbers, keywords, and what lies between them as one, however long."""
    keyword = rf"(?:{'|'.join(keywords)})(?![\p{{L}}\p{{N}}_])"
    plain = rf"(?:(?!{keyword}){_WORD}|{comment[1]}[^\p{{L}}\p{{N}}_\"'`])++"
    return F.regexp_extract_all(code, F.lit(f"{comment[0]}|{_STRING}|{_NUMBER}|{keyword}|{plain}"), F.lit(0))


def highlighted(df: DataFrame, code: str = "code", language: str | None = None, spans: str = "spans") -> DataFrame:
    """Adds spans: an array of text and kind (plain, keyword, string, comment or number) that put together give the code
    again; none for null and empty code. A column named `spans` is replaced."""
    lang = F.coalesce(F.col(language), F.lit("")) if language else F.lit("")
    texts = F.when(lang.isin(*HASH_COMMENTS), _spans(F.col(code), _HASH, ANY_KEYWORDS)).otherwise(_spans(F.col(code), _SLASH, ANY_KEYWORDS))
    # The last language that has the name counts.
    words = F.array(*map(F.lit, ANY_KEYWORDS))
    for names, keywords in KEYWORDS.items():
        mine = [_spans(F.col(code), c, keywords) for c in (_HASH, _SLASH)]
        texts = F.when(lang.isin(*names), F.when(lang.isin(*HASH_COMMENTS), mine[0]).otherwise(mine[1])).otherwise(texts)
        words = F.when(lang.isin(*names), F.array(*map(F.lit, keywords))).otherwise(words)
    # Columns of their own, so that a lambda reads them and doesn't work them out again.
    df = df.withColumns({"__texts": F.coalesce(texts, F.array().cast("array<string>")), "__words": words, "__hashes": lang.isin(*HASH_COMMENTS)})
    comment = lambda x: (F.col("__hashes") & x.startswith("#")) | (~F.col("__hashes") & (x.startswith("//") | x.startswith("/*")))
    kind = lambda x: F.when(comment(x), "comment").when(F.left(x, F.lit(1)).isin('"', "'", "`"), "string").when(x.rlike(r"\A\p{N}"), "number").when(F.array_contains("__words", x), "keyword").otherwise("plain")
    made = F.transform("__texts", lambda x: F.struct(x.alias("text"), kind(x).alias("kind")))
    return df.withColumn(spans, made).drop("__texts", "__words", "__hashes")
