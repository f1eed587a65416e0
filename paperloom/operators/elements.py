"""Operators on documents and their elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Readers in the order in which they are asked, with the extensions that they take. Fixed values.
READERS = {
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "heic", "tiff", "gif"],
    "audio": ["m4a", "mp3", "wav", "aiff"],
    "email": ["eml", "emlx"],
    "office": ["xlsx", "pptx"],
    "rich_text": ["docx", "doc", "rtf", "rtfd", "html", "htm"],
    "plain_text": ["txt", "md", "markdown", "csv", "tsv", "json"],
}
FURNITURE = ("pageHeader", "pageFooter", "pageNumber")


def added_once(df: DataFrame, hash: str, id: str, size: str | None = None) -> DataFrame:
    """The first arrival of each content and how often it arrived; contents without bytes (column `size`) are rejected."""
    df = df.where(F.col(size) > 0) if size else df
    return df.groupBy(hash).agg(F.min(id).alias(id), F.count(F.lit(1)).alias("arrivals")).select(id, hash, "arrivals")


def reader(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.when(F.lit(False), "")
    for kind, extensions in READERS.items():
        out = out.when(extension.isin(extensions), kind)
    return out


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (document_id, text), separated by blank lines, with kind, depth, position and anchor."""
    rows = docs.select("document_id", F.posexplode(F.split("text", "\n\n")).alias("i", "block"))
    b = T.trimmed(F.col("block"))
    rows = rows.withColumn("b", b).where("b <> ''")
    b, item = F.col("b"), F.col("b").rlike(r"^[-*•] ")
    title = b.rlike(r"^#+ ")
    kind = F.when(title, "title").when(item, "listItem").when(b.startswith("```"), "code").otherwise("text")
    depth = F.when(title, F.length(F.regexp_extract(b, r"^#+", 0)) - 1).otherwise(0)
    text = F.when(title, F.regexp_replace(F.regexp_replace(b, r"^#+", ""), r"^\s+", "")).when(item, F.substring(b, F.lit(3), F.length(b))).otherwise(b)
    at = (F.row_number().over(Window.partitionBy("document_id").orderBy("i")) - 1).alias("position")
    rows = rows.select("document_id", at, kind.alias("kind"), depth.alias("depth"), text.alias("text"))
    return rows.select("document_id", "position", F.concat(F.lit("e"), F.col("position").cast("string")).alias("tag"), "kind", "depth", "text")


def page_markers(elements: DataFrame) -> DataFrame:
    shown = elements.where(~F.col("kind").isin(*FURNITURE))
    before = F.lag("page").over(Window.partitionBy("document_id").orderBy("position"))
    marker = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->"))
    return shown.withColumn("before", before).where("before IS NULL OR before <> page").select("document_id", "position", marker.alias("marker"))


def rendered(elements: DataFrame) -> DataFrame:
    """One markdown text a document: furniture dropped, anchors where an element holds a fact."""
    t = T.trimmed(F.col("text"))
    tag = F.concat(F.lit(" ["), "tag", F.lit("]"))
    mark = F.when((F.col("kind") == "table") | T.has_fact(F.col("text")), tag).otherwise("")
    hashes = F.expr("repeat('#', least(6, depth + 1))")
    line = (
        F.when(F.col("kind") == "title", F.concat(hashes, F.lit(" "), t, mark))
        .when(F.col("kind") == "listItem", F.concat(F.lit("- "), t, mark))
        .when(F.col("kind") == "table", F.concat(t, F.lit("\n"), F.ltrim(mark)))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .when(F.col("kind") == "image", F.concat(F.lit("_[image: "), t, F.lit("]_")))
        .when(F.col("kind") == "caption", F.concat(F.lit("_"), t, F.lit("_")))
        .otherwise(F.concat(t, mark))
    )
    rows = elements.where(~F.col("kind").isin(*FURNITURE) & (t != "")).select("document_id", "position", line.alias("line"))
    lines = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    return lines.select("document_id", T.trimmed(F.regexp_replace(whole, "\n{3,}", "\n\n")).alias("markdown"))


def markdown_tables(rows: DataFrame, key: str, order: str, columns: dict[str, str]) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns.values())), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    lines = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    return lines.select(key, F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("markdown"))


def stand_in(docs: DataFrame) -> DataFrame:
    """Title, amount and date of a document without a model: its first heading, dollar amount and ISO date."""
    title = T.trimmed(F.regexp_extract(F.split_part("text", F.lit("\n"), F.lit(1)), r"^# (.*)$", 1))
    amount = F.replace(F.nullif(F.regexp_extract("text", r"\$([\d,]+(?:\.\d+)?)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    day = F.nullif(F.regexp_extract("text", r"\d{4}-\d{2}-\d{2}", 0), F.lit("")).try_cast("date")
    return docs.select("doc_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"), amount.alias("amount"), day.alias("happened_on"), F.lit("Everything else").alias("category"))


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def heading(line: Column, size: Column, body: Column, bold: Column) -> tuple[Column, Column]:
    """Kind and depth of a line."""
    bullet = line.rlike(f"^[{T.BULLETS}-]")
    strong = bold & (F.length(line) <= 80) & ~line.endswith(".") & ~bullet
    kind = F.when((size / body >= 1.15) | strong, "title").when(bullet, "listItem").otherwise("text")
    return kind, F.when(size / body >= 1.45, 0).when(size / body >= 1.15, 1).when(strong, 2).otherwise(0)


def from_bottom_left(box: Column) -> Column:
    return F.struct(box["x"].alias("x"), (1 - box["y"] - box["height"]).alias("y"), box["width"].alias("width"), box["height"].alias("height"))


def centre_within(box: Column, left: float, top: float, right: float, bottom: float) -> Column:
    x, y = box["x"] + box["width"] / 2, box["y"] + box["height"] / 2
    return x.between(left, right) & y.between(top, bottom)


#: Parts into which a page's width is cut to look for a gutter, where it may lie, and how many must be free.
BINS, FIRST_BIN, LAST_BIN, FREE_BINS = 100, 25, 75, 3
LINE = 0.012


def bins_taken(x: Column, width: Column) -> Column:
    """The parts in the middle of a page that an element takes, a bit for each."""
    low, high = (x * BINS).cast("int"), F.least(F.lit(BINS - 1), ((x + width) * BINS).cast("int"))
    low, high = F.greatest(low, F.lit(FIRST_BIN)) - FIRST_BIN, F.least(high, F.lit(LAST_BIN)) - FIRST_BIN
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    return F.when(low <= high, bit(high + 1) - bit(low)).otherwise(F.lit(0).cast("long"))


def with_gutter(rows: DataFrame, taken: str, once: Column) -> DataFrame:
    """Adds gutter to rows where `once` holds: where the widest run of free parts in the middle of a page is, given the bits of
    those that are `taken`, if it is wide enough. Of equal ones the leftmost counts; a run that reaches the end of the middle is
    one part shorter."""
    ends = F.filter(F.sequence(F.lit(FIRST_BIN), F.lit(LAST_BIN)), lambda k: F.getbit(F.col(taken), k - FIRST_BIN) == 1)
    rows = rows.withColumn("__ends", F.when(once, ends))
    before = lambda i: F.coalesce(F.get("__ends", i - 1), F.lit(FIRST_BIN - 1))
    run = lambda width, k, at: F.struct(width.cast("int").alias("width"), (-k).cast("int").alias("k"), at.cast("double").alias("at"))
    inner = F.transform("__ends", lambda end, i: run(end - before(i) - 1, i, (before(i) + 1 + end) / 2.0 / BINS))
    start = F.coalesce(F.try_element_at("__ends", F.lit(-1)), F.lit(FIRST_BIN - 1)) + 1
    last = run(F.lit(LAST_BIN) - start, F.size("__ends"), start / BINS + (F.lit(LAST_BIN) - start) / 2.0 / BINS)
    rows = rows.withColumn("__best", F.when(once, F.array_max(F.concat(inner, F.array(last)))))
    return rows.withColumn("gutter", F.when(F.col("__best.width") >= FREE_BINS, F.col("__best.at"))).drop("__ends", "__best")


def reading_order(boxes: DataFrame) -> DataFrame:
    """page_id, position and place (from 1) of elements (page_id, position, x, y, width), with the column that each is in.

    On a page with a gutter and two elements at least on either side: what spans it and stands above the left column, the
    left column, the right one, and what else spans it, each from the top. Otherwise in lines, from left to right; a line
    ends where the next element begins LINE lower than the one before. Pages of up to three elements, or with an element
    without a box, stay as they are.
    """
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull()
    page = Window.partitionBy("page_id")
    # All by page, so that rows are shuffled once; a page's gutter is worked out in one of its rows.
    rows = boxes.withColumn("taken", F.when(whole, bins_taken(F.col("x"), F.col("width"))))
    rows = rows.withColumns({"whole": (F.count(F.lit(1)).over(page) > 3) & F.min(whole).over(page), "taken": F.bit_or("taken").over(page), "top": F.min("position").over(page)})
    rows = with_gutter(rows, "taken", F.col("whole") & (F.col("position") == F.col("top"))).drop("taken", "top")
    rows = rows.withColumn("gutter", F.max("gutter").over(page))
    right_edge = F.col("x") + F.col("width")
    side = F.when((F.col("x") < F.col("gutter")) & (right_edge > F.col("gutter")), 0).when(right_edge <= F.col("gutter"), 1).when(F.col("gutter").isNotNull(), 2)
    rows = rows.withColumn("side", side)
    count = lambda k: F.sum((F.col("side") == k).cast("int")).over(page)
    rows = rows.withColumn("two", F.coalesce(F.col("whole") & (count(1) >= 2) & (count(2) >= 2), F.lit(False)))
    top = F.min(F.when(F.col("side") == 1, F.col("y"))).over(page)
    column = F.when(F.col("two") & (F.col("side") == 0), F.when(F.col("y") < top, 0).otherwise(3)).when(F.col("two"), F.col("side")).otherwise(0)
    down = page.orderBy("y", "x", "position")
    lower = F.when(F.col("y") - F.lag("y").over(down) >= LINE, 1).otherwise(0)
    rows = rows.withColumns({"column": column, "lower": lower})
    line = F.sum("lower").over(down.rowsBetween(Window.unboundedPreceding, 0))
    keep = ~F.col("whole")
    first = F.when(keep, F.lit(0.0)).when(F.col("two"), F.col("y")).otherwise(F.col("line").cast("double"))
    second = F.when(keep | F.col("two"), F.lit(0.0)).otherwise(F.col("x"))
    rows = rows.withColumn("line", line).withColumns({"first": first, "second": second})
    place = F.row_number().over(page.orderBy("column", "first", "second", "position"))
    return rows.select("page_id", "position", place.alias("place"), "column")


def tabular(glyphs: DataFrame, bucket: float = 12.0) -> DataFrame:
    """page_id of pages whose glyphs (page_id, line, position, x, width, in points) look like a table: three edges of columns
    at least fall into one bucket. An edge is a glyph three times as wide as the line's median, or the end of such a gap.
    Lines of up to eight glyphs, or of up to four that have a width, have no edges; 300 glyphs of a line are looked at.
    """
    line = Window.partitionBy("page_id", "line")
    rows = glyphs.withColumn("n", F.count(F.lit(1)).over(line)).withColumn("k", F.row_number().over(line.orderBy("position"))).where("n > 8 AND k <= 300 AND width > 0")
    widths = rows.groupBy("page_id", "line").agg(F.array_sort(F.collect_list("width")).alias("w")).where(F.size("w") > 4)
    typical = widths.select("page_id", "line", F.get("w", F.floor(F.size("w") / 2).cast("int")).alias("typical"))
    before = F.lag(F.col("x") + F.col("width")).over(line.orderBy("position"))
    rows = rows.withColumn("before", before).join(typical, ["page_id", "line"])
    wide, gap = F.col("width") > F.col("typical") * 3, F.col("x") - F.col("before") > F.col("typical") * 3
    edge = F.when(wide, F.col("x") + F.col("width")).when(gap, F.col("x"))
    edges = rows.select("page_id", (edge / bucket).cast("long").alias("bucket")).where("bucket IS NOT NULL").groupBy("page_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return edges.where("n >= 3").select("page_id").distinct()
