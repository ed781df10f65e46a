"""Whole-text operators that need no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What starts a comment line.
COMMENT_PREFIX = {"python": "#", "shell": "#", "yaml": "#", "toml": "#", "ruby": "#", "r": "#", "make": "#", "docker": "#", "sql": "--", "lua": "--", "javascript": "//", "typescript": "//", "go": "//", "java": "//", "c": "//", "cpp": "//", "rust": "//"}


def lines(text: Column) -> Column:
    """Lines without the empty one that a final line end leaves."""
    all_ = F.split(text, r"\r\n|[\n\r]")
    return F.when(F.element_at(all_, -1) == "", F.slice(all_, F.lit(1), F.size(all_) - 1)).otherwise(all_)


def physical_lines(text: Column) -> Column:
    """Line feeds, and one more if the last line has none; nothing in an empty text."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1))


def generic_parse(docs: DataFrame, prefix: str = "#") -> DataFrame:
    """text -> logical_loc (lines that are not blank), comment_lines, physical_lines."""
    trimmed = F.transform(lines(F.col("text")), lambda x: F.trim(x))
    return docs.withColumn("_l", trimmed).withColumns({"logical_loc": F.size(F.filter("_l", lambda x: x != "")), "comment_lines": F.size(F.filter("_l", lambda x: x.startswith(prefix))), "physical_lines": physical_lines(F.col("text"))}).drop("_l")


def jsonl_rows(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def shorten(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


#: Entities that plain text of a page decodes.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def page_text(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, level, title of h1 to h6."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    each = pages.select("page_id", F.explode(found).alias("h"))
    return each.select("page_id", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), page_text(F.col("h")).alias("title"))


def debt(docs: DataFrame, markers: tuple[str, ...] = ("TODO", "FIXME", "HACK", "XXX"), openers: str = r"(?:#|//|/\*+|^\s*\*|--|<!--)", limit: int = 50) -> DataFrame:
    """id, text -> id, line, marker, note: markers at the start of a comment, or with a colon in one; the first of each text."""
    words = "|".join(markers)
    first = rf"{openers}\s*@?({words})\b(?:\([^)]*\))?[:\s]*([^\n]*)"
    later = rf"{openers}[^\n]*?\b({words})(?:\([^)]*\))?:\s*([^\n]*)"
    # A look for any marker comes first: most texts have none.
    some = docs.where(F.col("text").rlike(words)).select("id", F.posexplode(lines(F.col("text"))).alias("n", "l"))
    hit = F.regexp_extract("l", first, 1)
    marker = F.when(hit != "", hit).otherwise(F.regexp_extract("l", later, 1))
    note = F.when(hit != "", F.regexp_extract("l", first, 2)).otherwise(F.regexp_extract("l", later, 2))
    found = some.select("id", (F.col("n") + 1).alias("line"), marker.alias("marker"), shorten(F.regexp_replace(F.trim(note), r"[*/\-> ]+$", ""), 100).alias("note")).where("marker <> ''")
    from pyspark.sql import Window

    return found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where(F.col("r") <= limit).drop("r")


def line_offsets(docs: DataFrame) -> DataFrame:
    """id, text -> id, line, offset, bytes of each line with its end."""
    every = docs.select("id", F.posexplode(F.split("text", "(?<=\n)")).alias("n", "l")).where("l <> ''")
    size = F.octet_length("l")
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("id", (F.col("n") + 1).alias("line"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("offset"), size.cast("long").alias("bytes"))


def json_rows(source: Column) -> Column:
    """The length of an array, of an object the number of its keys or its longest array, whichever is more; 0 of another value, null of what is no JSON."""
    held = F.map_values(F.from_json(source, "map<string,variant>"))
    longest = F.array_max(F.transform(held, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.json_array_length(F.to_json(v)))))
    known = F.try_parse_json(source)
    of = F.when(source.rlike(r"^\s*+\[") & known.isNotNull(), F.json_array_length(source)).when(source.rlike(r"^\s*+\{") & known.isNotNull(), F.greatest(F.size(F.json_object_keys(source)), F.coalesce(longest, F.lit(0))))
    return F.coalesce(of, F.when(known.isNotNull(), 0)).cast("long")
