"""Headings, chapters and sections from texts of several formats.

Texts come as (doc, text); lines are exploded once and all structure is found by
windows over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import clean_heading
from foliant.operators.windows import fence_parity


def lines(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, pos, line."""
    return texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\r\n|[\n\r\f\x0b\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))


def markdown_headings(texts: DataFrame) -> DataFrame:
    """doc, pos, level, title of ATX headings outside fenced blocks."""
    fenced = fence_parity(lines(texts), ["doc"], "pos", F.col("line").rlike(r"^\s*(```|~~~)"))
    pattern = r"^(#{1,6})\s+(.+?)\s*$"
    found = fenced.where(~F.col("fenced") & F.col("line").rlike(pattern))
    return found.select("doc", "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))


def org_headings(texts: DataFrame) -> DataFrame:
    """The same of outlines with stars; a text with an include directive is an error."""
    safe = texts.withColumn("text", F.when(F.col("text").rlike(r"(?im)^[ \t]*#\+INCLUDE\s*:"), F.raise_error(F.lit("an outline with includes has to be resolved first"))).otherwise(F.col("text")))
    pattern = r"^(\*{1,8})\s+(?:TODO\s+|DONE\s+)?(.+?)\s*$"
    found = lines(safe).where(F.col("line").rlike(pattern))
    return found.select("doc", "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))


def org_title(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?im)^#\+TITLE:\s*(.+)$", 1)), F.lit(""))


def text_headings(texts: DataFrame) -> DataFrame:
    """Chapter lines of plain texts: those that say so, else the second line with something on it."""
    filled = lines(texts).select("doc", "pos", F.trim("line").alias("line")).where("line <> ''")
    numbered = filled.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    says = F.col("line").rlike(r"(?i)^(?:chapter\s+\d+|第[^\s]{1,8}章|part\s+\d+)(?![\w])") & (F.col("k") > 1)
    marked = numbered.withColumn("says", says).withColumn("any", F.max("says").over(Window.partitionBy("doc")))
    return marked.where(F.col("says") | ~F.col("any") & (F.col("k") == 2)).select("doc", "pos", F.lit(1).alias("level"), F.col("line").alias("title"))


def html_headings(pages: DataFrame, doc: str = "doc", html: str = "text") -> DataFrame:
    """Headings of web pages in order."""
    pattern = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
    found = pages.select(F.col(doc).alias("doc"), F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("t"))).alias("pos", "h"))
    return found.select("doc", "pos", F.col("h.l").cast("int").alias("level"), F.regexp_replace("h.t", "(?s)<[^>]*>", " ").alias("title"))


def implicit_title(headings: DataFrame) -> DataFrame:
    """doc, title, skip_first: the one top heading that comes first, if there is just one."""
    cleaned = headings.withColumn("title", clean_heading(F.col("title"))).where("title <> ''")
    marked = cleaned.withColumn("top", F.min("level").over(Window.partitionBy("doc")))
    found = marked.groupBy("doc").agg(F.count_if(F.col("level") == F.col("top")).alias("roots"), F.count_if(F.col("level") > F.col("top")).alias("below"), F.min_by("title", "pos").alias("first"), F.min_by(F.col("level") == F.col("top"), "pos").alias("leads"))
    wraps = (F.col("roots") == 1) & F.col("leads")
    return found.select("doc", F.when(wraps, F.col("first")).otherwise("Untitled book").alias("title"), (wraps & (F.col("below") > 0)).alias("skip_first"))


def chapters(headings: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """doc, id, title, sections: headings of the least level, with the deeper ones behind each."""
    rows = headings.withColumn("title", clean_heading(F.col("title"))).where("title <> ''")
    if skip is not None:
        first = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
        rows = rows.join(skip.select("doc", "skip_first"), "doc", "left").withColumn("_k", first).where(~(F.coalesce("skip_first", F.lit(False)) & (F.col("_k") == 1))).drop("_k", "skip_first")
    top = F.col("level") == F.min("level").over(Window.partitionBy("doc"))
    number = F.sum(top.cast("int")).over(Window.partitionBy("doc").orderBy("pos"))
    marked = rows.withColumn("top", top).withColumn("n", number).where("n > 0")
    sections = F.transform(F.sort_array(F.collect_list(F.when(~F.col("top"), F.struct("pos", "title")))), lambda x: x["title"])
    grouped = marked.groupBy("doc", "n").agg(F.max(F.when(F.col("top"), F.col("title"))).alias("title"), sections.alias("sections"))
    n = F.col("n").cast("string")
    return grouped.select("doc", F.concat(F.lit("CH-"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)).alias("id"), "title", "sections")


def detect_format(path: Column) -> Column:
    """Format by a path's ending."""
    known = {"md": "markdown", "markdown": "markdown", "org": "org", "txt": "text", "text": "text", "pdf": "pdf", "epub": "epub", "json": "json"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def toc_entries(texts: DataFrame) -> DataFrame:
    """Chapters of a printed table of contents: doc, number, title, page, last_page.

    The first line for each number wins; its page stands on it or is the first
    number alone within nine lines.
    """
    rows = lines(texts).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    w = Window.partitionBy("doc").orderBy("pos")
    alone = F.when(F.col("line").rlike(r"^\d{1,4}$"), F.col("line").cast("int"))
    rows = rows.withColumn("near", F.first(F.when(alone > 0, alone), ignorenulls=True).over(w.rowsBetween(0, 8)))
    pattern = r"(?i)^chapter (\d{1,3})[:. ]+(.+?)(?:(?: ?\.{3,} ?| )(\d{1,4}))?$"
    found = rows.where(F.col("line").rlike(pattern)).select("doc", "pos", "near", *[F.regexp_extract("line", pattern, k).alias(x) for k, x in ((1, "number"), (2, "title"), (3, "own"))])
    page = F.coalesce(F.nullif("own", F.lit("")).cast("int"), "near")
    first = found.select("doc", F.col("number").cast("int").alias("number"), "pos", "title", page.alias("page")).groupBy("doc", "number").agg(F.min_by(F.struct("title", "page"), "pos").alias("x"))
    after = F.lead("x.page").over(Window.partitionBy("doc").orderBy("number"))
    return first.select("doc", "number", F.col("x.title").alias("title"), F.col("x.page").alias("page"), (after - 1).alias("last_page"))
