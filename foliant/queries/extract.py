"""Structure of texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import extract
from foliant.queries.base import Tables, query

#: Texts made from documents' lines: heading marks by length, fences now and then.
_MARKED = """SELECT doc_id, pos, CASE WHEN length(line) % 9 = 0 THEN '```' WHEN length(line) % 4 = 0 THEN repeat('#', CAST(length(line) % 3 + 1 AS INT)) || ' ' || line ELSE line END AS line
 FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"""
_HEADINGS = f"""SELECT doc_id AS doc, pos, length(regexp_extract(line, '^(#+) ', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^#+\\s+(.+?)\\s*$', 1), '\\s+', ' ', 'g')) AS title
 FROM (SELECT *, sum((line = '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS fenced FROM ({_MARKED})) WHERE fenced = 0 AND regexp_matches(line, '^#+\\s+\\S')"""


def _marked(t: Tables, mark: str = "#"):
    line = lambda x: F.when(F.length(x) % 9 == 0, F.lit("```")).when(F.length(x) % 4 == 0, F.concat(F.repeat(F.lit(mark), F.length(x) % 3 + 1), F.lit(" "), x)).otherwise(x)
    return t.documents.select(F.col("doc_id").alias("doc"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(_HEADINGS)
def s01_markdown(t: Tables):
    """Headings of Markdown texts outside fenced blocks."""
    return extract.markdown_headings(_marked(t)).select("doc", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query(_HEADINGS.replace("fenced = 0 AND", ""))
def s02_org(t: Tables):
    """Headings of star outlines (fences mean nothing there)."""
    return extract.org_headings(_marked(t, "*")).select("doc", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query("""
WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10) || 'Th', chr(10) || 'Chapter 7 Th') ELSE text END AS text FROM documents)),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM l WHERE line <> ''), s AS (SELECT *, regexp_matches(line, '(?i)^chapter\\s+\\d+\\b') AND k > 1 AS says FROM n)
SELECT doc, pos, line AS title FROM (SELECT *, bool_or(says) OVER (PARTITION BY doc) AS has_any FROM s) WHERE says OR NOT has_any AND k = 2
""")
def s03_plain_text(t: Tables):
    """Chapter lines of plain texts, or the second line."""
    marked = t.documents.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\nTh"), F.lit("\nChapter 7 Th"))).otherwise(F.col("text")).alias("text"))
    return extract.text_headings(marked).select("doc", F.col("pos").cast("long").alias("pos"), "title")


@query(f"""
WITH h AS ({_HEADINGS}), m AS (SELECT *, level = min(level) OVER (PARTITION BY doc) AS top FROM h), n AS (SELECT *, sum(top::INT) OVER (PARTITION BY doc ORDER BY pos) AS n FROM m)
SELECT doc, 'CH-' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id, max(CASE WHEN top THEN title END) AS title, coalesce(string_agg(CASE WHEN NOT top THEN title END, '|' ORDER BY pos), '') AS sections FROM n WHERE n > 0 GROUP BY doc, n
""")
def s04_chapters(t: Tables):
    """Headings nested into chapters and sections."""
    return extract.chapters(extract.markdown_headings(_marked(t))).select("doc", "id", "title", F.array_join("sections", "|").alias("sections"))


@query(f"""
WITH h AS ({_HEADINGS}), m AS (SELECT *, level = min(level) OVER (PARTITION BY doc) AS top FROM h),
 g AS (SELECT doc, sum(top::INT) AS roots, sum((NOT top)::INT) AS below, arg_min(title, pos) AS first, arg_min(top, pos) AS leads FROM m GROUP BY doc)
SELECT doc, CASE WHEN roots = 1 AND leads THEN first ELSE 'Untitled book' END AS title, roots = 1 AND leads AND below > 0 AS skip_first FROM g
""")
def s05_implicit_title(t: Tables):
    """A title where one heading wraps the text."""
    return extract.implicit_title(extract.markdown_headings(_marked(t)))


@query("SELECT page_id AS doc, 1 AS level, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM pages WHERE regexp_matches(html, '<h1')")
def s11_html_headings(t: Tables):
    """Headings of web pages."""
    return extract.html_headings(t.pages.select("page_id", "html"), "page_id", "html").select("doc", "level", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'epub' WHEN 2 THEN 'text' END AS format FROM pages")
def s12_detect_format(t: Tables):
    """Formats by paths' endings."""
    end = F.element_at(F.array(F.lit(".MD"), F.lit(".epub"), F.lit(".txt"), F.lit("/")), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", extract.detect_format(F.concat(F.lit("a.b/c"), end)).alias("format"))


@query("""
SELECT o_custkey AS doc, k AS number, 'Order ' || o_orderkey || ' due' AS title, 10 * k AS page, CASE WHEN lead(k) OVER (PARTITION BY o_custkey ORDER BY k) IS NOT NULL THEN CAST(10 * k + 9 AS VARCHAR) END AS last_page
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
""")
def s06_toc(t: Tables):
    """Printed tables of contents read back."""
    k = F.expr("row_number() over (partition by o_custkey order by o_orderkey)")
    rows = t.orders.select("o_custkey", "o_orderkey", k.alias("k"))
    page = (F.col("k") * 10).cast("string")
    line = F.concat(F.lit("Chapter "), F.col("k").cast("string"), F.lit(": Order "), F.col("o_orderkey").cast("string"), F.lit(" due"), F.when(F.col("k") % 2 == 0, F.concat(F.lit(" .... "), page)).otherwise(F.concat(F.lit("\n\n"), page)))
    texts = rows.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return extract.toc_entries(texts).select("doc", F.col("number").cast("long").alias("number"), "title", F.col("page").cast("long").alias("page"), F.col("last_page").cast("string").alias("last_page"))
