"""Orders of lines, pages, occurrences; verbatim copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import references as ref
from foliant.operators import windows as w
from foliant.queries.base import Tables, query

_T = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, {_T} AS t FROM documents), b AS (SELECT item_id, {_T} AS t FROM benchmark),
 s AS (SELECT item_id, substr(t, p + 1, 80) AS w FROM (SELECT item_id, t, unnest(range(0, greatest(0, length(t) - 79), 80)) AS p FROM b))
SELECT DISTINCT doc_id, item_id FROM d JOIN s ON length(d.t) >= 160 AND contains(d.t, s.w)
""")
def w13_copy_pairs(t: Tables):
    """Documents that hold a window of a benchmark item verbatim."""
    return w.copy_pairs(t.documents, t.benchmark, "doc_id", "item_id")


@query("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 100000) - 1 AS last_page FROM orders")
def w01_page_ranges(t: Tables):
    """Pages of chapters: up to where the next starts."""
    return w.page_ranges(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", F.lit(100000))


@query("SELECT n_nationkey, 'CH-' || lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR), 2, '0') AS id FROM nation")
def w02_sequence_ids(t: Tables):
    """Chapter ids in order."""
    return w.sequence_ids(t.nation, ["n_regionkey"], ["n_nationkey"]).select("n_nationkey", "id")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) - 1 AS occurrence FROM part")
def w03_occurrences(t: Tables):
    """Which one of its equals each unit is."""
    return w.occurrence_numbers(t.part, ["p_type", "p_name"], ["p_partkey"]).select("p_partkey", F.col("occurrence").cast("long").alias("occurrence"))


_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query(f"SELECT doc_id, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 1000) AS stop FROM ({_LINES}) WHERE length(line) % 5 = 0")
def w04_extents(t: Tables):
    """Where sections end."""
    return w.extents(_lines(t).where("length(line) % 5 = 0").withColumn("end", F.lit(1000)), ["doc_id"], "pos", "end").select("doc_id", "pos", "stop")


@query(f"""
WITH h AS (SELECT doc_id, pos, length(line) % 4 + 1 AS lv FROM ({_LINES}))
SELECT a.doc_id, a.pos, a.lv, coalesce(min(b.pos), 1000) AS stop FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.lv <= a.lv GROUP BY 1, 2, 3
""")
def w05_outline_extents(t: Tables):
    """Where an outline's sections end: at the next heading of their level or above."""
    rows = _lines(t).select("doc_id", "pos", (F.length("line") % 4 + 1).cast("long").alias("lv"), F.lit(1000).alias("end"))
    return w.outline_extents(rows, ["doc_id"], "pos", "lv", "end").select("doc_id", "pos", "lv", F.col("stop").cast("long").alias("stop"))


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS gap FROM orders)
SELECT o_custkey, arg_max(o_orderkey, gap * 1000000 - o_orderkey) AS o_orderkey FROM g GROUP BY 1
""")
def w06_after_largest_gap(t: Tables):
    """The place behind the largest gap, by key."""
    return w.after_largest_gap(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id * 37 % 1000 AS p, max(event_id * 37 % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR p - b >= 32
""")
def w06_rising(t: Tables):
    """Places that rise by enough."""
    rows = t.events.select("user_id", "event_id", (F.col("event_id") * 37 % 1000).alias("p"))
    return w.rising(rows, ["user_id"], "event_id", "p").select("user_id", "event_id")


@query("SELECT page_id, row_number() OVER (PARTITION BY lower(split_part(url, '/', 3)) ORDER BY page_id) AS nth FROM pages")
def w08_running_index(t: Tables):
    """Which occurrence of its host each address is."""
    host = F.lower(F.split("url", "/")[2])
    return w.occurrence_numbers(t.pages.withColumn("host", host), ["host"], ["page_id"], "nth").select("page_id", (F.col("nth") + 1).cast("long").alias("nth"))


@query(f"SELECT doc_id, pos, s % 2 = 1 AND NOT f AS fenced FROM (SELECT doc_id, pos, length(line) % 7 = 0 AS f, sum((length(line) % 7 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM ({_LINES}))")
def w09_fence_parity(t: Tables):
    """Lines within fenced blocks."""
    return w.fence_parity(_lines(t), ["doc_id"], "pos", F.length("line") % 7 == 0).select("doc_id", "pos", "fenced")


@query(f"""
SELECT doc_id, pos, last_value(CASE WHEN n % 3 <> 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN n % 3 <> 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT doc_id, pos, CAST(length(line) AS VARCHAR) AS s, length(line) AS n FROM ({_LINES}))
""".replace("THEN n END", "THEN s END"))
def w10_neighbours(t: Tables):
    """The nearest token on either side that isn't skipped."""
    rows = _lines(t).withColumn("s", F.length("line").cast("string"))
    return w.neighbours(rows, ["doc_id"], "pos", "s", F.length("line") % 3 == 0).select("doc_id", "pos", "before", "after")


@query("SELECT l_orderkey, o AS ordinal FROM (SELECT l_orderkey, o, row_number() OVER (PARTITION BY l_orderkey ORDER BY o) - 1 AS place FROM (SELECT l_orderkey, l_linenumber - 1 + (l_linenumber > 3)::INT AS o FROM lineitem)) WHERE place <> o")
def w11_ordinals(t: Tables):
    """Parts whose ordinals aren't contiguous."""
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1 + (F.col("l_linenumber") > 3).cast("int")).alias("ordinal"))
    return w.broken_ordinals(rows, ["l_orderkey"], "ordinal").select("l_orderkey", "ordinal")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id AS s, event_id + event_id % 400 AS e, max(event_id + event_id % 400) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE s < coalesce(b, 0) OR e <= s
""")
def w12_overlaps(t: Tables):
    """Spans out of order, overlapping or empty."""
    rows = t.events.select("user_id", "event_id", (F.col("event_id") + F.col("event_id") % 400).alias("e"))
    return w.overlaps(rows, ["user_id"], "event_id", "e").select("user_id", "event_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY lang, source, doc_id) AS number FROM documents")
def w14_numbering(t: Tables):
    """Review units numbered over a total order."""
    return ref.numbered(t.documents.select("lang", "source", "doc_id"), ["lang", "source", "doc_id"], "number").select("doc_id", "number")


@query(f"""
SELECT doc_id, pos, page FROM (SELECT doc_id, pos, first_value(CASE WHEN length(line) % 4 = 0 THEN CAST(length(line) AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS page FROM ({_LINES}))
""")
def s07_nearby_page(t: Tables):
    """The first page number within nine lines."""
    rows = _lines(t)
    page = F.when(F.length("line") % 4 == 0, F.length("line").cast("string"))
    return rows.withColumn("page", w.nearby(rows, ["doc_id"], "pos", page)).select("doc_id", "pos", "page")


@query(f"SELECT doc_id, CAST(min(n) AS BIGINT) AS page FROM (SELECT doc_id, length(line) % 3 = 0 AS label, lead(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({_LINES})) WHERE label AND n IS NOT NULL GROUP BY doc_id")
def s08_labelled_page(t: Tables):
    """The least page right behind a label line."""
    return w.labelled(_lines(t), ["doc_id"], "pos", F.length("line") % 3 == 0, F.length("line").cast("long")).select("doc_id", F.col("found").alias("page"))
