"""Cross-site line deduplication by distinct-site spread (operator 6); DataFrame and SQL functions only.

A line with a word is boilerplate if it stands in documents of ``min_sites`` or
more distinct sites (``source``). Per line hash a HyperLogLog sketch of its
sites is built, partially on the map side, and merged by aggregation. Lines
whose estimate is clearly beyond the threshold are decided by it; those within
``band`` of the threshold get an exact distinct count. A boilerplate line stays
in the document with the smallest doc_id that has it and is removed from all
others; other lines and their order stay.

Defined results: a null text stays null; a null source is a site of its own; a
null doc_id's lines are never removed; rows that repeat a doc_id are treated
alike; an empty table gives no rows. Columns that aren't used are passed on.
A document may end up with an empty text: it stays a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import HOT_SHARE, materialise, spare_name, spread_join
from foliant.llm.quality import WHITE

MIN_SITES = 5
#: log2 of the sketch's buckets; its relative standard error is about 1.04 / sqrt(2^k).
SKETCH_BITS = 10


def _has_word(line):
    return F.length(F.translate(line, WHITE, "")) > 0


def line_places(docs: DataFrame) -> DataFrame:
    """doc_id, site and h (hash) of every line with a word, once a document."""
    site = F.coalesce(F.xxhash64(F.col("source").cast("string")), F.lit(0).cast("long"))
    each = F.filter(F.split(F.col("text").cast("string"), "\n"), _has_word)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("site"), F.transform(each, lambda x: F.xxhash64(x)).alias("hs"))
    return hashed.select("doc_id", "site", F.explode(F.array_distinct("hs")).alias("h"))


def boilerplate(places: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h (line hash), keeper (the smallest doc_id that has it), sites and documents of lines on ``min_sites`` or more sites."""
    number = places.count()
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << SKETCH_BITS) * min_sites))
    sketched = places.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"), F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"))
    wide = materialise(sketched.select("h", "keeper", "n", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - band), "lines-spread", rows=number)
    near = wide.where(F.col("estimate") <= min_sites + band)
    # Distinct first, partly on the map side: a near line has few sites, however many documents have it.
    exact = places.select("h", "site").distinct().join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("sites"))
    sure = wide.where(F.col("estimate") > min_sites + band).select("h", "keeper", F.col("estimate").alias("sites"), "n")
    return sure.unionByName(near.join(exact, "h").where(F.col("sites") >= min_sites).select("h", "keeper", "sites", "n"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id and the hashes of the lines to remove from it (no more than the document has)."""
    places = materialise(line_places(docs), "lines-places")
    number = places.count()
    found = materialise(boilerplate(places, min_sites), "lines-boilerplate", rows=number)
    # A line that very many documents hold would be one task's: the few such lines are broadcast.
    hot = [r["h"] for r in found.where(F.col("n") * HOT_SHARE > number).select("h").collect()]  # fewer than HOT_SHARE
    hits = spread_join(places, found.select("h", "keeper"), "h", hot).where(F.col("doc_id") != F.col("keeper"))
    return hits.groupBy("doc_id").agg(F.collect_set("h").alias("drop"))


def deduplicate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """The documents without the lines to remove; ``n_chars``, if there, follows.

    ``counts`` adds n_lines and n_removed.
    """
    key, drop, text = (spare_name(docs, x) for x in ("removal_id", "removal_lines", "text_kept"))
    found = removals(docs, min_sites).select(F.col("doc_id").alias(key), F.col("drop").alias(drop))
    # By shuffle at every size: a removal is a row per document, so its table grows with the corpus.
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(key), "left")
    kept = F.filter(F.split("text", "\n"), lambda line: ~(_has_word(line) & F.array_contains(drop, F.xxhash64(line))))
    out = joined.withColumn(text, F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    columns = [F.col(text).alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        before = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
        gone = F.when(F.col(drop).isNull(), F.lit(0).cast("long")).otherwise(before - F.size(kept))
        columns += [before.alias("n_lines"), gone.alias("n_removed")]
    return out.select(*columns)


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'none') AS site, text FROM documents),
lines AS (
  SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
kept AS (
  SELECT r, pos, line, keeper IS NULL OR doc_id IS NULL OR keeper = doc_id AS stays FROM lines LEFT JOIN spread USING (line)),
counted AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS text FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(counted.text, '')) AS text_md5
FROM docs LEFT JOIN counted USING (r)
"""
