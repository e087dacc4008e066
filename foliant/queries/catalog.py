"""Mentions, evidence and companion addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import catalog
from foliant.queries.base import Tables, query

_N = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_FOUND = f"""SELECT doc, term, s AS char_start, s + length(term) AS char_end, sha256(term) AS span_sha256 FROM (SELECT doc, term, unnest(list_transform(range(1, len(x)), lambda k: CAST(list_sum(list_transform(x[1:k], lambda y: length(y))) + (k - 1) * length(term) AS BIGINT))) AS s
 FROM (SELECT doc_id AS doc, ' ' || term || ' ' AS term, string_split({_N}, ' ' || term || ' ') AS x FROM documents, (SELECT unnest(['was', 'für', 'dans']) AS term)))"""


def _mentions(t: Tables):
    norm = t.documents.select("doc_id", tx.normalize_ascii(F.col("text")).alias("norm"))
    terms = t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.array(*[F.lit(f" {x} ") for x in ("was", "für", "dans")])).alias("term"))
    return norm, catalog.mentions(norm, terms, "doc_id", "norm", 10**6)


@query(_FOUND)
def f06_mentions(t: Tables):
    """All places of terms in normalised texts."""
    return _mentions(t)[1].select("doc", "term", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "span_sha256")


@query(f"SELECT DISTINCT doc, char_start, 'EV-' || upper(substr(sha256(array_to_string([CAST(doc AS VARCHAR), 'r', CAST(char_start AS VARCHAR), CAST(char_end AS VARCHAR), span_sha256, 'summary'], chr(0))), 1, 20)) AS id FROM ({_FOUND})")
def f11_evidence_references(t: Tables):
    """Evidence references with content ids."""
    found = _mentions(t)[1]
    return catalog.evidence(found, F.col("doc").cast("string"), F.lit("r"), F.lit("summary")).select("doc", F.col("char_start").cast("long").alias("char_start"), "id")


@query(f"""
SELECT doc, char_start, CASE WHEN doc % 5 = 0 THEN 'missing_source' WHEN doc % 7 = 0 THEN 'out_of_bounds' WHEN doc % 11 = 0 THEN 'hash_mismatch' ELSE '' END AS reason FROM ({_FOUND})
""")
def v10_verify_evidence(t: Tables):
    """Evidence checked against its source; some is damaged first."""
    norm, found = _mentions(t)
    damaged = found.withColumn("char_end", F.when(F.col("doc") % 7 == 0, 10**7).otherwise(F.col("char_end"))).withColumn("span_sha256", F.when(F.col("doc") % 11 == 0, "0").otherwise(F.col("span_sha256")))
    checked = catalog.verify_evidence(damaged, norm.where("doc_id % 5 <> 0"), "doc_id", "norm")
    return checked.select("doc", F.col("char_start").cast("long").alias("char_start"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT host, path, query, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM (SELECT url FROM pages UNION ALL SELECT replace(url, 'https://', 'https://') || '#top' FROM pages WHERE page_id % 4 = 0) WHERE starts_with(url, 'https://')) GROUP BY ALL HAVING count(*) > 1")
def v06_duplicate_addresses(t: Tables):
    """Addresses that are the same once normalised; every fourth stands there with a fragment too."""
    urls = t.pages.select("url").unionByName(t.pages.where("page_id % 4 = 0").select(F.concat("url", F.lit("#top")).alias("url")))
    return catalog.duplicate_addresses(urls, "url").select("host", "path", "query", "n")


@query()
def f30_preferred_mention(t: Tables):
    """Of each document's mentions the one that a definition follows, or the first."""
    norm, found = _mentions(t)
    joined = found.join(norm.withColumnRenamed("doc_id", "doc"), "doc")
    return catalog.preferred(joined, ["doc", "term"], F.col("norm")).select("doc", "term", "char_start")


@query("SELECT page_id, regexp_extract(html, 'href=\"(https?://[^\"]+)\"', 1) AS first_link, len(regexp_extract_all(html, 'href=\"(https?://[^\"]+)\"', 1)) AS n_links FROM pages")
def f12_links(t: Tables):
    """Addresses that pages link to."""
    found = catalog.links(t.pages, "page_id", "html")
    return found.select("page_id", F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"), F.size("links").cast("long").alias("n_links"))
