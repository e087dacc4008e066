"""Sections, records, parts and rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import records as fields
from foliant.operators import layout
from foliant.queries.base import Tables, query

_SIZES = "SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents"


@query(f"""
WITH RECURSIVE z AS ({_SIZES}), r AS (SELECT source, doc_id, k, 1::BIGINT AS part, s AS used, s FROM z WHERE k = 1
 UNION ALL SELECT z.source, z.doc_id, z.k, CASE WHEN r.used + z.s + 400 <= 24576 THEN r.part ELSE r.part + 1 END, CASE WHEN r.used + z.s + 400 <= 24576 THEN r.used + z.s ELSE z.s END, z.s FROM r JOIN z ON z.source = r.source AND z.k = r.k + 1)
SELECT source, doc_id, part, s + 400 > 24576 AS over FROM r
""")
def d03_pack_parts(t: Tables):
    """Consecutive records packed into parts under a byte budget, wrapper counted."""
    return layout.pack_records(t.documents.select("source", "doc_id", "text"), ["source"], "doc_id", F.octet_length("text"), 24576, 400).select("source", "doc_id", "part", "over")


@query(f"SELECT source, doc_id, k - 1 AS ordinal, CAST(coalesce(sum(s) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM ({_SIZES})")
def d04_offsets(t: Tables):
    """Ordinals and byte offsets of parts."""
    return layout.offsets(t.documents.select("source", "doc_id", "text"), ["source"], "doc_id", F.octet_length("text")).select("source", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("offset").cast("long").alias("offset"))


_PACK = "SELECT r_regionkey, 'PACK | v=1' || chr(10) || string_agg('## ' || upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) || chr(10) || 'nation ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"


def _packs(t: Tables):
    line = F.concat(F.lit("## "), F.upper(F.regexp_replace("n_name", "[^A-Za-z]", "")), F.lit("\nnation "), F.col("n_nationkey").cast("string"))
    body = layout.render(t.nation, ["n_regionkey"], "n_nationkey", line)
    return body.select(F.col("n_regionkey").alias("r_regionkey"), F.concat(F.lit("PACK | v=1\n"), "text").alias("text"))


@query(f"SELECT r_regionkey, sha256(text) AS pack_sha, CAST(strlen(text) AS BIGINT) AS n_bytes FROM ({_PACK})")
def d07_render(t: Tables):
    """Records rendered to one text a group."""
    return _packs(t).select("r_regionkey", F.sha2("text", 256).alias("pack_sha"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""
SELECT n_regionkey AS r_regionkey, '' AS name, 0 AS ordinal, 'PACK | v=1' || chr(10) AS body FROM nation GROUP BY n_regionkey
UNION ALL SELECT n_regionkey, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')), row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '## ' || upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) || chr(10) || 'nation ' || n_nationkey || chr(10) FROM nation
""")
def d01_parse_pack(t: Tables):
    """Texts cut into their sections, which cover them exactly."""
    return layout.split_sections(_packs(t), "r_regionkey", "text").select("r_regionkey", "name", F.col("ordinal").cast("int").alias("ordinal"), "body")


@query("SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS ordinal, md5(unnest(string_split(text, chr(10)))) AS unit_md5 FROM documents")
def d02_record_units(t: Tables):
    """Indivisible units of a section: its lines."""
    return layout.record_units(t.documents, ["doc_id"], F.col("text"), "\n").select("doc_id", "ordinal", F.md5("unit").alias("unit_md5"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' (' || c_mktsegment || ')' AS text FROM customer")
def d08_template(t: Tables):
    """A template filled from records; a placeholder that is left would be an error."""
    return t.customer.select("c_custkey", layout.fill_template(F.lit("Customer {{name}} ({{segment}})"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id % 40 = 0 AND len(string_split(text, chr(10))) > 1")
def v16_verify_parts(t: Tables):
    """Texts that their parts don't give again; every fortieth loses one."""
    parts = t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "(?<=\n)")).alias("k", "b"))
    kept = parts.where("NOT (doc_id % 40 = 0 AND k = 0 AND n > 1)")
    return layout.verify_parts(kept, t.documents.select("doc_id", "text"), ["doc_id"], "k", "b", "text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 9 = 0 THEN 'conflict' ELSE 'same' END AS state FROM part")
def k04_publish(t: Tables):
    """What publishing immutable files by content does to each."""
    rows = t.part.select("p_partkey", F.sha2("p_name", 256).alias("h"))
    there = rows.where("p_partkey % 4 <> 0").withColumn("h", F.when(F.col("p_partkey") % 9 == 0, "other").otherwise(F.col("h")))
    return layout.publish(rows, there, "p_partkey", "h").select("p_partkey", "state")


@query("SELECT doc_id, sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def s14_fingerprints(t: Tables):
    """Fingerprints of contents."""
    return t.documents.select("doc_id", fields.fingerprint(F.col("text")).alias("f")).select("doc_id", F.col("f.sha256").alias("sha"), F.col("f.size_bytes").alias("n_bytes"))
