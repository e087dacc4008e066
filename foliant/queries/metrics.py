"""Aggregations, orders, limits and set operations over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import records as fields
from foliant.operators import metrics as m
from foliant.operators import profiles, records
from foliant.operators.references import numbered
from foliant.queries.base import Tables, query


@query("""
SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, count(*) FILTER (length(trim(text)) = 0) AS n_empty,
 count(DISTINCT source) AS n_sources, max(length(text)) AS longest, count(*) FILTER (length(text) > 2000) AS n_long FROM documents GROUP BY lang
""")
def a01_content_metrics(t: Tables):
    """Counts and sizes by language."""
    return m.content_metrics(t.documents, ["lang"], "text", "source")


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def a02_state_pivot(t: Tables):
    """Total and counts by state."""
    return m.state_pivot(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


_LEDGER = "SELECT event_type AS module, count(*) AS total, count(*) FILTER (event_id % 9 = 0 AND event_type <> 'view') AS pending, count(*) FILTER (event_id % 9 <> 0 OR event_type = 'view') AS generated FROM events GROUP BY 1"


@query(f"SELECT coalesce(module, 'all') AS module, CAST(sum(total) AS BIGINT) AS total, CAST(sum(pending) AS BIGINT) AS pending FROM ({_LEDGER}) GROUP BY ROLLUP (module)")
def a03_ledger(t: Tables):
    """Work by module, and over all."""
    pending = (F.col("event_id") % 9 == 0) & (F.col("event_type") != "view")
    return m.ledger_summary(t.events, "event_type", pending).select("module", "total", "pending")


@query(f"SELECT module, CASE WHEN pending > 0 THEN 'incomplete' WHEN generated = total THEN 'fully_generated' ELSE 'fully_accounted' END AS state FROM ({_LEDGER})")
def a04_coverage_state(t: Tables):
    """Each module's coverage state."""
    pending = (F.col("event_id") % 9 == 0) & (F.col("event_type") != "view")
    rows = t.events.groupBy(F.col("event_type").alias("module")).agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("generated"))
    return rows.select("module", m.coverage_state(F.col("total"), F.col("pending"), F.col("generated")).alias("state"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type <> 'error') AS n_warning,
 count(*) FILTER (event_type = 'error' AND event_id % 3 <> 0) AS blocking FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'error' ELSE 'warning' END AS event_type FROM events) GROUP BY 1
""")
def a05_semantic_summary(t: Tables):
    """Findings by severity, and those that block because they aren't dismissed."""
    severity = F.when(F.col("event_type") == "purchase", "error").otherwise("warning")
    decision = F.when(F.col("event_id") % 3 == 0, "dismissed").when(F.col("event_id") % 3 == 1, "confirmed")
    return m.semantic_summary(t.events, ["user_id"], severity, decision, ["error", "warning"])


@query("""
SELECT lower(p_type) AS norm, p_brand AS chapter, min_by(p_name, p_partkey) AS label, len(list_distinct(list(p_partkey))) AS n_places,
 array_to_string(list_slice(list_sort(list_distinct(list(p_partkey))), 1, 3), ',') AS places, array_to_string(list_sort(list_distinct(list('r' || p_size % 3))), ',') AS reasons FROM part GROUP BY 1, 2
""")
def a06_catalog_items(t: Tables):
    """Mentions as items: first label, places (capped), reasons."""
    rows = t.part.select(F.lit("part").alias("kind"), F.lower("p_type").alias("norm"), F.col("p_brand").alias("chapter"), F.lit("").alias("url"), F.col("p_name").alias("label"), F.col("p_partkey").alias("pos"), F.concat(F.lit("r"), F.col("p_size") % 3).alias("reason"))
    return m.catalog_items(rows, 3).select("norm", "chapter", "label", F.col("n_places").cast("long").alias("n_places"), F.array_join("places", ",").alias("places"), F.array_join("reasons", ",").alias("reasons"))


@query("SELECT p_type, arg_min(p_name, p_partkey) AS label, arg_min(p_brand, p_partkey) AS chapter, min(p_partkey) AS first_place FROM part GROUP BY p_type")
def a07_term_collapse(t: Tables):
    """Terms over chapters: the earliest occurrence stands for all."""
    return m.first_by(t.part, ["p_type"], [F.col("p_partkey")], ["p_name", "p_brand", "p_partkey"]).select("p_type", F.col("p_name").alias("label"), F.col("p_brand").alias("chapter"), F.col("p_partkey").alias("first_place"))


@query("SELECT p_brand AS kind, count(*) AS n, count(*) FILTER (p_size < 5) AS unresolved FROM part GROUP BY 1")
def a08_kind_counters(t: Tables):
    """Counts and unresolved counts by kind."""
    return m.histogram(t.part, F.col("p_brand").alias("kind"), unresolved=F.col("p_size") < 5)


@query("SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) * 1.0 / nullif(count(*) FILTER (toxic = 0), 0) AS prec, count(*) FILTER (quality = 1 AND toxic = 0) * 1.0 / nullif(count(*) FILTER (quality = 1), 0) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a11_precision_recall(t: Tables):
    """Precision and recall from matched, observed and expected counts."""
    c = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("hit"), F.count_if(F.col("toxic") == 0).alias("seen"), F.count_if(F.col("quality") == 1).alias("due"))
    precision, recall = m.rates(F.col("hit"), F.col("seen"), F.col("due"))
    return c.select("lang", precision.alias("prec"), recall.alias("recall"))


@query("SELECT r_name, CAST(1 + count(n_nationkey) AS BIGINT) AS units FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def a12_structure_inventory(t: Tables):
    """Chapters and their sections."""
    return m.structure_inventory(t.region, t.nation, "r_regionkey", "n_regionkey", ["r_name"])


@query("SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (source IS NULL) AS unbound FROM documents")
def a13_gaps(t: Tables):
    """Gap counts: labels, context, sources."""
    known = t.labels.select("doc_id").distinct().withColumn("known", F.lit(True))
    gaps = {"unlabelled": F.col("known").isNull(), "short": F.length("text") < 100, "unbound": F.col("source").isNull()}
    return m.gap_counts(t.documents.join(known, "doc_id", "left"), gaps)


@query("SELECT l_returnflag, l_linestatus, l_linenumber, 'G-' || upper(substr(sha256(string_agg(CAST(l_orderkey AS VARCHAR), chr(0) ORDER BY l_orderkey)), 1, 16)) AS group_id, count(*) AS n FROM lineitem WHERE l_quantity = 1 GROUP BY 1, 2, 3")
def a14_authority_groups(t: Tables):
    """Units grouped by several keys, with an id from their ordered list."""
    return m.content_groups(t.lineitem.where("l_quantity = 1"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_orderkey").drop("units")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a15_decision_histogram(t: Tables):
    """Decisions counted."""
    return m.histogram(t.labels, "quality", "toxic")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars, CASE WHEN max(n_chars) > 10000 THEN 'review' WHEN count(*) > 40 THEN 'ready' ELSE 'open' END AS state FROM documents GROUP BY source")
def a16_section_statistics(t: Tables):
    """Sections' counts, distinct languages and state."""
    lattice = [(F.max("n_chars") > 10000, "review"), (F.count("*") > 40, "ready")]
    return m.section_statistics(t.documents, ["source"], {"langs": "lang"}, {"chars": "n_chars"}, lattice, "open")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, length(text) AS n_chars, round_even(100.0 * strlen(text) / 4096, 3) AS percent, strlen(text) >= 0.9 * 4096 AS warns FROM documents")
def a19_sizes(t: Tables):
    """Bytes, characters and use of a limit."""
    return t.documents.select("doc_id", *[c.alias(k) for k, c in m.sizes(F.col("text"), 4096).items()])


@query("SELECT source, bool_or(lang = 'de') AS any_german, bool_and(length(trim(text)) > 0) AS all_filled FROM documents GROUP BY source")
def a20_flags(t: Tables):
    """Any and all flags."""
    return m.flags(t.documents, ["source"], {"any_german": F.col("lang") == "de"}, {"all_filled": F.length(F.trim("text")) > 0})


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (text IS NOT NULL AND role <> 'user') AS answered, count(*) FILTER (text IS NULL OR role = 'user') AS depth FROM conversations GROUP BY conv_id")
def a21_session_summary(t: Tables):
    """Sessions and their queues' depth."""
    return m.session_summary(t.conversations, "conv_id", F.col("text").isNotNull() & (F.col("role") != "user"))


@query("""
SELECT doc_id, CAST(sum(CASE WHEN length(s) >= 8 AND contains(src, s) THEN length(s) ELSE 0 END) AS BIGINT) AS copied, count(*) AS n_strings, sum(CASE WHEN length(s) >= 8 AND contains(src, s) THEN length(s) ELSE 0 END) > 1000 OR count(*) > 200 AS risk
FROM (SELECT d.doc_id, lower(x.text) AS src, unnest(string_split(lower(d.text), '. ')) AS s FROM documents d JOIN documents x ON x.doc_id = d.doc_id - d.doc_id % 3) GROUP BY doc_id
""")
def a22_extractive_budget(t: Tables):
    """How much of a record's strings its source has verbatim."""
    x = t.documents.select(F.col("doc_id").alias("k"), F.lower("text").alias("src"))
    d = t.documents.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 3).alias("k"), F.explode(F.split(F.lower("text"), r"\. ")).alias("s"))
    return m.extractive_use(d.join(x, "k"), ["doc_id"], "s", "src").select("doc_id", F.col("copied").cast("long").alias("copied"), "n_strings", "risk")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_type, p_brand, p_size) > 1 AS conflict FROM part")
def a23_conflicts(t: Tables):
    """Units that share kind and title."""
    return t.part.select("p_partkey", m.conflicts(t.part, ["p_type", "p_brand", "p_size"]).alias("conflict"))


@query("""
SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS kind, arg_max(value, event_id) FILTER (event_id % 3 = 0) AS value, array_to_string(list(event_id ORDER BY event_id), ',') AS evidence FROM events GROUP BY user_id
""")
def a24_partial_updates(t: Tables):
    """Partial updates folded into one record."""
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.array(F.col("event_id").cast("string")).alias("evidence"))
    return m.latest_fields(rows, ["user_id"], "event_id", ["kind", "value"], ["evidence"]).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT o_orderkey, o_orderkey % 7 + 1 = coalesce(l, 0) AS consistent FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS l FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def a25_totals(t: Tables):
    """Whether parts' totals are the whole's."""
    return m.totals_match(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("o_orderkey") % 7 + 1).select("o_orderkey", "consistent")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type ILIKE 'a%' THEN 0 WHEN p_type ILIKE 's%' THEN 1 ELSE 2 END, lower(p_name), p_partkey) AS place FROM part")
def t01_catalog_order(t: Tables):
    """Catalogue order: rank of kind, then normalised label."""
    rank = m.rank_of(F.lower(F.substring("p_type", 1, 1)), ["a", "s"])
    return m.placed(t.part, ["p_brand"], [rank, F.lower("p_name"), "p_partkey"]).select("p_partkey", "place")


@query("SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) * 10000000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def t04_preferred(t: Tables):
    """The preferred occurrence: definition-like first, then earliest."""
    return m.first_by(t.orders, ["o_custkey"], [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.col("o_orderkey")], ["o_orderkey"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 = 3 ORDER BY event_id LIMIT 1")
def t07_next_item(t: Tables):
    """The next pending item, first in first out."""
    return m.next_pending(t.events, F.col("event_id") % 4 == 3, ["event_id"]).select("event_id", "event_type")


@query("SELECT n_nationkey, n_name FROM nation")
def t08_limits_fail(t: Tables):
    """A collection within its limit; beyond it the query fails."""
    return m.enforce_limit(t.nation.select("n_nationkey", "n_name"), 2000, "records")


@query("SELECT l_suppkey, array_to_string(list_slice(list_sort(list_distinct(list(l_orderkey))), 1, 200), ',') AS places, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_places FROM lineitem GROUP BY 1")
def t09_capped_places(t: Tables):
    """At most 200 places of an item, the first ones, and how many there are."""
    return m.capped_places(t.lineitem, ["l_suppkey"], "l_orderkey", 200).withColumn("places", F.array_join("places", ","))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10")
def t10_tail(t: Tables):
    """The last rows of a history."""
    return m.tail(t.events.select("user_id", "event_id"), ["user_id"], "event_id", 10)


@query("SELECT doc_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY p)) AS words_md5 FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) WHERE w <> '' GROUP BY 1, 2) GROUP BY doc_id")
def t11_ordered_distinct(t: Tables):
    """Distinct words of whole texts in order of their first place."""
    words = t.documents.select("doc_id", fields.ordered_distinct(F.split("text", " ")).alias("w"))
    return words.where("size(w) > 0").select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS reasons FROM documents GROUP BY source")
def t12_sorted_distinct(t: Tables):
    """Reason codes, distinct and sorted."""
    return m.sorted_distinct(t.documents, ["source"], "lang").select("source", F.array_join("codes", ",").alias("reasons"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(['kind', 'page', 'ref'], lambda k: NOT list_contains(json_keys(props), k))), ',') AS lacking, array_to_string(list_sort(list_filter(json_keys(props), lambda k: NOT list_contains(['kind', 'page', 'ref'], k))), ',') AS unexpected FROM events")
def u01_keys(t: Tables):
    """Keys that a record lacks, and that it shouldn't have."""
    lacking, unexpected = fields.key_differences(F.map_keys(F.from_json("props", "map<string,string>")), ["kind", "page", "ref"])
    return t.events.select("event_id", F.array_join(lacking, ",").alias("lacking"), F.array_join(unexpected, ",").alias("unexpected"))


@query("SELECT id, row_number() OVER (ORDER BY extra, id) AS place FROM (SELECT n_nationkey AS id, 0 AS extra FROM nation WHERE n_nationkey < 20 UNION SELECT s_nationkey, 1 FROM supplier WHERE s_nationkey >= 20)")
def u02_ordered_union(t: Tables):
    """The primary's ids, then those that only others have."""
    first = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"))
    extra = t.supplier.select(F.col("s_nationkey").alias("id")).distinct().join(first, "id", "left_anti")
    both = first.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
    return numbered(both, ["extra", "id"], "place").select("id", "place")


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AS is_subset, (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS is_covered")
def u06_set_checks(t: Tables):
    """Whether a set is part of another, and covers it."""
    return m.set_checks(t.nation.select("n_regionkey"), t.region.select("r_regionkey"))


@query("SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'unexpected' WHEN b.k IS NULL THEN 'missing' ELSE 'different' END AS state FROM (SELECT doc_id AS k, md5(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 25 = 0 THEN '' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 2) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h")
def u07_snapshots(t: Tables):
    """Files that two snapshots don't share byte by byte."""
    rows = t.documents.select(F.col("doc_id").alias("path"), F.md5("text").alias("h"))
    after = rows.where("path % 10 <> 2").withColumn("h", F.when(F.col("path") % 25 == 0, "").otherwise(F.col("h")))
    return m.snapshot_differences(rows.where("path % 10 <> 1"), after, "path", "h")


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def u08_shared_ids(t: Tables):
    """Ids that two runs share."""
    return m.shared_ids(t.documents.where("doc_id % 6 = 0"), t.documents.where("doc_id % 10 = 0"), "doc_id")


@query("""
SELECT label, chapter, origin FROM (SELECT *, row_number() OVER (PARTITION BY lower(label), chapter ORDER BY origin) AS k FROM (
 SELECT DISTINCT p_name AS label, p_brand AS chapter, 'deterministic' AS origin FROM part WHERE p_size < 20 UNION ALL SELECT DISTINCT upper(p_name), p_brand, 'generated' FROM part WHERE p_size < 40)) WHERE k = 1
""")
def u05_merge_sources(t: Tables):
    """Deterministic and generated records, one per normalised value and chapter, the deterministic first."""
    a = t.part.where("p_size < 20").select(F.col("p_name").alias("label"), F.col("p_brand").alias("chapter"), F.lit("deterministic").alias("origin"))
    b = t.part.where("p_size < 40").select(F.upper("p_name"), "p_brand", F.lit("generated"))
    rows = a.union(b).withColumn("norm", F.lower("label"))
    return m.first_by(rows, ["norm", "chapter"], [F.col("origin"), F.col("label")], ["label", "origin"]).select("label", "chapter", "origin")


@query("SELECT n_nationkey, kind FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'chapter' ELSE 'notes' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS summary FROM nation) WHERE summary IS NULL AND kind <> 'index'")
def p20_exempt_kinds(t: Tables):
    """Records without a summary, of a kind that needs one."""
    k = F.col("n_nationkey")
    rows = t.nation.select("n_nationkey", F.when(k % 3 == 0, "index").when(k % 3 == 1, "chapter").otherwise("notes").alias("kind"), F.when(k % 2 == 0, F.col("n_name")).alias("summary"))
    exempt = t.spark.createDataFrame([(f, x) for f, kinds in profiles.EXEMPT.items() for x in kinds.split()], "field string, kind string")
    return records.lacking_required(rows, "kind", "summary", exempt).select("n_nationkey", "kind")


@query("SELECT p_brand, CAST(p_partkey AS VARCHAR) AS part, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM part WHERE p_type LIKE 'S%' AND p_brand < 'Brand#4' UNION ALL SELECT p_brand, '', 0 FROM part GROUP BY p_brand HAVING count(*) FILTER (p_type LIKE 'S%' AND p_brand < 'Brand#4') = 0")
def p06_approved_rules(t: Tables):
    """Approved policies, numbered; a note where there are drafts alone."""
    return records.approved_rules(t.part.select("p_brand", "p_partkey", "p_type"), ["p_brand"], ["p_partkey"], F.col("p_type").like("S%") & (F.col("p_brand") < "Brand#4")).select("p_brand", F.coalesce(F.col("p_partkey").cast("string"), F.lit("")).alias("part"), "number")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'removed' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change, CASE WHEN o_orderkey % 13 <> 0 THEN array_to_string(list_filter(['o_orderstatus', 'o_totalprice'], lambda f: (f = 'o_orderstatus' AND o_orderkey % 2 = 0) OR (f = 'o_totalprice' AND o_orderkey % 3 = 0)), ',') ELSE 'o_orderstatus,o_totalprice,o_custkey' END AS changed FROM orders")
def p16_changed_fields(t: Tables):
    """Names of the fields that two versions of a record don't share."""
    k = F.col("o_orderkey")
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    new = old.where(k % 13 != 0).withColumns({"o_orderstatus": F.when(k % 2 == 0, "Z").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 3 == 0, 0.0).otherwise(F.col("o_totalprice"))})
    return records.changed_fields(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_custkey"]).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed"))


@query("SELECT lang, array_to_string(list_sort(list_distinct(list(module))), ',') AS modules FROM (SELECT DISTINCT lang, source AS module FROM documents UNION SELECT DISTINCT lang, 'map' FROM documents) WHERE module <> (SELECT min(source) FROM documents) GROUP BY lang")
def p17_effective_modules(t: Tables):
    """A profile's required modules with overrides added and taken away."""
    required = t.documents.select("lang", F.col("source").alias("module")).distinct()
    langs = t.documents.select("lang").distinct()
    first = t.documents.agg(F.min("source")).scalar()
    overrides = langs.select("lang", first.alias("module"), F.lit("remove").alias("mode")).unionByName(langs.select("lang", F.lit("map").alias("module"), F.lit("add").alias("mode")))
    return records.effective_modules(required, overrides, "lang", "module", "mode").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("module")), ",").alias("modules"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS n_claims, count(*) FILTER (lang = 'fr') AS n_names, count(*) FILTER (lang IN ('en', 'fr')) AS n_records FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def a18_trailer_counts(t: Tables):
    """How many records a pack has of each collection."""
    return m.trailer_counts({"claims": t.documents.where("lang = 'en'"), "names": t.documents.where("lang = 'fr'")}, ["source"])
