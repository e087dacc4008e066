"""References between records, pairs, duplicates, intervals, chains, trees, and their findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import references as ref
from foliant.queries.base import Tables, query


@query("""
SELECT c_custkey, m AS missing FROM (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 20]) AS m FROM customer)
WHERE m NOT IN (SELECT n_nationkey FROM nation)
""")
def j01_list_references(t: Tables):
    """Entries of key lists that no parent has."""
    rows = t.customer.select("c_custkey", F.array("c_nationkey", F.col("c_nationkey") + 20).alias("keys"))
    return ref.missing_in_list(rows, "keys", t.nation, "n_nationkey").select("c_custkey", "missing")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j02_references(t: Tables):
    """Rows whose key no other table has."""
    return ref.missing(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)")
def j03_optional_references(t: Tables):
    """The same where an empty key is allowed."""
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") + 10).alias("k"))
    return ref.missing(rows, "k", t.nation, "n_nationkey", optional=True).select("s_suppkey")


@query("""
WITH a AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey % 11 <> 0),
 b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 13 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'extra' WHEN b.id IS NULL THEN 'missing' WHEN a.v = b.v THEN 'paired' ELSE 'stale' END AS state FROM a FULL JOIN b ON a.id = b.id
""")
def j05_translation_pairs(t: Tables):
    """Records of two languages by id: paired, stale, missing or extra."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    second = rows.where("id % 13 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("v")))
    return ref.pair(rows.where("id % 11 <> 0"), second, ["id"], "v")


@query("""
WITH a AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation WHERE n_nationkey % 5 <> 4),
 b AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY CASE n_nationkey WHEN 2 THEN 3.5 ELSE n_nationkey END) AS p FROM nation WHERE n_nationkey % 5 <> 4)
SELECT a.id, a.p AS here, b.p AS there FROM a JOIN b USING (id) WHERE a.p <> b.p
""")
def j05_order_parity(t: Tables):
    """Ids whose place differs between two languages."""
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("pos")).where("id % 5 <> 4")
    moved = rows.withColumn("pos", F.when(F.col("id") == 2, 3.5).otherwise(F.col("pos")))
    return ref.in_order(rows, moved, "id", "pos").select("id", "here", "there")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NULL THEN 'unregistered' ELSE 'stale' END AS state
FROM lineitem LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0) ON l_suppkey = s_suppkey
WHERE s_suppkey IS NULL OR s_nationkey <> l_suppkey % 25
""")
def j06_provenance(t: Tables):
    """Records whose source isn't registered, or has another hash there."""
    records = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 25).alias("source_hash"))
    return ref.provenance_faults(records, t.supplier.where("s_suppkey % 10 <> 0"), "l_suppkey", "source_hash", "s_suppkey", "s_nationkey").select("l_orderkey", "l_linenumber", "state")


_SPANS = "SELECT doc_id, k * 700 AS f, least((k + 1) * 700, length(text)) AS l, k AS chapter FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM documents)"


@query(f"""
WITH spans AS ({_SPANS}), points AS (SELECT doc_id, instr(text, ' the ') - 1 AS s FROM documents WHERE instr(text, ' the ') > 0 UNION ALL SELECT doc_id, 697 AS s FROM documents WHERE length(text) > 720)
SELECT points.doc_id, s, CASE WHEN count(chapter) = 1 THEN CAST(max(chapter) AS VARCHAR) ELSE '' END AS chapter FROM points LEFT JOIN spans ON points.doc_id = spans.doc_id AND f <= s AND s + 5 <= l GROUP BY points.doc_id, s
""")
def j07_containing_chapter(t: Tables):
    """The chapter that holds each occurrence; none if it crosses a border."""
    docs = t.documents
    n = F.ceil(F.length("text") / 700).cast("long")
    spans = docs.where("length(text) > 0").select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chapter"))
    spans = spans.select("doc_id", (F.col("chapter") * 700).alias("f"), F.least((F.col("chapter") + 1) * 700, F.col("n")).alias("l"), "chapter")
    at = docs.select("doc_id", (F.locate(" the ", F.col("text")) - 1).cast("long").alias("s")).where("s >= 0").union(docs.where("length(text) > 720").select("doc_id", F.lit(697).cast("long")))
    return ref.containing(at.withColumn("e", F.col("s") + 5), spans, ["doc_id"], "s", "e", "f", "l", "chapter").select("doc_id", "s", F.coalesce(F.col("chapter").cast("string"), F.lit("")).alias("chapter")).distinct()


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unmatched' WHEN c_mktsegment = 'BUILDING' OR c_custkey % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM customer
""")
def j08_base_records(t: Tables):
    """Candidates beside their base records, by equal structure."""
    k = F.col("c_custkey")
    base = t.customer.where(k % 5 != 0).select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 7 == 0, None).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return ref.base_states(t.customer, base, ["c_custkey"], ["c_mktsegment", "c_nationkey"]).select("c_custkey", "state")


@query("""
SELECT e.event_id, w.work FROM events e JOIN (SELECT DISTINCT event_type AS module, user_id % 20 AS scope, event_type || ':' || user_id % 20 AS work FROM events) w
ON e.event_type = w.module AND (w.scope = 0 AND e.event_id % 3 = 0 OR list_contains([e.user_id % 20, e.event_id % 20], w.scope) AND e.event_id % 3 <> 0)
""")
def j09_work_matches(t: Tables):
    """Candidates with the work items whose module and scope they fit (whole book: no chapters)."""
    work = t.events.select(F.col("event_type").alias("module"), (F.col("user_id") % 20).alias("scope")).distinct().withColumn("work", F.concat_ws(":", "module", "scope"))
    chapters = F.when(F.col("event_id") % 3 != 0, F.array(F.col("user_id") % 20, F.col("event_id") % 20)).otherwise(F.array().cast("array<bigint>"))
    rows = t.events.select("event_id", "event_type", chapters.alias("chapters"))
    return ref.work_matches(rows, work, "event_type", "chapters", "module", "scope", 0).select("event_id", "work")


@query("""
WITH a AS (SELECT c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 50 = 1 THEN 'twin' ELSE lower(c_name) END AS title FROM customer),
 b AS (SELECT c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 9 = 0 THEN 'same title' WHEN c_custkey = 1 THEN 'twin' ELSE lower(c_name) END AS title FROM customer WHERE c_custkey % 6 <> 0),
 one AS (SELECT kind, title, min(id) AS m, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT a.id, m, n FROM a LEFT JOIN one ON a.kind = one.kind AND a.title = one.title)
SELECT id, CASE WHEN n = 1 AND count(*) OVER (PARTITION BY m) = 1 THEN CAST(m AS VARCHAR) ELSE '' END AS matched, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN count(*) OVER (PARTITION BY m) > 1 THEN 'reused' ELSE 'matched' END AS state FROM j
""")
def j12_merge_match(t: Tables):
    """Units matched by kind and normalised title: several are ambiguous, one that is matched twice is reused."""
    k = F.col("c_custkey")
    units = t.customer.select(k.alias("id"), F.col("c_mktsegment").alias("kind"), F.when(k % 50 == 1, " Twin ").otherwise(F.col("c_name")).alias("title"))
    there = t.customer.where(k % 6 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("kind"), F.when(k % 9 == 0, "Same  title").when(k == 1, "twin").otherwise(F.col("c_name")).alias("title"))
    return ref.merge_match(units, there, "id", "kind", "title").withColumn("matched", F.coalesce(F.col("matched").cast("string"), F.lit("")))


@query("""
SELECT a.n_name AS first_name, b.s_name AS second_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) a
JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) b USING (k)
""")
def j13_zip(t: Tables):
    """Records of two collections by their places."""
    a = ref.numbered(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "k")
    b = ref.numbered(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], "k")
    return a.join(b, "k").select(F.col("n_name").alias("first_name"), F.col("s_name").alias("second_name"))


@query("""
SELECT r_name AS title, string_agg(n_name, '|' ORDER BY n_nationkey) AS sections, 0 AS deeper FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name
""")
def j14_two_levels(t: Tables):
    """Top units with their children in order."""
    top = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("u"), F.lit(None).cast("string").alias("up"), F.col("r_regionkey").alias("o"), F.col("r_name").alias("title"))
    low = t.nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), "n_nationkey", "n_name")
    return ref.two_levels(top.union(low), "u", "up", "o", "title").where("size(sections) > 0").select("title", F.array_join("sections", "|").alias("sections"), F.col("deeper").cast("int").alias("deeper"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem) AS sold, p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) AS large_brand FROM part")
def j15_existence_flags(t: Tables):
    """Whether other collections mention a record, as flags."""
    others = {"sold": (t.lineitem, "l_partkey", "p_partkey"), "large_brand": (t.part.where("p_size > 49"), "p_brand", "p_brand")}
    return ref.existence_flags(t.part.select("p_partkey", "p_brand"), others).select("p_partkey", "sold", "large_brand")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 2 = 0 THEN 'seed' ELSE 'recall' END AS origin FROM customer")
def j16_seed_or_recall(t: Tables):
    """Candidates that the inventory has by normalised value and chapter, and those it hasn't."""
    inventory = t.customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("value"), "c_nationkey")
    return ref.seed_or_recall(t.customer.select("c_custkey", F.col("c_mktsegment").alias("value"), "c_nationkey"), inventory, "value", "c_nationkey").select("c_custkey", "origin")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'none' ELSE sha256(c_name) END AS source_hash, CASE WHEN c_custkey % 8 = 0 THEN 'draft' ELSE 'reviewed' END AS translation_status FROM customer
""")
def j17_relink(t: Tables):
    """Translations linked to the current primary hash; those that moved are drafts again."""
    k, h = F.col("c_custkey"), F.sha2("c_name", 256)
    primary = t.customer.where(k % 10 != 1).select("c_custkey", h.alias("h"))
    second = t.customer.select("c_custkey", F.when(k % 10 == 1, "none").when(k % 8 == 0, "old").otherwise(h).alias("source_hash"), F.lit("reviewed").alias("translation_status"))
    return ref.relinked(second, primary, ["c_custkey"], "source_hash", "h", "translation_status")


@query("""
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'missing' WHEN turn % 4 = 3 THEN 'stale' ELSE 'current' END AS state, CASE WHEN conv_id % 5 = 0 THEN 'digest,size' WHEN turn % 4 = 3 THEN 'digest,size' ELSE '' END AS stale FROM conversations WHERE role = 'assistant'
""")
def j18_stale_facets(t: Tables):
    """Planned turns joined to the source read again: the facets that moved."""
    text = F.col("text")
    facets = lambda rows, c: rows.select("conv_id", "turn", F.sha2(c, 256).alias("digest"), F.length(c).alias("size"))
    plan = facets(t.conversations.where("role = 'assistant'"), text)
    again = facets(t.conversations.where("conv_id % 5 <> 0"), F.when(F.col("turn") % 4 == 3, F.concat(text, F.lit("!"))).otherwise(text))
    return ref.facet_states(plan, again, ["conv_id", "turn"], ["digest", "size"]).select("conv_id", "turn", "state", F.array_join("stale", ",").alias("stale"))


@query("""
WITH a AS (SELECT conv_id AS k, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id AS k, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_targets, coalesce(b.n, 0) AS n_answers FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1
""")
def j19_coverage(t: Tables):
    """Conversations whose question isn't answered exactly once."""
    rows = t.conversations.withColumn("k", F.col("conv_id"))
    return ref.coverage_faults(rows.where("role = 'user'"), rows.where("role = 'assistant'"), "k")


@query("SELECT text_md5, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def j20_duplicate_identity(t: Tables):
    """Contents that are registered under several ids."""
    return ref.duplicates(t.documents.select("doc_id", F.md5("text").alias("text_md5")), "text_md5", distinct="doc_id")


@query("""
SELECT o_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'revise' WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'pending' END AS decision FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def j21_decisions(t: Tables):
    """Group decisions fanned out to units; a unit's own decision comes first."""
    groups = t.orders.select(F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "approve").alias("choice"))
    units = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.when(F.col("l_linenumber") == 3, "revise").alias("own"))
    return ref.decided(units, groups, ["o_orderkey"], "own", "choice").select("o_orderkey", "l_linenumber", "decision")


@query("""
SELECT id, lang FROM (SELECT DISTINCT source AS id FROM documents), (SELECT unnest(['en', 'fr', 'xx']) AS lang) EXCEPT SELECT source, lang FROM documents
""")
def j22_all_languages(t: Tables):
    """Ids that lack a record in some required language."""
    wanted = ref.grid(t.documents.select(F.col("source").alias("id")).distinct(), ["en", "fr", "xx"], "lang")
    return wanted.join(t.documents.select(F.col("source").alias("id"), "lang").distinct(), ["id", "lang"], "left_anti").select("id", "lang")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id * 2 + (event_id % 50 = 0)::INT AS after, coalesce(lead(event_id * 2) OVER w, -1) AS nxt,
 lead(event_id) OVER w IS NULL AS is_last, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE NOT is_last AND after <> event_id * 2 OR is_last AND after <> event_id * 2
""")
def j23_continuity(t: Tables):
    """Runs whose outcome isn't where the next one starts."""
    nxt = F.expr("lead(event_id) over (partition by user_id order by event_id)")
    runs = t.events.select("user_id", "event_id", (F.col("event_id") * 2).alias("before"), nxt.alias("nxt"))
    good = F.coalesce(F.col("nxt") * 2, F.lit(-1))
    runs = runs.withColumn("after", good + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0))
    return ref.continuity(runs, ["user_id"], "event_id", "before", "after", F.lit(-1)).select("user_id", "event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 3 AS b, (event_id + 1) % 3 AS a FROM events),
 r AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS head, 0 AS applied FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT r.user_id, e.k, CASE WHEN e.b = r.head THEN e.a ELSE r.head END, r.applied + (e.b = r.head)::INT FROM r JOIN e ON r.user_id = e.user_id AND e.k = r.k + 1)
SELECT user_id, max_by(head, k) AS head, max_by(applied, k) AS applied FROM r GROUP BY user_id
""")
def j24_hash_chain(t: Tables):
    """States after following edits whose before-state is the current one."""
    edits = t.events.select("user_id", "event_id", (F.col("event_id") % 3).alias("b"), ((F.col("event_id") + 1) % 3).alias("a"))
    return ref.follow_chain(edits, ["user_id"], "event_id", "b", "a", F.lit(0).cast("long"))


@query("""
SELECT p_partkey, p_size > 10 AND p_partkey % 4 <> 0 AS bulk FROM part
""")
def j25_bulk_eligible(t: Tables):
    """Units bound to an authority and a state, as a flag."""
    k, h = F.col("p_partkey"), F.sha2("p_name", 256)
    units = t.part.select("p_partkey", h.alias("own"))
    states = t.part.where("p_size > 10").select("p_partkey", h.alias("held"))
    provided = t.part.select("p_partkey", F.when(k % 4 == 0, "other").otherwise(h).alias("given"))
    return ref.bulk_eligible(units, states, provided, "p_partkey", "own", "held", "given").select("p_partkey", "bulk")


@query(f"""
WITH spans AS ({_SPANS}) SELECT doc_id, CAST(chapter AS INT) AS chapter, coalesce(s >= f AND s + 5 <= l, false) AS inside FROM (SELECT doc_id, instr(text, ' with') - 1 AS s, doc_id % 2 AS chapter FROM documents WHERE instr(text, ' with') > 0) LEFT JOIN spans USING (doc_id, chapter)
""")
def j26_evidence_in_chapter(t: Tables):
    """Whether evidence lies within the chapter that it is said to be from."""
    evidence = t.documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("chapter"), (F.locate(" with", F.col("text")) - 1).alias("s")).where("s >= 0").withColumn("e", F.col("s") + 5)
    n = F.length("text")
    spans = t.documents.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(700))).alias("chapter", "f"), n.alias("n"))
    spans = spans.select("doc_id", "chapter", "f", F.least(F.col("f") + 700, "n").alias("l"))
    return ref.within_span(evidence, spans, ["doc_id", "chapter"], "s", "e", "f", "l").select("doc_id", "chapter", "inside")


@query("""
SELECT o.o_custkey, o.at, (SELECT min(CAST(date_diff('day', DATE '1992-01-01', CAST(x.o_orderdate AS DATE)) AS BIGINT)) FROM orders x WHERE x.o_custkey = o.o_custkey AND date_diff('day', DATE '1992-01-01', CAST(x.o_orderdate AS DATE)) >= o.at) AS pos
FROM (SELECT c_custkey AS o_custkey, 1000 AS at FROM customer) o
""")
def j27_next_occurrence(t: Tables):
    """The first occurrence at or after a place, per key."""
    events = t.orders.select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("pos"))
    wanted = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(1000).cast("long").alias("at"))
    return ref.next_at_or_after(wanted, events, ["o_custkey"], "at", "pos").withColumn("at", F.col("at").cast("int"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j28_required_questions(t: Tables):
    """Documents that still lack a good label."""
    return ref.missing(t.documents, "doc_id", t.labels.where("quality = 1"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang, module FROM (SELECT doc_id, lang FROM documents), (SELECT unnest(['map', 'terms', 'claims']) AS module)")
def j32_work_grid(t: Tables):
    """Every module for every scope."""
    return ref.grid(t.documents.select("doc_id", "lang"), ["map", "terms", "claims"], "module")


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def a09_duplicate_ids(t: Tables):
    """Keys that several rows have."""
    return ref.duplicates(t.orders, "o_custkey", "o_orderdate")


@query("SELECT key, count(*) AS n FROM (SELECT 'E' || event_id AS key FROM events UNION ALL SELECT 'E' || doc_id FROM documents WHERE doc_id % 100 = 0) GROUP BY key HAVING count(*) > 1")
def a09_ids_across_collections(t: Tables):
    """Ids that occur in more than one collection."""
    one = t.events.select(F.concat(F.lit("E"), "event_id").alias("key")).unionByName(t.documents.where("doc_id % 100 = 0").select(F.concat(F.lit("E"), "doc_id").alias("key")))
    return ref.duplicates(one, "key")


@query("SELECT c_name, c_nationkey, count(*) AS n FROM (SELECT c_name, c_nationkey FROM customer UNION ALL SELECT c_name, c_nationkey FROM customer WHERE c_custkey % 17 = 0) GROUP BY ALL HAVING count(*) > 1")
def u09_identity_unique(t: Tables):
    """Identity tuples that aren't unique."""
    rows = t.customer.select("c_name", "c_nationkey", "c_custkey")
    return ref.duplicates(rows.union(rows.where("c_custkey % 17 = 0")), "c_name", "c_nationkey")


@query("""
SELECT 'error' AS severity, 'RP110' AS code, CAST(c_custkey AS VARCHAR) AS path, 'no order' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'error', 'RP120', text_md5, 'same content' FROM (SELECT md5(text) AS text_md5 FROM documents) GROUP BY text_md5 HAVING count(*) > 1
UNION ALL SELECT CASE WHEN p_size > 45 THEN 'error' ELSE 'warning' END, 'RP130', CAST(p_partkey AS VARCHAR), 'size ' || p_size FROM part WHERE p_size > 40
""")
def u10_findings(t: Tables):
    """Findings of several checks in one relation."""
    orphans = ref.findings(ref.missing(t.customer, "c_custkey", t.orders, "o_custkey"), "error", "RP110", F.col("c_custkey"), "no order")
    same = ref.findings(ref.duplicates(t.documents.select(F.md5("text").alias("m")), "m"), "error", "RP120", F.col("m"), "same content")
    large = ref.findings(t.part.where("p_size > 40"), F.when(F.col("p_size") > 45, "error").otherwise("warning"), "RP130", F.col("p_partkey"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return ref.union(orphans, same, large)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 IN (7, 8)")
def v07_cycles(t: Tables):
    """Units whose parents lead in a circle."""
    k = F.col("c_custkey")
    parent = F.when(k % 10 == 7, k + 1).when(k % 10 == 8, k - 1).when(k % 10 != 0, F.when(k >= 10, k - k % 10))
    return ref.cyclic(t.customer.select(k, parent.alias("up")), "c_custkey", "up")
