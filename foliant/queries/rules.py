"""Rules, projections, orders and states of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import hashing, text
from foliant.functions import records as fields
from foliant.operators import metrics as m
from foliant.operators import manifests, plans, profiles, records, schemas
from foliant.operators import references as ref
from foliant.operators import rules as r
from foliant.queries.base import Tables, query


#: A record with nested fields and a reference, as documents of this kind are described.
PART_SCHEMA = {
    "type": "object",
    "required": ["id", "name", "made"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "name": {"$ref": "#/$defs/line"},
        "made": {"type": "object", "required": ["brand"], "properties": {"brand": {"type": "string", "pattern": "^Brand#[1-3][1-5]$"}, "type": {"$ref": "#/$defs/line", "pattern": "^[A-L]"}}},
        "sizes": {"type": "array", "items": {"type": "integer", "maximum": 40}},
    },
    "$defs": {"line": {"type": "string", "maxLength": 22}},
}


@query("""
SELECT 'error' AS severity, code, CAST(p_partkey AS VARCHAR) || f AS path FROM (
 SELECT p_partkey, 'VS2' AS code, '.made.brand' AS f FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][1-5]')
 UNION ALL SELECT p_partkey, 'VS3', '.sizes[1]' FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'VS4', '.made.type' FROM part WHERE length(p_type) > 22 UNION ALL SELECT p_partkey, 'VS4', '.name' FROM part WHERE length(p_name) > 22 AND p_partkey % 10 <> 0
 UNION ALL SELECT p_partkey, 'VS2', '.made.type' FROM part WHERE NOT regexp_matches(p_type, '^[A-L]') UNION ALL SELECT p_partkey, 'VS5', '' FROM part WHERE p_partkey % 10 = 0)
""")
def v01_structure(t: Tables):
    """Records as JSON against a schema with nested fields and references."""
    record = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("made"), F.array(F.lit(1), "p_size").alias("sizes"))
    rows = t.part.select("p_partkey", F.to_json(record).alias("record"))
    codes = {"pattern": "VS2", "maximum": "VS3", "maxLength": "VS4", "required": "VS5"}
    return schemas.findings(rows, "p_partkey", "record", PART_SCHEMA, codes).select("severity", "code", "path")


@query("""
SELECT 'RP101' AS code, CAST(doc_id AS VARCHAR) || '/text' AS path FROM documents WHERE length(text) < 60
UNION ALL SELECT 'RP102', CAST(doc_id AS VARCHAR) || '/words' FROM documents WHERE len(list_distinct(string_split(text, ' '))) <> len(string_split(text, ' '))
UNION ALL SELECT 'RP103', CAST(doc_id AS VARCHAR) || '/n_chars' FROM documents WHERE n_chars <> length(text)
""")
def v02_record_rules(t: Tables):
    """Rules of meaning: lengths, repeated entries, stated sizes."""
    rows = t.documents.withColumn("words", F.split("text", " "))
    wrong = r.Rule("RP103", "n_chars", F.col("n_chars") != F.length("text"), "n_chars isn't the length")
    return r.findings(rows, "doc_id", [r.sized("RP101", "text", 60), r.unique_items("RP102", "words"), wrong]).select("code", "path")


@query("""
SELECT 'error' AS severity, 'RP300' AS code, doc_id FROM labels WHERE quality = 0 UNION ALL SELECT 'error', 'RP301', doc_id FROM labels WHERE toxic = 1
""")
def v03_release_rules(t: Tables):
    """Rules that are warnings until a release."""
    rules = [r.Rule("RP300", "quality", F.col("quality") == 0, "not approved", "warning"), r.Rule("RP301", "toxic", F.col("toxic") == 1, "not cleared", "warning")]
    found = r.findings(t.labels, "doc_id", rules, release=True)
    return found.select("severity", "code", F.split("path", "/")[0].cast("long").alias("doc_id"))


@query("""
SELECT source, metric, value, least, CASE WHEN metric = 'documents' THEN 'QP010' ELSE 'QP011' END AS code FROM (
 SELECT source, metric, value, CASE metric WHEN 'documents' THEN 12 ELSE 120000 END AS least FROM (SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1)
 UNPIVOT (value FOR metric IN (documents, chars))) WHERE value < least
""")
def v04_profile_contract(t: Tables):
    """Metrics below the floors of a quality profile."""
    values = t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
    floors = [profiles.Floor("documents", 12, "QP010"), profiles.Floor("chars", 120000, "QP011")]
    return profiles.below_floors(values, "source", floors).select("source", "metric", F.col("value").cast("long").alias("value"), F.col("least").cast("int").alias("least"), "code")


@query("SELECT lang FROM (SELECT lang, count(*) FILTER (quality = 1) * 1.0 / count(*) AS p, CASE WHEN lang = 'fr' THEN 0.5 ELSE count(*) FILTER (quality = 1) * 1.0 / count(*) END AS stated FROM documents JOIN labels USING (doc_id) GROUP BY lang) WHERE abs(p - stated) > 1e-12")
def v05_rederived_metrics(t: Tables):
    """Stated metrics that the evidence doesn't give again."""
    rows = t.documents.join(t.labels, "doc_id")
    evidence = rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("matched"), F.count("*").alias("observed"))
    stated = evidence.select("lang", F.when(F.col("lang") == "fr", 0.5).otherwise(F.col("matched") / F.col("observed")).alias("stated_precision"))
    return profiles.rederived_metrics(stated, evidence, "lang", "stated_precision", "matched", "observed").select("lang")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 6 = 0")
def v08_rederived_ids(t: Tables):
    """Items whose id isn't that of their content."""
    again = hashing.content_id("CI-", 20, F.col("n_name"), F.col("n_regionkey").cast("string"))
    rows = t.nation.withColumn("item_id", F.when(F.col("n_nationkey") % 6 == 0, "CI-0").otherwise(again))
    return r.rederived(rows, "n_nationkey", "item_id", again)


@query("""
SELECT 'CR04' AS code, event_id || '/review' AS path FROM events WHERE event_id % 4 = 0 AND event_type = 'click' UNION ALL SELECT 'CR05', event_id || '/evidence' FROM events WHERE event_id % 5 = 0
 UNION ALL SELECT 'CR02', event_id || '/qa' FROM events WHERE event_id % 11 = 0
""")
def v09_run_rules(t: Tables):
    """State, QA, review and evidence of a run's candidates."""
    k, accepted = F.col("event_id"), F.col("event_type") == "click"
    reviewed = accepted & (k % 4 != 0)
    sha = F.sha2("event_type", 256)
    rows = t.events.select(k.cast("string").alias("candidate_id"), F.when(accepted, "accepted").otherwise("ready").alias("state"), (k % 11 != 0).alias("qa_passed"), F.array().cast("array<string>").alias("reasons"), F.when(k % 5 != 0, 1).alias("n_evidence"), F.when(reviewed, "ann").alias("reviewer"), F.when(reviewed, "2026-01-02T03:04:05Z").alias("reviewed_at"), sha.alias("record_sha256"), sha.alias("stated_sha256"))
    return manifests.run_findings(rows).select("code", "path")


@query("SELECT module, stated, n FROM (SELECT event_type AS module, count(*) AS n, count(*) + (event_type = 'view')::INT AS stated FROM events GROUP BY 1) WHERE stated <> n")
def v11_ledger_summary(t: Tables):
    """Summaries of a ledger that its items don't give."""
    items = t.events.select(F.col("event_type").alias("module"))
    stated = items.groupBy("module").agg((F.count("*") + F.max((F.col("module") == "view").cast("int"))).alias("stated"))
    return m.summary_faults(items, ["module"], stated).select("module", "stated", "n")


@query("""
SELECT * FROM (VALUES ('AI01', 'M4/mode'), ('AI02', 'M1/file'), ('AI03', 'M2/reason'), ('AI03', 'M3/file'), ('AI04', 'M2'), ('AI04', 'M3'), ('AI04', 'M4')) v(code, path)
""")
def v12_exactly_one(t: Tables):
    """What a package says of its modules, against its records."""
    k = F.col("r_regionkey")
    mode = F.when(k < 2, "provided").when(k == 2, "omit").when(k == 3, "generate").otherwise("later")
    modules = t.region.select(F.concat(F.lit("M"), k).alias("module"), mode.alias("mode"), F.when(k.isin(0, 3), "x.csv").alias("file"), F.lit("").alias("reason"))
    records = t.nation.select(F.concat(F.lit("M"), "n_regionkey").alias("module"), F.col("n_name").alias("id"))
    return manifests.package_findings(modules, records).select("code", "path")


@query("""
SELECT 'AR02' AS code, c_custkey || '/reviewer' AS path FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 5 = 0 UNION ALL SELECT 'AR03', c_custkey || '/note' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 7 = 0
 UNION ALL SELECT 'AR05', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 20 = 0
""")
def v13_dependent_fields(t: Tables):
    """Decisions of a review without what they need, and history of another state."""
    k, sha = F.col("c_custkey"), F.sha2("c_name", 256)
    made = k % 3 != 2
    units = t.customer.select(k.cast("string").alias("unit_id"), F.when(k % 3 == 0, "approve").when(k % 3 == 1, "revise").otherwise("pending").alias("choice"), F.when(made & (k % 5 != 0), "ann").alias("reviewer"), F.when(made, "2026-01-02T03:04:05Z").alias("reviewed_at"), sha.alias("before_sha256"), F.when((k % 3 == 1) & (k % 7 != 0), "why").alias("note"))
    history = t.customer.where(k % 4 == 0).select(k.cast("string").alias("unit_id"), F.when(k % 20 == 0, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("before_sha256"), sha.alias("after_sha256"))
    return manifests.review_findings(units, history).select("code", "path")


@query("""
SELECT doc_id, CASE WHEN s + 5 > n THEN 'outside_chapter' ELSE 'value_not_held' END AS reason FROM (
 SELECT doc_id, instr(text, ' with') - 1 AS s, least(700, length(text)) AS n FROM documents WHERE instr(text, ' with') > 0) WHERE s + 5 > n OR doc_id % 7 = 0
""")
def v14_evidence_of_value(t: Tables):
    """Additions whose evidence lies outside its chapter, or doesn't hold the value."""
    at = F.locate(" with", F.col("text")) - 1
    found = t.documents.select("doc_id", at.alias("char_start")).where("char_start >= 0")
    additions = found.select("doc_id", F.lit(0).alias("chapter_id"), "char_start", (F.col("char_start") + 5).alias("char_end"), F.when(F.col("doc_id") % 7 == 0, "without").otherwise("WITH").alias("value"))
    spans = t.documents.select("doc_id", F.lit(0).alias("chapter_id"), F.lit(0).alias("char_first"), F.least(F.lit(700), F.length("text")).alias("char_last"))
    return ref.addition_faults(additions, spans, t.documents, "doc_id", "text", "value").select("doc_id", "reason")


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'RP500' ELSE 'RP502' END AS code FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 14 = 0")
def v15_state_against_data(t: Tables):
    """Records whose state doesn't fit: not there any more, or changed since."""
    data = t.customer.where("c_custkey % 9 <> 0").select("c_custkey", F.sha2("c_name", 256).alias("h"))
    states = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 14 == 0, "old").otherwise(F.sha2("c_name", 256)).alias("h"))
    return ref.state_faults(states, data, ["c_custkey"], "h")


@query("SELECT p_partkey, p_size > 10 AND p_size <= 40 AS bound FROM part")
def v17_binding(t: Tables):
    """Whether an inventory and a run name the same source and text."""
    held = t.part.select("p_partkey", F.sha2("p_name", 256).alias("source"), F.sha2("p_type", 256).alias("norm"))
    runs = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.sha2("p_name", 256)).alias("source"), F.when(F.col("p_size") <= 40, F.sha2("p_type", 256)).alias("norm"))
    return ref.binding(runs, held, "p_partkey", ["source", "norm"]).select("p_partkey", "bound")


@query("""
SELECT 'QA02' AS code, key || '/criticism' AS path FROM (SELECT conv_id || ':' || turn AS key, text FROM conversations WHERE role = 'user') WHERE length(trim(text)) < 60
 UNION ALL SELECT 'QA02', conv_id || ':' || turn || '/response' FROM conversations WHERE role = 'user' AND (conv_id % 7 = 0 OR length(trim(text)) < 60) UNION ALL SELECT 'QA05', conv_id || ':' || turn FROM conversations WHERE role = 'user' AND conv_id % 9 = 0
""")
def v18_plan_rules(t: Tables):
    """Questions whose facets say too little, or whose chapters aren't there."""
    k, said = F.col("conv_id"), F.col("text")
    both = F.create_map(F.lit("criticism"), said, F.lit("response"), said)
    asked = t.conversations.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("source_key"), F.lit("misreading").alias("kind"), F.array(F.when(k % 9 == 0, "CH-9").otherwise("CH-1")).alias("chapter_ids"), F.when(k % 7 == 0, F.create_map(F.lit("criticism"), said)).otherwise(both).alias("facets"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end"))
    chapters = t.region.select(F.lit("CH-1").alias("chapter_id")).distinct()
    return manifests.question_findings(asked, chapters, 60).select("code", "path")


@query("SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\"}') AS review_sha FROM nation")
def p02_review_projection(t: Tables):
    """A record without its review fields, hashed."""
    rows = t.nation.select("n_nationkey", "n_name", F.lit("draft").alias("status"), F.lit("x").alias("review_notes"))
    kept = rows.drop("status", "review_notes")
    return kept.select("n_nationkey", F.sha2(hashing.canonical_json(kept, ["n_name"]), 256).alias("review_sha"))


@query("""
SELECT event_id, 'draft' AS status, len(list_filter(json_keys(props), lambda k: k NOT IN ('page', 'ref'))) > 0 AS has_unknown,
 CAST(1 + len(list_filter(json_keys(props), lambda k: k IN ('page', 'ref'))) AS INT) AS n_kept FROM events
""")
def p03_allowed_fields(t: Tables):
    """Allowed fields kept, the status set to draft, unknown ones noted."""
    kept, unknown = fields.allowed_fields(F.from_json("props", "map<string,string>"), ["page", "ref"])
    return t.events.select("event_id", kept["status"].alias("status"), (F.size(unknown) > 0).alias("has_unknown"), F.size(kept).alias("n_kept"))


@query("""
SELECT source, lang, lang <> 'es' AND count(*) FILTER (length(text) > 500) = 0 AS unfilled FROM documents GROUP BY source, lang
""")
def p07_generation_gaps(t: Tables):
    """Modules that are to be generated and have no filled record; one language isn't generated."""
    modules = t.documents.select("source", "lang").distinct().withColumn("mode", F.when(F.col("lang") == "es", "provided").otherwise("generate"))
    return records.generation_gaps(modules, t.documents, ["source", "lang"], F.col("mode"), F.length("text") > 500).select("source", "lang", "unfilled")


@query("SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'view' AND user_id % 2 <> 0) AS dropped FROM events WHERE event_type <> 'view' OR user_id % 2 = 0")
def p10_actionable(t: Tables):
    """Items with a reference or a resolved chapter, and how many have neither."""
    kept, dropped = records.actionable(t.events, F.col("event_type") != "view", F.col("user_id") % 2 == 0)
    return kept.select("event_id", dropped.scalar().alias("dropped"))


@query("SELECT p_partkey, regexp_replace(p_name, '^(red|small|new) ', '') AS label FROM part WHERE p_type NOT IN (SELECT min(p_type) FROM part)")
def p11_stop_list(t: Tables):
    """Labels without a leading stop word, stop-listed ones left out."""
    stop = t.part.agg(F.min("p_type").alias("p_type"))
    kept = records.without_stop_words(t.part.select("p_partkey", "p_name", "p_type"), "p_type", stop, "p_type", [])
    return records.without_stop_words(kept, "p_name", stop.limit(0), "p_type", ["red", "small", "new"]).select("p_partkey", F.col("p_name").alias("label"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size = 5")
def p14_companions(t: Tables):
    """Records in which all declared fields have their companion's values."""
    return records.companions(t.part, {"p_brand": "Brand#11", "p_size": 5}).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 3 = 0")
def p15_review_scope(t: Tables):
    """Records of a review by module and id."""
    return records.in_scope(t.documents, "lang", ["en", "fr"], "doc_id", t.documents.where("doc_id % 3 = 0")).select("doc_id")


@query("SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents")
def p18_baseline(t: Tables):
    """Counts that a work item starts from."""
    return records.baseline(t.documents, ["doc_id"], {"n_chars": F.length("text"), "n_lines": F.size(F.split("text", "\n"))})


@query("SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 12)")
def p19_optional_sections(t: Tables):
    """Sections that have records."""
    return records.optional_sections(t.region, t.nation.where("n_nationkey > 12"), "r_regionkey", "n_regionkey").select("r_name")


@query("SELECT c_custkey, s FROM (SELECT c_custkey, unnest([c_custkey % 30, c_custkey % 17 + 20]) AS s FROM customer) WHERE s NOT IN (SELECT n_nationkey FROM nation)")
def j04_claim_references(t: Tables):
    """Entries of a second key list that no record has."""
    rows = t.customer.select("c_custkey", F.array(F.col("c_custkey") % 30, F.col("c_custkey") % 17 + 20).alias("keys"))
    return ref.missing_in_list(rows, "keys", t.nation, "n_nationkey").select("c_custkey", F.col("missing").alias("s"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def j11_finding_containment(t: Tables):
    """Findings whose work, candidate and evidence are all known."""
    work, candidates, evidence = t.orders.where("o_orderstatus = 'F'"), t.supplier.where("s_acctbal > 0"), t.part.where("p_size > 20")
    return ref.contained(t.lineitem, (work, "o_orderkey", "l_orderkey"), (candidates, "s_suppkey", "l_suppkey"), (evidence, "p_partkey", "l_partkey")).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size > 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j29_risks_without_replacement(t: Tables):
    """Ids at risk that no replacement covers."""
    done = t.lineitem.where("l_quantity > 45")
    return ref.missing(t.part.where("p_size > 30"), "p_partkey", done, "l_partkey").select("p_partkey")


@query("SELECT s_suppkey, CASE r_name WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 1 END AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j30_profile_lookup(t: Tables):
    """Contracts looked up in a small dimension table."""
    levels = t.region.where("r_name IN ('ASIA', 'EUROPE')").select("r_name", F.when(F.col("r_name") == "ASIA", 2).otherwise(3).alias("level"))
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return ref.looked_up(rows, levels, "r_name", {"level": 1}).select("s_suppkey", "level")


@query("SELECT n_nationkey, n_nationkey % 4 <> 0 AS current FROM nation")
def j31_current_bindings(t: Tables):
    """Snapshots whose hash is still the current one."""
    now = t.nation.select("n_nationkey", F.sha2("n_name", 256).alias("h"))
    then = t.nation.select("n_nationkey", F.sha2(F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")), 256).alias("h"))
    return ref.current_bindings(then, now, "n_nationkey", "h").select("n_nationkey", "current")


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type ORDER BY p_type")
def a10_kind_histogram(t: Tables):
    """Units by kind."""
    return m.histogram(t.part, F.col("p_type").alias("kind"))


@query("SELECT doc_id, n >= 20 AND single >= 0.7 * n AS glyph_spaced FROM (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: length(x) = 1)) AS single FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents))")
def a17_signature(t: Tables):
    """Whether most tokens of a text are single glyphs."""
    return t.documents.select("doc_id", m.glyph_signature(F.col("text")).alias("glyph_spaced"))


@query("SELECT doc_id, third FROM (SELECT doc_id, instr(substr(text, b), ' the ') + b - 2 AS third FROM (SELECT doc_id, text, instr(substr(text, a), ' the ') + a - 1 + 5 AS b FROM (SELECT doc_id, text, instr(text, ' the ') + 5 AS a FROM documents WHERE instr(text, ' the ') > 0) WHERE instr(substr(text, a), ' the ') > 0) WHERE instr(substr(text, b), ' the ') > 0)")
def w07_third_occurrence(t: Tables):
    """The third non-overlapping place of a needle."""
    at = F.get(text.positions(F.col("text"), F.lit(" the ")), F.lit(2))
    return t.documents.select("doc_id", at.cast("long").alias("third")).where("third IS NOT NULL")


@query("SELECT p_partkey, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS place FROM part")
def t06_longest_first(t: Tables):
    """Labels ordered longest first."""
    rows = t.part.select("p_partkey", (-F.length("p_name")).alias("k"))
    return ref.numbered(rows, ["k", "p_partkey"], "place").select("p_partkey", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END, 'n' || l_linenumber) AS place FROM lineitem")
def t03_finding_order(t: Tables):
    """Findings by path, numbers before names."""
    path = F.concat(F.lit("a/"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))))
    w = Window.partitionBy("l_orderkey").orderBy(r.order_key(F.col("path")))
    return t.lineitem.withColumn("path", path).select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_custkey) AS place FROM customer")
def t02_primary_first(t: Tables):
    """Packages ordered by a list of ranks, then by id."""
    return m.placed(t.customer, ["c_nationkey"], [m.rank_of(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]), "c_custkey"]).select("c_custkey", "place")


@query("SELECT r_regionkey, sha256(string_agg(sha256(n_name), '' ORDER BY n_nationkey)) AS manifest FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def d05_manifest(t: Tables):
    """A manifest's hash over its parts' hashes in order."""
    return plans.manifests(t.nation, ["n_regionkey"], "n_nationkey", "n_name").select(F.col("n_regionkey").alias("r_regionkey"), "manifest")


@query("SELECT n_nationkey AS path, 'different' AS state FROM nation WHERE n_nationkey % 8 = 3")
def d06_rebuild(t: Tables):
    """Files that a rebuild doesn't give again."""
    built = t.nation.select(F.col("n_nationkey").alias("path"), F.sha2("n_name", 256).alias("h"))
    there = built.withColumn("h", F.when(F.col("path") % 8 == 3, "0").otherwise(F.col("h")))
    return m.snapshot_differences(there, built, "path", "h")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 3 <> 0 THEN 'foreign' WHEN event_id % 2 = 0 THEN 'accepted' WHEN event_id % 5 = 0 THEN 'conflict' ELSE 'repeated' END AS outcome FROM events")
def m08_session_ingest(t: Tables):
    """What a session does with responses: taken, already there, of another request or to no item."""
    k = F.col("event_id")
    request = F.sha2(k.cast("string"), 256)
    items = t.events.where("event_id % 11 <> 0").select("event_id", request.alias("request"), F.when(k % 2 == 1, F.when(k % 5 == 0, "other").otherwise("text")).alias("response"))
    answers = t.events.select("event_id", F.when(k % 3 == 0, request).otherwise("x").alias("asked"), F.lit("text").alias("response"))
    return plans.ingest(items, answers, "event_id", "request", "asked", "response").select("event_id", "outcome")


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'misreading' WHEN 1 THEN 'clarification' ELSE 'unclassified' END AS kind FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)")
def m10_classify(t: Tables):
    """Items classified by key; the others stay unclassified."""
    first = t.conversations.where(F.col("turn") == t.conversations.agg(F.min("turn")).scalar()).select("conv_id")
    classes = first.distinct().select("conv_id", F.when(F.col("conv_id") % 3 == 0, "misreading").when(F.col("conv_id") % 3 == 1, "clarification").alias("kind")).where("kind IS NOT NULL")
    return plans.classified(first, classes, "conv_id", "kind").select("conv_id", "kind")


@query("SELECT source, bool_and(doc_id % 97 <> 0) AS ids, bool_and(length(text) > 20) AS texts, bool_and(doc_id % 97 <> 0) AND bool_and(length(text) > 20) AS signed FROM documents GROUP BY source")
def m13_sign_off(t: Tables):
    """Sections whose gates are all open."""
    return plans.signed_off(t.documents, ["source"], {"ids": F.col("doc_id") % 97 != 0, "texts": F.length("text") > 20})


@query("SELECT o_custkey, count(*) AS n_runs, sha256(string_agg(CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderkey)) AS receipt FROM orders GROUP BY 1")
def m14_receipt(t: Tables):
    """Receipts over the runs that led to a state."""
    return plans.receipts(t.orders, ["o_custkey"], "o_orderkey")


@query("""
SELECT event_id, CASE WHEN json_extract_string(props, '$.page') IS NULL THEN 'RP001' ELSE 'RP002' END AS code, 'events.' || event_id % 5 || '.page' AS path,
 CASE WHEN json_extract_string(props, '$.page') IS NULL THEN 'page is required' ELSE 'page is there' END AS message FROM events
""")
def f34_structured_errors(t: Tables):
    """Errors as a stable code, a dotted path and a message."""
    lacking = F.get_json_object("props", "$.page").isNull()
    keyword, said = F.when(lacking, "required").otherwise("const"), F.when(lacking, "page  is\n required").otherwise("page is there ")
    error = fields.structured_error([F.lit("events"), F.col("event_id") % 5, F.lit("page")], keyword, {"required": "RP001", "const": "RP002"}, said)
    return t.events.select("event_id", error.alias("e")).select("event_id", "e.code", "e.path", "e.message")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'revise' END AS choice FROM orders")
def f35_form_choices(t: Tables):
    """The one box that is ticked in a form; none or several are no choice."""
    box = lambda name, on: F.concat(F.lit("- ["), F.when(on, "x").otherwise(" "), F.lit(f"] {name}\n"))
    s = F.col("o_orderstatus")
    form = F.concat(box("approve", s.isin("F", "P")), box("revise", s.isin("O", "P")))
    return t.orders.select("o_orderkey", fields.form_choice(form, ["approve", "revise"]).alias("choice"))


@query("""
SELECT 'WL02' AS code, event_id || '/candidate_ids' AS path FROM events WHERE event_id % 6 = 0 UNION ALL SELECT 'WL03', event_id || '/reason_code' FROM events WHERE event_id % 2 = 1 AND event_id % 5 = 0
 UNION ALL SELECT 'WL05', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 4 = 0 AND event_id % 6 <> 0
""")
def v11_ledger_rules(t: Tables):
    """Work items whose end doesn't fit their candidates or reason."""
    k = F.col("event_id")
    made = (k % 2 == 0) & (k % 6 != 0)
    work = t.events.select(k.cast("string").alias("work_id"), F.when(k % 2 == 0, "generated").otherwise("not_applicable").alias("status"), F.when((k % 2 == 1) & (k % 5 != 0), "none").alias("reason_code"), F.when(made, F.array(k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("candidate_ids"))
    return manifests.ledger_findings(work, t.events.where("event_id % 4 <> 0").select(k.cast("string").alias("candidate_id"))).select("code", "path")
