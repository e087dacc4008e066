"""Upserts, reconciliation, transitions and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import records as fields
from foliant.operators import plans
from foliant.queries.base import Tables, query

_UPSERT = """
WITH a AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0),
 j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS k, a.v AS o, b.v AS n, CASE coalesce(a.c_custkey, b.c_custkey) % 4 WHEN 0 THEN 'provided' WHEN 1 THEN 'augment' WHEN 2 THEN 'omit' ELSE 'generate' END AS mode FROM a FULL JOIN b ON a.c_custkey = b.c_custkey),
 r AS (SELECT k, CASE WHEN n IS NOT NULL AND mode IN ('provided', 'augment') THEN n ELSE o END AS v,
  CASE WHEN n IS NOT NULL AND mode IN ('provided', 'augment') AND o IS NULL THEN 'added' WHEN n IS NOT NULL AND mode IN ('provided', 'augment') AND o <> n THEN 'replaced'
   WHEN o IS NOT NULL AND (mode = 'omit' OR mode = 'provided' AND n IS NULL) THEN 'removed' WHEN o IS NOT NULL THEN 'preserved' END AS change FROM j)
"""


def _upserted(t: Tables):
    now = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_mktsegment").alias("v"))
    package = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, "new").otherwise(F.col("c_mktsegment")).alias("v"))
    k = F.col("c_custkey") % 4
    mode = F.when(k == 0, "provided").when(k == 1, "augment").when(k == 2, "omit").otherwise("generate")
    return plans.upsert(now, package, mode, ["c_custkey"], "v")


@query(_UPSERT + "SELECT k AS c_custkey, v FROM r WHERE change IS NOT NULL AND change <> 'removed'")
def u03_upsert_modes(t: Tables):
    """The next records of modules that are provided, augmented, omitted or generated."""
    return _upserted(t).where("change <> 'removed'").select("c_custkey", "v")


@query(_UPSERT + "SELECT change, count(*) AS n, min(k) AS first_key FROM r WHERE change IS NOT NULL GROUP BY change")
def u04_change_sets(t: Tables):
    """Added, replaced, removed and preserved records."""
    return _upserted(t).groupBy("change").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("""
WITH w AS (SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'generated' ELSE 'failed' END AS s FROM events WHERE event_id % 10 <> 0),
 r AS (SELECT event_id AS k, CASE WHEN event_id % 11 = 0 THEN 'running' WHEN event_id % 2 = 0 THEN 'generated' ELSE 'failed' END AS s FROM events WHERE event_id % 4 <> 1),
 j AS (SELECT coalesce(w.k, r.k) AS event_id, w.s AS s, CASE WHEN w.k IS NULL THEN 'unknown' WHEN r.k IS NULL THEN 'kept' WHEN r.s = 'running' THEN 'invalid' WHEN w.s = 'pending' THEN 'applied' WHEN w.s = r.s THEN 'replayed' ELSE 'conflict' END AS outcome, r.s AS rs FROM w FULL JOIN r ON w.k = r.k)
SELECT event_id, CASE WHEN outcome = 'applied' THEN rs ELSE s END AS status, outcome FROM j
""")
def j10_reconcile(t: Tables):
    """Results merged into a work ledger."""
    k = F.col("event_id")
    work = t.events.where("event_id % 10 <> 0").select("event_id", F.when(k % 3 == 0, "pending").when(k % 3 == 1, "generated").otherwise("failed").alias("status"))
    results = t.events.where("event_id % 4 <> 1").select("event_id", F.when(k % 11 == 0, "running").when(k % 2 == 0, "generated").otherwise("failed").alias("status"))
    return plans.reconcile(work, results, "event_id")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN nxt IN ('quarantined', 'ready') WHEN 1 THEN nxt = 'rejected' WHEN 2 THEN nxt IN ('accepted', 'rejected') WHEN 3 THEN nxt IN ('applying', 'rejected') ELSE nxt IN ('applied', 'accepted') END AS allowed
FROM (SELECT event_id, ['proposed', 'quarantined', 'ready', 'accepted', 'applying', 'applied', 'rejected'][event_id % 7 + 1] AS nxt FROM events)
""")
def m02_transitions(t: Tables):
    """Which changes of a candidate's state are allowed."""
    states = F.array(*[F.lit(x) for x in ("proposed", "quarantined", "ready", "accepted", "applying", "applied", "rejected")])
    before, after = F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")), F.element_at(states, (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", plans.may_follow(before, after).alias("allowed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'undo' WHEN 1 THEN 'commit' ELSE 'error' END AS step FROM orders")
def m03_recovery(t: Tables):
    """What transactions that were cut off need."""
    before, after = F.sha2(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")), 256)
    k = F.col("o_orderkey") % 3
    now = F.when(k == 0, before).when(k == 1, after).otherwise("c")
    return t.orders.select("o_orderkey", plans.recovery(now, before, after).alias("step"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' WHEN doc_id % 6 = 0 THEN 'dismissed' END AS decision, doc_id % 12 = 0 AS refused FROM labels")
def m09_adjudicate(t: Tables):
    """Decisions on findings, entered once."""
    findings = t.labels.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "confirmed").alias("decision"))
    decided = t.labels.where("doc_id % 6 = 0").select("doc_id", F.lit("dismissed").alias("decision"))
    return plans.adjudicate(findings, decided, "doc_id").select("doc_id", "decision", "refused")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'added' WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 7 = 0 THEN 'conflict' ELSE 'same' END AS state, c_name FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_custkey % 3 = 0)")
def m07_registry_upsert(t: Tables):
    """A registry after a registration: entries added, the same, kept, or in conflict."""
    k = F.col("c_custkey")
    registry = t.customer.where(k % 4 != 0).select("c_custkey", "c_name")
    new = t.customer.where(k % 3 != 0).select("c_custkey", F.when((k % 7 == 0) & (k % 4 != 0), "other").otherwise(F.col("c_name")).alias("c_name"))
    return plans.register(registry, new, "c_custkey", ["c_name"])


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 3 THEN 'invalid_size' END, CASE WHEN p_type NOT LIKE '%E%' THEN 'missing_field' END, CASE WHEN p_retailprice > 1500 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part")
def f31_reason_codes(t: Tables):
    """Rules of a record as a list of reason codes."""
    rules = [("invalid_size", F.col("p_size") < 3), ("missing_field", ~F.col("p_type").like("%E%")), ("too_long", F.col("p_retailprice") > 1500)]
    return t.part.select("p_partkey", F.array_join(fields.reason_codes(rules), ",").alias("reasons"))


@query("SELECT event_id, array_to_string(list_sort(list_concat(list_filter(json_keys(props), lambda k: k <> 'ref'), ['note'])), ',') AS keys FROM events")
def f37_corrections(t: Tables):
    """Corrections of a record: a field set, another removed."""
    fixed = fields.corrected(F.from_json("props", "map<string,string>"), {"note": F.lit("x")}, ["ref"])
    return t.events.select("event_id", F.array_join(F.sort_array(F.map_keys(fixed)), ",").alias("keys"))
