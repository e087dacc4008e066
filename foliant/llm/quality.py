"""Host-level quality rules (operator 1); DataFrame and SQL functions only.

Every document is measured in place, without exploding its words: words
``[^\\x20\\x09-\\x0D]+``, symbols, repeated lines, and the words that lie in
3-word windows found twice or more. For the windows, each one's hash and place
are packed into one long and sorted, so that equal windows lie next to each
other; neighbours are then compared word by word (and the windows of a text in
which different ones share a hash are sorted themselves).

A document that breaks a rule counts as a failure of its host (``source``). The
hosts' rates are shrunk by a beta prior whose two parameters are fitted to all
hosts by their moments: few documents say little about a host, many say much. A
host whose shrunk rate exceeds ``host_limit`` is rejected, and the verdict is
joined back to its documents.

Defined results: null text is empty (no words, base_failed); a null source is a
host of its own; repeated rows each count; an empty table gives no rows; other
columns are ignored. A task holds one document's words at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise

#: White space of the word definition: \\x20 and \\x09 to \\x0D.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Bad hosts up to this number are broadcast (some 30 bytes each); more are joined by salted keys.
BROADCAST_HOSTS = 50_000
SALTS = 32

def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words_sql(words: str, place_bits: int = 20) -> str:
    """SQL for the number of words in 3-word windows that occur twice or more in an array of words.

    The low ``place_bits`` of a key are the window's place (32 for longer texts),
    the others its hash. Where two windows that aren't equal have the same hash,
    the windows themselves are sorted: the number is exact at any length.
    """
    same = "(" + " AND ".join(f"get(w, CAST(s & m AS INT) + {k}) = get(w, CAST(get(k, i - 1) & m AS INT) + {k})" for k in range(3)) + ")"
    # For each key: 0 if its hash is another one than the key's before, 1 if the windows are equal, 2 if only the hashes are.
    steps = f"transform(k, (s, i) -> IF(i = 0 OR ((s ^ get(k, i - 1)) & ~m) <> 0, 0, IF({same}, 1, 2)))"
    keyed = "filter(k, (s, i) -> get(f, i) = 1 OR get(f, i + 1) = 1)"
    texts = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('t', concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i)))"
    whole = _let("x", texts, "transform(filter(x, (s, i) -> s.t = get(x, i - 1).t OR s.t = get(x, i + 1).t), s -> s.i)")
    places = _let("f", steps, f"sort_array(IF(array_contains(f, 2), {whole}, transform({keyed}, s -> CAST(s & m AS INT))))")
    covered = _let("p", places, "CAST(aggregate(p, named_struct('n', 0, 'next', 0), (a, x) -> named_struct('n', a.n + x + 3 - greatest(x, a.next), 'next', x + 3), a -> a.n) AS BIGINT)")
    keys = _let("k", "sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & ~m) | CAST(i AS BIGINT)))", covered)
    masked = _let("m", f"IF(size(w) < {1 << place_bits}, {(1 << place_bits) - 1}L, 4294967295L)", keys)
    return _let("w", words, f"IF(size(w) < 3, 0L, {masked})")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the rules' measures of each row."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), t.alias("t"))
    words = f"array_remove(split(t, '[{WHITE}]+'), '')"
    lines = f"filter(split(t, '\n'), l -> length(translate(l, '{WHITE}', '')) > 0)"
    return base.select(
        "doc_id",
        "host",
        F.expr(f"CAST(size({words}) AS BIGINT)").alias("n_words"),
        F.expr(f"CAST(length(translate(t, '{WHITE}', '')) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(_let("a", lines, "CAST(size(a) - size(array_distinct(a)) AS BIGINT)")).alias("n_dup_lines"),
        F.expr(repeated_words_sql(words)).alias("n_repeat_words"),
    )


def ruled(measured: DataFrame) -> DataFrame:
    """Add base_failed and failed (the document breaks any rule that counts against its host)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    many_symbols = 10 * F.col("n_symbols") > F.col("n_words")
    odd_words = (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed", base | many_symbols | odd_words)


def host_rates(marked: DataFrame) -> DataFrame:
    """host, n, failures and rate (shrunk) of every host."""
    hosts = marked.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    total = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("failures").alias("f"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("ff"),
        F.sum(F.col("failures") / F.col("n") * (1 - F.col("failures") / F.col("n"))).alias("noise"),
    ).first()  # one row
    n = total["n"] or 0
    mean = total["f"] / n if n else 0.0
    # Variance between hosts, weighted by documents, less what chance alone gives.
    between = (total["ff"] - n * mean * mean - total["noise"]) / n if n else 0.0
    strength = max(1.0, mean * (1 - mean) / between - 1) if between > 1e-9 else 1e6
    return hosts.withColumn("rate", (F.col("failures") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Every document's measures, base_failed, host_rejected and kept."""
    marked = materialise(ruled(measures(docs)), "quality-measures")
    bad = materialise(host_rates(marked).where(F.col("rate") > host_limit).select("host"), "quality-hosts")
    flag = bad.withColumn("host_rejected", F.lit(True))
    if bad.count() <= BROADCAST_HOSTS:
        joined = marked.join(F.broadcast(flag.withColumnRenamed("host", "bad")), F.col("host").eqNullSafe(F.col("bad")), "left").drop("bad")
    else:
        salted = flag.withColumnRenamed("host", "bad").withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        joined = marked.withColumn("salt", salt).join(salted, F.col("host").eqNullSafe(F.col("bad")) & (F.col("salt") == F.col("bad_salt")), "left").drop("bad", "salt", "bad_salt")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


SQL = """
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM base),
windows AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (
    SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY r),
measured AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)),
marked AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed
  FROM measured),
hosts AS (SELECT host, count(*) AS n, sum(failed::INT) AS f FROM marked GROUP BY host),
moments AS (
  SELECT sum(f) / sum(n) AS mean, (sum(f * f / n) - sum(n) * (sum(f) / sum(n)) * (sum(f) / sum(n)) - sum(f / n * (1 - f / n))) / sum(n) AS v FROM hosts),
prior AS (SELECT mean, CASE WHEN v > 1e-9 THEN greatest(1.0, mean * (1 - mean) / v - 1) ELSE 1e6 END AS s FROM moments),
rated AS (SELECT host, (f + mean * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  rate > {host_limit} AS host_rejected, NOT base_failed AND NOT rate > {host_limit} AS kept
FROM marked JOIN rated ON marked.host IS NOT DISTINCT FROM rated.host
""".replace("{host_limit}", str(HOST_LIMIT))
