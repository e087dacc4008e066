"""Plans, results and upserts: states change by comparing content hashes."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ways in which a package supplies a module (fixed values).
MODES = ("provided", "augment", "omit", "generate")


def upsert(current: DataFrame, package: DataFrame, modes: Column, keys: list[str], value: str) -> DataFrame:
    """The module's next records: provided replaces, augment upserts, omit empties, generate keeps.

    ``modes`` is a column over the keys. ``change`` says what happened to each
    record: added, replaced, removed, preserved.
    """
    old = current.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    new = package.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    both = old.join(new, keys, "full").withColumn("_mode", modes)
    has_old, has_new = F.col("_in_old").isNotNull(), F.col("_in_new").isNotNull()
    taken = has_new & F.col("_mode").isin("provided", "augment")
    gone = has_old & ((F.col("_mode") == "omit") | (F.col("_mode") == "provided") & ~has_new)
    change = (
        F.when(taken & ~has_old, "added")
        .when(taken & ~F.col("_old").eqNullSafe(F.col("_new")), "replaced")
        .when(gone, "removed")
        .when(has_old, "preserved")
    )
    return both.select(*keys, F.when(taken, F.col("_new")).otherwise(F.col("_old")).alias(value), change.alias("change")).where("change IS NOT NULL")


def reconcile(work: DataFrame, results: DataFrame, key: str, terminal: tuple[str, ...] = ("generated", "not_applicable", "failed")) -> DataFrame:
    """Work items with their results: pending ones become terminal, equal replays
    change nothing, another result for a terminal item is a conflict, results
    without work are unknown."""
    r = results.select(F.col(key), F.col("status").alias("_status"), F.lit(True).alias("_r"))
    w = work.select(key, "status", F.lit(True).alias("_w"))
    outcome = (
        F.when(F.col("_w").isNull(), "unknown")
        .when(F.col("_r").isNull(), "kept")
        .when(~F.col("_status").isin(*terminal), "invalid")
        .when(F.col("status") == "pending", "applied")
        .when(F.col("status") == F.col("_status"), "replayed")
        .otherwise("conflict")
    )
    return w.join(r, key, "full").select(key, F.when(outcome == "applied", F.col("_status")).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


#: Which states may follow which (fixed values).
TRANSITIONS = {
    "proposed": ("quarantined", "ready"),
    "quarantined": ("rejected",),
    "ready": ("accepted", "rejected"),
    "accepted": ("applying", "rejected"),
    "applying": ("applied", "accepted"),
}


def may_follow(before: Column, after: Column) -> Column:
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.array_contains(allowed[before], after), F.lit(False))


def recovery(now: Column, before: Column, after: Column) -> Column:
    """What a prepared transaction that was cut off needs: undo, commit, or a person."""
    return F.when(now == before, "undo").when(now == after, "commit").otherwise("error")


def adjudicate(findings: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Decisions entered once: a finding that has one keeps it."""
    d = decisions.select(key, F.col("decision").alias("_d"))
    joined = findings.join(d, key, "left")
    return joined.withColumn("refused", F.col("decision").isNotNull() & F.col("_d").isNotNull()).withColumn("decision", F.coalesce("decision", "_d")).drop("_d")


class _Store:
    """A folder of any store that Spark can write to, through its file system API."""

    def __init__(self, folder: str):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("a store is read in a session")
        self.jvm, self.conf, self.folder = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def read(self, name: str) -> bytes:
        stream = self.files.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """A new file; one that is there is an error."""
        try:
            stream = self.files.create(self.path(name), False)
        except Py4JJavaError as e:
            raise FileExistsError(f"{self.folder}/{name}") from e
        stream.write(data)
        stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """A file in one step: written apart, then renamed over the old one."""
        apart = f"{name}-{uuid.uuid4().hex}"
        self.create(apart, data)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = SparkSession.getActiveSession().sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").makeQualified(self.files.getUri(), self.files.getWorkingDirectory()).toUri(), self.conf).rename(self.path(apart), self.path(name), kinds)

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), False)


def head(folder: str) -> str | None:
    """The version that a store's pointer names."""
    store = _Store(folder)
    return json.loads(store.read("HEAD.json"))["version"] if store.exists("HEAD.json") else None


def commit_version(df: DataFrame, folder: str, expected: str | None, version: str) -> str:
    """Write a version beside the others and move the pointer if it still names ``expected``.

    A version is a folder named by content; one that is there already is not
    written again. Pointer and lock lie in the store itself, wherever that is:
    the pointer is replaced in one step, by one writer at a time, after the rows
    are complete.
    """
    store = _Store(folder)
    store.files.mkdirs(store.path(""))
    store.create("LOCK", b"")
    try:
        if head(folder) != expected:
            raise RuntimeError(f"the store is at {head(folder)}, not at {expected}")
        if not store.exists(f"v={version}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{store.folder}/v={version}")
        store.replace("HEAD.json", json.dumps({"version": version, "before": expected}).encode())
    finally:
        store.delete("LOCK")
    return version


def register(registry: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A registry after a registration: known entries stay as they are, new ones are added; ``state`` is "kept", "same", "conflict" or "added"."""
    a = registry.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    b = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("given"))
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("given").isNull(), "kept").when(equal, "same").otherwise("conflict")
    return a.join(b, key, "full").select(key, *[F.when(F.col("was"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in columns], state.alias("state"))


def ingest(items: DataFrame, responses: DataFrame, key: str, request: str, asked: str, response: str) -> DataFrame:
    """Responses with ``outcome``: "accepted", "unknown" (no such item), "foreign" (another request), "repeated" (answered the same before) or "conflict"."""
    held = items.select(key, F.col(request).alias("own_request"), F.col(response).alias("held_response"), F.lit(True).alias("is_item"))
    outcome = (
        F.when(F.col("is_item").isNull(), "unknown")
        .when(~F.col(asked).eqNullSafe(F.col("own_request")), "foreign")
        .when(F.col("held_response").isNull(), "accepted")
        .when(F.col("held_response") == F.col(response), "repeated")
        .otherwise("conflict")
    )
    return responses.join(held, key, "left").withColumn("outcome", outcome).drop("own_request", "held_response", "is_item")


def classified(items: DataFrame, classes: DataFrame, key: str, kind: str, otherwise: str = "unclassified") -> DataFrame:
    """Items with a kind from a classification by key; the others stay unclassified."""
    return items.join(classes.select(key, F.col(kind).alias("given_kind")), key, "left").withColumn(kind, F.coalesce("given_kind", F.lit(otherwise))).drop("given_kind")


def signed_off(rows: DataFrame, by: list[str], gates: dict[str, Column]) -> DataFrame:
    """Each group's gates (open where every row meets them) and ``signed``: all are."""
    opened = rows.groupBy(*by).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(name) for name, c in gates.items()])
    signed = F.lit(True)
    for name in gates:
        signed = signed & F.col(name)
    return opened.withColumn("signed", signed)


def receipts(runs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group the number of runs that led to its state, and a hash over them in order."""
    listed = F.transform(F.sort_array(F.collect_list(order)), lambda x: x.cast("string"))
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.sha2(F.array_join(listed, ">"), 256).alias("receipt"))


def manifests(parts: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """Per group a hash over its parts' hashes in order, and how many there are."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(content, 256).alias("h")))), lambda x: x["h"])
    return parts.groupBy(*by).agg(F.sha2(F.array_join(listed, ""), 256).alias("manifest"), F.count("*").alias("n_parts"))
