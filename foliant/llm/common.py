"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python workers, and rows that are read from Parquet at once: rows are whole texts, so
#: that Spark's own 64 MB and 4,096 rows would be large objects in every task. A session may set its own.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Rows of a small intermediate table that are worth a task and a file of their own.
ROWS_A_TASK = 250_000

_scratch: list[str] = []


def package_root() -> str:
    """The folder that holds the package; on a cluster, ship it with --py-files."""
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Python workers get the package's folder on their path and batches of bounded size."""
    known = spark.sparkContext.environment
    if package_root() not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [package_root(), known.get("PYTHONPATH", "")]))
    for name, most in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path may be any that Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; where a session has none, as in tests, a
    folder below the warehouse is set as that.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_foliant_work"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _scratch:
        _scratch.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that are written within, at the end.

    An operator's result is read from such tables when an action runs, so the
    action belongs within as well.
    """
    before = set(_scratch)
    try:
        yield
    finally:
        for path in [x for x in _scratch if x not in before]:
            discard(spark, path)


def tasks_for(rows: int) -> int:
    """Tasks (and files) for a table with so many short rows."""
    return max(8, -(-rows // ROWS_A_TASK))


def write(df: DataFrame, name: str, rows: int | None = None, codec: str = "zstd") -> str:
    """Write ``df`` to the shared folder; its path. With the number of ``rows`` it has at most, a small table has few files."""
    path = fresh_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(tasks_for(rows))).write.option("compression", codec).parquet(path)
    return path


def materialise(df: DataFrame, name: str, rows: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, rows, codec))


def text_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (extra columns and their names don't
    matter), a null text as the empty one, typed as the operators expect."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever case Spark compares names in."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one in so many rows is a hot one; there are fewer of these than that.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, key: str, share: int | None = None) -> list[int]:
    """The whole-number keys that more than one in ``share`` rows have, and maybe some with a little less.

    One pass with a sketch of frequent items per task, so that nothing is
    shuffled by key; which keys count as hot decides about work, never about results.
    """
    share = share or HOT_SHARE
    found = rows.agg(F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {share}, {16 * share})").alias("top")).first()
    return sorted(x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] * share > found["n"])


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: list[int] | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table by a whole-number key, without a hot key in one task.

    The table's rows of hot keys (of which there are fewer than ``HOT_SHARE``) are
    broadcast: each key is there a bounded number of times. All others are joined
    as Spark sees fit. ``how`` is inner or left_semi.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(table, key, how)
    known = F.broadcast(rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in hot])).alias(key)))
    often = rows.join(known, key, "left_semi").join(F.broadcast(table.join(known, key, "left_semi")), key, how)
    seldom = rows.join(known, key, "left_anti").join(table, key, how)
    return often.unionByName(seldom)
