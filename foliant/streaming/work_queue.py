"""A work session as a stream: results that arrive as files are merged into the ledger.

Results are keyed by content, so a file that is delivered twice changes nothing;
each batch writes a new version of the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.plans import commit_version, head, reconcile

RESULT = "work_id string, status string"


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Results as they arrive, one JSON a line."""
    return spark.readStream.schema(RESULT).option("mode", "FAILFAST").json(folder)


def ingest(arriving: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Merge all files that are there, then stop; conflicts fail the batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = head(ledger)
        work = spark.read.parquet(f"{ledger}/v={now}")
        merged = reconcile(work, batch.select("work_id", "status").distinct(), "work_id")
        wrong = merged.where(F.col("outcome").isin("conflict", "unknown", "invalid")).limit(1).collect()
        if wrong:
            raise ValueError(f"result {wrong[0].asDict()} doesn't fit the ledger")
        commit_version(merged.select("work_id", "status"), ledger, now, f"{number:08d}")

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_item(spark: SparkSession, ledger: str) -> DataFrame:
    """The first pending item."""
    return spark.read.parquet(f"{ledger}/v={head(ledger)}").where("status = 'pending'").orderBy("work_id").limit(1)
