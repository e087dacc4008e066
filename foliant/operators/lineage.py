"""Cutting lineage where a plan would otherwise repeat its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that ``spark.checkpoint.dir`` names; one below the warehouse where that is unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)
