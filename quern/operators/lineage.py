"""Cutting lineage of iterated plans: a checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and the driver is the one machine (tests)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_ranges(df: DataFrame, order: str, size: str | None = None) -> DataFrame:
    """df in ranges of `order`, written once, with _part (a range's number) and _before: the rows, or the sum of size, in the ranges below.

    A window over _part that adds _before runs on from range to range, without one sorted task over all rows.
    """
    ordered = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg((F.sum(size) if size else F.count("*")).alias("n")).collect()  # as many rows as partitions
    before, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"] or 0) for r in sizes):
        offsets.append((part, before))
        before += n
    return ordered.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long")), "_part")
