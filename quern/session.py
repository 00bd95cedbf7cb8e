"""Session builder for local runs and tests; on a cluster the submitted session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", app: str = "quern", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC time."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
