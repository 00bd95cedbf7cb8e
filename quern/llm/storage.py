"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def scratch(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; only where that is unset and the driver is the one machine (tests),
    a temporary folder is taken."""
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set(CHECKPOINT, base)
    return f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Files that a table of known size has at least, and rows to a file.
LEAST_FILES, FILE_ROWS = 8, 200_000


def files_for(rows: int) -> int:
    """How many files a table of so many narrow rows is written as: more with its size, and no hundreds for a small one."""
    return max(LEAST_FILES, -(-rows // FILE_ROWS))


def materialise(df: DataFrame, name: str, *partition_by: str, rows: int | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that a lost executor costs a reread and no recomputation.

    options go to the writer. Where the number of rows is known about, the files are as many as files_for says, if df has more partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(files_for(rows))
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Removes the files behind a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/quern-" in path:
            delete(df.sparkSession, path)
