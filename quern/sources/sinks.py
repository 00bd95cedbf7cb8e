"""Writers: keyed merges into Parquet tables, logs, exports. A merge writes a new version and swaps it in by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import tabular as B


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _versions(spark, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{10})", n)) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def read_table(spark, path: str) -> DataFrame | None:
    """The newest whole version of a versioned table; null if there is none. A version is whole once its writer committed it."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]:010d}") if found else None


def write_table(df: DataFrame, path: str) -> int:
    found = _versions(df.sparkSession, path)
    version = found[-1] + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{path}/v{version:010d}")
    return version


def merge_into(source: DataFrame, path: str, keys: list[str], order: str | None = None) -> int:
    """Upserts source into a versioned table; readers see the old version until the new one is whole."""
    target = read_table(source.sparkSession, path)
    if target is None:
        empty = source.limit(0).select(*[c for c in source.columns if c != order])
        return write_table(B.merge(empty, source, keys, order), path)
    return write_table(B.merge(target, source, keys, order), path)


def delete_from(spark, path: str, gone: DataFrame, keys: list[str]) -> int:
    return write_table(B.delete_keys(read_table(spark, path), gone, keys), path)


def replace_in(source: DataFrame, path: str, gone: DataFrame, keys: list[str]) -> int:
    """A new version of a table without the rows whose keys are in `gone`, and with those of source."""
    target = read_table(source.sparkSession, path)
    return write_table(source if target is None else B.delete_keys(target, gone, keys).unionByName(source), path)


def expire(spark, path: str, keep: int = 3) -> None:
    """Removes all but the last `keep` whole versions; readers of the newest one are not disturbed."""
    jvm = spark.sparkContext._jvm
    for version in _versions(spark, path)[:-keep]:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/v{version:010d}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def write_json_splits(df: DataFrame, path: str, id_col: str, shares: list[tuple[str, float]]) -> None:
    """JSON lines under one folder for each part of a split by hash."""
    df.withColumn("split", B.hash_split(id_col, shares)).write.mode("overwrite").partitionBy("split").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", table):
        raise ValueError(f"not a table name: {table!r}")
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def match_report(df: DataFrame, path: str) -> None:
    """A line of text for each document and algorithm."""
    df.select(F.format_string("%d\t%s\t%d matches\t%d comparisons", "id", "algorithm", "matches", "comparisons").alias("value")).write.mode("overwrite").text(path)


def write_evaluation(summary: DataFrame, per_group: DataFrame, path: str, name: str) -> None:
    """An evaluation as JSON: one object with the method, its summary and its rows for each group (as few as groups are named)."""
    whole = summary.select(F.lit(name).alias("method"), F.struct(*summary.columns).alias("summary"))
    groups = per_group.agg(F.array_sort(F.collect_list(F.struct(*per_group.columns))).alias("groups"))
    whole.crossJoin(groups).coalesce(1).write.mode("overwrite").json(path)  # one row by one row


def write_tags(tags: DataFrame, path: str, keys: list[str]) -> int:
    """Upserts (id, name, value) rows of tags into a versioned table, by their keys."""
    return merge_into(tags, path, keys)
