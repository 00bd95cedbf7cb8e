"""Keyed Parquet tables in buckets of their keys' hash: a change reads and rewrites only the buckets that it touches.

Rows of a bucket stand under rows/write=<n>/bucket=<b>. A version, one small table, names for each bucket the write that holds it,
the table's number of buckets and its schema. A version is written after its rows, so readers see a change as a whole, and a
writer that dies leaves rows that no version names; the next one writes over them. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators import tabular as B
from quern.sources import sinks

#: Buckets of a new table: at 128 MB each a table of about 32 GB; `rebucket` changes it for larger ones.
BUCKETS = 256


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str) -> tuple[dict[int, int], int, StructType, int] | None:
    """(write by bucket, buckets, schema, last write) of the newest version: as many rows as buckets."""
    found = sinks.read_table(spark, path)
    if found is None:
        return None
    rows = found.collect()
    head = next(r for r in rows if r["bucket"] < 0)
    return {r["bucket"]: r["write"] for r in rows if r["bucket"] >= 0}, head["buckets"], StructType.fromJson(json.loads(head["schema"])), head["write"]


def _rows(spark: SparkSession, path: str, where: dict[int, int], schema: StructType) -> DataFrame:
    if not where:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/rows/write={w}/bucket={b}" for b, w in sorted(where.items())]
    return spark.read.schema(schema).parquet(*folders)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table; null if there is none."""
    state = _state(spark, path)
    return state and _rows(spark, path, state[0], state[2])


def _written(spark: SparkSession, folder: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]


def _commit(rows: DataFrame, path: str, keys: list[str], kept: dict[int, int], buckets: int, schema: StructType, write: int) -> int:
    """Writes rows bucket by bucket, then the version that names them beside the kept buckets."""
    spark, folder = rows.sparkSession, f"{path}/rows/write={write}"
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    where = kept | dict.fromkeys(_written(spark, folder), write)
    state = [(-1, write, buckets, schema.json())] + [(b, w, buckets, None) for b, w in sorted(where.items())]
    return sinks.write_table(spark.createDataFrame(state, "bucket int, write long, buckets int, schema string").coalesce(1), path)


def _change(source: DataFrame, gone: DataFrame | None, path: str, keys: list[str], order: str | None, buckets: int) -> int | None:
    spark = source.sparkSession
    state = _state(spark, path)
    where, buckets, schema, last = state or ({}, buckets, source.select(*[c for c in source.columns if c != order]).schema, -1)
    hit = source.select(_bucket(keys, buckets).alias("b"))
    if gone is not None:
        hit = hit.union(gone.select(_bucket(keys, buckets)))
    touched = {r["b"] for r in hit.distinct().collect()}  # at most as many as buckets
    if state and not touched:
        return None
    old = _rows(spark, path, {b: w for b, w in where.items() if b in touched}, schema)
    new = B.merge(old, source, keys, order) if gone is None else B.delete_keys(old, gone, keys).unionByName(source.select(*schema.names))
    return _commit(new, path, keys, {b: w for b, w in where.items() if b not in touched}, buckets, schema, last + 1)


def merge_into(source: DataFrame, path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> int | None:
    """Upserts source by its keys, the last row by `order` of equal keys. The version's number, or null where nothing was to be done.

    `buckets` counts for a table that is new. Null keys are keys like others. source is read twice (its buckets, then its rows), so
    cut it first where it might give other rows the second time.
    """
    return _change(source, None, path, keys, order, buckets)


def replace_in(source: DataFrame, path: str, gone: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int | None:
    """The table without the rows whose keys are in gone, and with those of source; keys may have many rows."""
    return _change(source, gone, path, keys, None, buckets)


def delete_from(path: str, gone: DataFrame, keys: list[str]) -> int | None:
    state = _state(gone.sparkSession, path)
    return state and replace_in(gone.sparkSession.createDataFrame([], state[2]), path, gone, keys)


def rebucket(spark: SparkSession, path: str, keys: list[str], buckets: int) -> int:
    """Rewrites the whole table into another number of buckets."""
    where, _, schema, last = _state(spark, path)
    return _commit(_rows(spark, path, where, schema), path, keys, {}, buckets, schema, last + 1)


def expire(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Removes all but the last `keep` versions, and the buckets that only those named."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    versions = sinks._versions(spark, path)
    named = lambda some: {(r["write"], r["bucket"]) for v in some for r in spark.read.parquet(f"{path}/v{v:010d}").where("bucket >= 0").collect()}
    if len(versions) <= keep:
        return
    for write, bucket in named(versions[:-keep]) - named(versions[-keep:]):
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/write={write}/bucket={bucket}")
        old.getFileSystem(conf).delete(old, True)
    sinks.expire(spark, path, keep)
