"""Shards of near-equal bytes: size-weighted sampled splitters, range partitions, overfull ranges divided again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import materialise

#: Bytes of text to a range, ranges to a shard at least, and samples drawn for each range.
RANGE_BYTES, RANGES_PER_SHARD, DRAWS = 32 << 20, 32, 24
MOST_RANGES = 1 << 16
OVERFULL = 2.0


def _range_of(splitters: np.ndarray, parts: dict[int, int]):
    """Adds the range of a key, and within an overfull range the part its row falls in."""
    held = np.ones(len(splitters) + 1, np.uint64)
    held[list(parts)] = list(parts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = np.searchsorted(splitters, table.column("key").to_numpy(), side="right").astype(np.int32)
            salt = table.column("salt").to_numpy().view(np.uint64)
            part = (salt % held[at]).astype(np.int32)
            table = table.append_column("range", pa.array(at)).append_column("part", pa.array(part))
            yield from table.to_batches()

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null under this law).

    size is the UTF-8 bytes of the text plus 1 (null: 1). Rows are ordered by a hash of the text, so that equal texts stand
    together. Samples drawn with chances in proportion to size give the splitters (their weighted quantiles); rows are
    range-partitioned by them, and a range over OVERFULL times the mean is divided by a second hash (of the row's number). The exact sizes of the
    ranges (a number set by bytes, MOST_RANGES at most) give each range its place in the whole order, so a shard is an
    interval of that order and sizes differ by about one row. Slots count from 0 within a shard without gaps.
    Repeated rows each get a slot; null ids and null or empty texts are rows like others; extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.lit(7), F.monotonically_increasing_id()).alias("salt"),
        ),
        "sizes",
    )
    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    ranges = int(min(max(-(-total // range_bytes), shards * RANGES_PER_SHARD), MOST_RANGES))
    draws = ranges * DRAWS
    # A row is drawn with chance draws * size / total, and stands for total / draws bytes, or for its own size if larger.
    chance = F.col("size") * F.lit(draws / total)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(11), "salt"), 11).cast("double") / F.lit(float(1 << 53))
    sample = rows.where(unit < chance).select("key", F.greatest(F.col("size").cast("double"), F.lit(total / draws)).alias("weight")).collect()
    keys, drawn = np.array([r["key"] for r in sample], np.int64), np.array([r["weight"] for r in sample], np.float64)
    inorder = np.argsort(keys, kind="stable")
    keys, weight = keys[inorder], np.cumsum(drawn[inorder])
    cut = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges) if len(keys) else np.zeros(0, np.int64)
    splitters = np.unique(keys[cut]) if len(keys) else keys

    ranged_schema = "doc_id long, size long, text_crc32 long, key long, salt long, range int, part int"
    first = rows.mapInArrow(_range_of(splitters, {}), ranged_schema).groupBy("range").agg(F.sum("size").alias("size"))
    mean = total / (len(splitters) + 1)
    parts = {r["range"]: -(-int(r["size"]) // int(mean + 1)) for r in first.where(F.col("size") > OVERFULL * mean).collect()}
    ranged = rows.mapInArrow(_range_of(splitters, parts), ranged_schema)
    sums = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    before_bytes, before_rows, at = 0, 0, []
    for r in sorted(sums, key=lambda r: (r["range"], r["part"])):
        at.append((r["range"], r["part"], before_bytes, before_rows))
        before_bytes += r["bytes"]
        before_rows += r["rows"]
    offsets = spark.createDataFrame(at, "range int, part int, before_bytes long, before_rows long")  # as many rows as ranges
    order = Window.partitionBy("range", "part").orderBy("key", "salt", "doc_id")
    numbered = ranged.withColumns(
        {"run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(order).cast("long")}
    ).join(F.broadcast(offsets), ["range", "part"])
    middle = F.col("before_bytes") + F.col("run") - F.col("size") / 2
    placed = materialise(
        numbered.select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total)))).cast("int").alias("shard"),
            (F.col("before_rows") + F.col("n") - 1).alias("place"),
        ),
        "placed",
    )
    starts = {r["shard"]: r["start"] for r in placed.groupBy("shard").agg(F.min("place").alias("start")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]), F.col("shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
